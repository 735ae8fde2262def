"""What one run is asked to do."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# Fixed values of requests and results.
LINK_TYPES = ("rename", "split", "merge", "transfer", "no_match", "unknown")
MATCHED_TYPES = ("rename", "split", "merge", "transfer")
RELATIONSHIPS = ("father_to_father", "father_to_child", "child_to_father", "child_to_child", "unknown")
MERGES = ("both", "only_in_from", "only_in_to")
PRUNE_MODES = ("none", "from", "to")
OUTPUT_VERSION, PROMPT_VERSION = "2.3.0", "2.5.0"


@dataclass(frozen=True)
class Spec:
    """A mapping request. order_from and order_to name the columns that say which row comes first."""

    country: str
    year_from: int | str
    year_to: int | str
    map_col_from: str
    map_col_to: str | None = None
    exact_match: tuple[str, ...] = ()
    id_col_from: str | None = None
    id_col_to: str | None = None
    extra_context_cols: tuple[str, ...] = ()
    relationship: str = "auto"
    string_exact_match_prune: str = "none"
    evidence: bool = False
    reason: bool = False
    model: str = "rules"
    batch_size: int = 5
    max_candidates: int = 6
    seed: int = 42
    temperature: float = 0.75
    enable_search: bool = True
    order_from: tuple[str, ...] = field(default=())
    order_to: tuple[str, ...] = field(default=())
    compose: bool = True

    def __post_init__(self) -> None:
        if not isinstance(self.country, str) or not self.country.strip():
            raise ValueError("country must be non-empty")
        if self.batch_size <= 0 or self.max_candidates <= 0:
            raise ValueError("batch_size and max_candidates must be > 0")
        if self.relationship not in ("auto", *RELATIONSHIPS[:-1]):
            raise ValueError(f"unknown relationship {self.relationship!r}")
        if self.string_exact_match_prune not in PRUNE_MODES:
            raise ValueError(f"unknown prune mode {self.string_exact_match_prune!r}")
        object.__setattr__(self, "country", self.country.strip())
        for name in ("exact_match", "extra_context_cols", "order_from", "order_to"):
            object.__setattr__(self, name, tuple(getattr(self, name) or ()))

    @property
    def name_to(self) -> str:
        return self.map_col_to or self.map_col_from

    def name(self, side: str) -> str:
        return self.map_col_from if side == "from" else self.name_to

    def id_column(self, side: str) -> str | None:
        return self.id_col_from if side == "from" else self.id_col_to

    def order(self, side: str) -> tuple[str, ...]:
        return self.order_from if side == "from" else self.order_to

    def request(self) -> dict:
        """What identifies a run, with the schema of what it asks for."""
        drop = ("order_from", "order_to", "compose", "id_col_from", "id_col_to", "extra_context_cols")
        out = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k not in drop}
        return out | {"map_col_to": self.name_to, "schema_version": PROMPT_VERSION}
