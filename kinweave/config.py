"""Configuration files: YAML (where the library is there) or JSON, unknown keys rejected."""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from kinweave.plans.spec import Spec
from kinweave.sources.files import load_adjudicator, load_by_hook, read_table, resolve

# Sections, their keys and defaults.
SECTIONS: dict[str, dict[str, Any]] = {
    "request": {"country": None, "year_from": None, "year_to": None, "map_col_from": None, "map_col_to": None, "exact_match": [], "id_col_from": None, "id_col_to": None, "extra_context_cols": [], "relationship": "auto", "string_exact_match_prune": "none", "evidence": False, "reason": False, "order_from": [], "order_to": []},
    "data": {"mode": "files", "from_path": None, "to_path": None, "callable": None, "params": {}},
    "llm": {"provider": "mock", "callable": None, "params": {}, "model": "rules", "temperature": 0.75, "seed": 42, "enable_search": True},
    "pipeline": {"batch_size": 5, "max_candidates": 6, "review_score_threshold": 0.6},
    "retry": {"max_attempts": 6, "base_delay_seconds": 1.0, "max_delay_seconds": 20.0, "jitter_seconds": 0.2},
    "cache": {"enabled": True, "backend": "parquet", "path": "llm_cache"},
    "replay": {"enabled": False, "store_dir": ".kinweave_replay"},
    "output": {"write_csv": True, "write_parquet": True, "output_dir": "outputs"},
}
REQUIRED = ("country", "year_from", "year_to", "map_col_from")


@dataclass(frozen=True)
class Config:
    sections: dict[str, dict[str, Any]]
    folder: Path | None = field(default=None)

    def __getitem__(self, name: str) -> dict[str, Any]:
        return self.sections[name]

    def options(self) -> dict[str, Any]:
        """Keyword arguments of Spec."""
        llm, pipeline = self["llm"], self["pipeline"]
        return self["request"] | {"model": llm["model"], "temperature": llm["temperature"], "seed": llm["seed"], "enable_search": llm["enable_search"], "batch_size": pipeline["batch_size"], "max_candidates": pipeline["max_candidates"]}

    def run_options(self) -> dict[str, Any]:
        """Keyword arguments of pipeline.run."""
        replay, output, cache, llm = self["replay"], self["output"], self["cache"], self["llm"]
        own = load_adjudicator(llm["callable"], llm["params"], self.folder) if llm["provider"] == "python_hook" else None
        return {
            "review_score_threshold": self["pipeline"]["review_score_threshold"], "write_csv": output["write_csv"], "write_parquet": output["write_parquet"], "output_dir": resolve(output["output_dir"], self.folder), "replay_dir": resolve(replay["store_dir"], self.folder) if replay["enabled"] else None,
            "adjudicator": own, "retry": self["retry"], "cache_dir": resolve(cache["path"], self.folder) if cache["enabled"] and own else None,
        }


def parse_config(content: Any, folder: Path | None = None) -> Config:
    if not isinstance(content, dict):
        raise ValueError("Configuration must be a mapping")
    if unknown := set(content) - set(SECTIONS):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    sections = {}
    for name, defaults in SECTIONS.items():
        given = content.get(name) or {}
        if unknown := set(given) - set(defaults):
            raise ValueError(f"unknown keys in {name}: {sorted(unknown)}")
        sections[name] = defaults | given
    if missing := [k for k in REQUIRED if sections["request"][k] in (None, "")]:
        raise ValueError(f"missing keys in request: {missing}")
    data = sections["data"]
    if data["mode"] == "files" and not (data["from_path"] and data["to_path"]):
        raise ValueError("data.from_path and data.to_path are required when mode=files")
    if data["mode"] == "python_hook" and not data["callable"]:
        raise ValueError("data.callable is required when mode=python_hook")
    if data["mode"] not in ("files", "python_hook"):
        raise ValueError(f"unknown data.mode {data['mode']!r}")
    if sections["llm"]["provider"] not in ("mock", "python_hook") or (sections["llm"]["provider"] == "python_hook") != bool(sections["llm"]["callable"]):
        raise ValueError("llm.provider is mock, or python_hook with llm.callable as module:function that gives an adjudicator")
    if sections["cache"]["backend"] not in ("parquet", "sqlite"):
        raise ValueError("cache.backend is parquet; sqlite is taken for it")
    config = Config(sections, folder)
    Spec(**config.options())
    return config


def load_config(path: str | Path) -> Config:
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        content = yaml.safe_load(text)
    except ImportError:
        content = json.loads(text)
    return parse_config(content, Path(path).resolve().parent)


def load_env(folder: str | Path | None = None) -> Path | None:
    """Settings of the nearest .env file of a folder and those above it; what the environment has stays as it is."""
    start = Path(folder or Path.cwd()).resolve()
    found = next((d / ".env" for d in (start, *start.parents) if (d / ".env").is_file()), None)
    for line in found.read_text(encoding="utf-8").splitlines() if found else ():
        key, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and key.strip() and not key.startswith("#"):
            os.environ.setdefault(key.strip(), value.strip().strip("'\""))
    return found


def git_sha(folder: str | Path | None) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, check=True, timeout=10).stdout.strip() or None
    except Exception:
        return None


def load_frames(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """The two tables and where they came from."""
    data = config["data"]
    if data["mode"] == "files":
        tables = (read_table(spark, data["from_path"], config.folder), read_table(spark, data["to_path"], config.folder))
        return *tables, {"mode": "files", "from_path": data["from_path"], "to_path": data["to_path"], "git_sha": git_sha(config.folder)}
    return *load_by_hook(spark, data["callable"], data["params"], config.folder), {"mode": "python_hook", "callable": data["callable"], "params": data["params"], "git_sha": git_sha(config.folder)}
