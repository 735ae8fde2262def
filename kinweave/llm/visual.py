"""One form for text that looks the same: widths, accents, spaces, invisible characters and look-alike letters.

A transducer is compiled once from rules and a table of look-alikes. It reads a text grapheme cluster by grapheme
cluster: marks are put in their canonical order, the longest source that begins with a cluster is rewritten, and
within a cluster the longest sources of its code points, so that a letter of any script keeps the marks it has.
Compiling checks that no source has two targets and that no target would be rewritten again, so that the form is stable.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that look like a Latin letter of the same case.
LOOK_ALIKES = {
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "У": "Y",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
    # Greek capitals and small letters
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Օ": "O", "Ս": "U", "Տ": "S", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j",
    # Latin letters of phonetic alphabets
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ʋ": "u",
}

# Hyphens and apostrophes that look like the ASCII one.
PUNCTUATION = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "－": "-", "’": "'", "‘": "'", "ʼ": "'", "＇": "'"}

# Letters with a stroke, as letter and overlaid mark.
STROKES = {"o\u0338": "ø", "O\u0338": "Ø", "d\u0335": "đ", "D\u0335": "Đ", "h\u0335": "ħ", "t\u0335": "ŧ", "T\u0335": "Ŧ", "b\u0335": "ƀ", "l\u0337": "ł", "L\u0337": "Ł"}

# Ranges of characters without any appearance.
INVISIBLE = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0100, 0xE01EF))

_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<circle>")
_END = ""
_CLUSTER = regex.compile(r"\X")
#: Grapheme clusters whose form a transducer remembers.
REMEMBERED = 1 << 16


def _spelled(text: str) -> str:
    return unicodedata.normalize("NFD", text)


class Transducer:
    """Rewrites the longest source at each grapheme cluster; characters in `skip` vanish wherever they are, within a source too."""

    def __init__(self, rules: dict[str, str], skip: frozenset[str]) -> None:
        self.skip, self.inner, self.outer = {ord(c): None for c in skip}, {}, {}
        self.form = lru_cache(REMEMBERED)(self._form)
        for source, target in rules.items():
            if not source or any(c in skip for c in source):
                raise ValueError(f"a source must have characters that stay: {source!r}")
            if source == target:
                raise ValueError(f"{source!r} is its own target")
            clusters = [_spelled(x) for x in _CLUSTER.findall(source)]
            node = self.outer if len(clusters) > 1 else self.inner
            for part in clusters if len(clusters) > 1 else clusters[0]:
                node = node.setdefault(part, {})
            if node.setdefault(_END, target) != target:
                raise ValueError(f"{source!r} has two targets: {node[_END]!r} and {target!r}")
        for source, target in rules.items():
            if self(target) != unicodedata.normalize("NFC", target):
                raise ValueError(f"the target of {source!r} would be rewritten again: {target!r}")

    def _form(self, cluster: str) -> str:
        """The form of one cluster, whose marks are in canonical order."""
        out, i, n = [], 0, len(cluster)
        while i < n:
            node, j, target, end = self.inner, i, cluster[i], i + 1
            while j < n and (node := node.get(cluster[j])) is not None:
                j += 1
                if _END in node:
                    target, end = node[_END], j
            out.append(target)
            i = end
        return unicodedata.normalize("NFC", "".join(out))

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        clusters = [c if c.isascii() else _spelled(c) for c in _CLUSTER.findall(text.translate(self.skip))]
        out, i, n = [], 0, len(clusters)
        while i < n:
            node, j, target, end = self.outer, i, None, i + 1
            while j < n and (node := node.get(clusters[j])) is not None:
                j += 1
                if _END in node:
                    target, end = node[_END], j
            out.append(self.form(clusters[i]) if target is None else target)
            i = end
        return "".join(out)


def merged(*tables: dict[str, str]) -> dict[str, str]:
    """One table of all rules; a source with two targets is an error."""
    rules: dict[str, str] = {}
    for table in tables:
        for source, target in table.items():
            if rules.setdefault(source, target) != target:
                raise ValueError(f"{source!r} has two targets: {rules[source]!r} and {target!r}")
    return rules


@lru_cache(1)
def _rules() -> tuple[dict[str, str], frozenset[str]]:
    """Rules for single characters, and letters with a stroke; marks need none, they stay with their letter's form."""
    skip = frozenset(chr(c) for lo, hi in INVISIBLE for c in range(lo, hi + 1))
    single = merged(LOOK_ALIKES, PUNCTUATION)
    look = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if c in skip or c in single or 0xD800 <= ord(c) <= 0xDFFF:
            continue
        if unicodedata.category(c) == "Zs":
            look[c] = " "
        elif unicodedata.decomposition(c).startswith(_KINDS):
            target = unicodedata.normalize("NFKC", c)
            if target[0] != " " and not skip.intersection(target):
                look[c] = unicodedata.normalize("NFC", "".join(single.get(x, x) for x in _spelled(target)))
    strokes = {base + s[1:]: t for s, t in STROKES.items() for base in (s[0], *(x for x, y in single.items() if y == s[0]))}
    return merged(single, look, strokes), skip


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer(*_rules())


def one_form(text: str | None) -> str | None:
    """The form of a text that all texts of its look share; runs of white space are one space, none at the ends."""
    return None if text is None else " ".join(transducer()(text).split())


@F.pandas_udf(StringType())
def one_form_udf(texts: pd.Series) -> pd.Series:
    known: dict[str, str | None] = {}
    return texts.map(lambda t: known[t] if t in known else known.setdefault(t, one_form(t)))


def plain_spaces(text: F.Column) -> F.Column:
    """Runs of space, tab and line break as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def same_look(values: DataFrame, text: str, entries: DataFrame, entry: str, entry_id: str) -> DataFrame:
    """values with the id of the entry that looks the same, where value and entry aren't the same characters.

    Nulls, texts of ASCII only (the transducer leaves ASCII as it is) and texts that look like no entry have no row;
    of entries that look the same the smallest id counts. An entry's own form, whatever white space is around it, is no
    case. Columns of values keep their names; the id's column replaces one of the same name. No row moves but to the
    entries, whose table is broadcast by Spark only if its size allows.
    """
    known = entries.where(F.col(entry).isNotNull()).select(one_form_udf(entry).alias("_form"), F.col(entry).alias("_entry"), F.col(entry_id).alias("_id"))
    known = known.groupBy("_form").agg(F.min_by("_entry", "_id").alias("_entry"), F.min("_id").alias("_id"))
    other = values.where(F.col(text).rlike(r"[^\x00-\x7F]"))
    formed = other.withColumn("_form", one_form_udf(text))
    return formed.join(known, "_form").where(plain_spaces(F.col(text)) != F.col("_entry")).drop("_form", "_entry").drop(*[c for c in (entry_id,) if c in values.columns]).withColumnRenamed("_id", entry_id)


@lru_cache(1)
def folding() -> tuple[str, str]:
    """Arguments of translate() that fold to plain small letters: one-letter rules, accents dropped, invisibles deleted."""
    rules, skip = _rules()
    pairs = {}
    for c in map(chr, range(0x80, 0x10000)):
        parts = "" if c in skip or 0xD800 <= ord(c) <= 0xDFFF else _spelled(rules.get(c, c))
        base = _spelled(rules.get(parts[:1], parts[:1]))[:1]
        if base and all(0x300 <= ord(m) < 0x370 for m in parts[1:]) and len(base.encode("utf-16-le")) == 2 and base.lower() != c and (c in rules or parts != c):
            pairs[c] = base.lower()
    gone = [c for c in (*sorted(skip), *map(chr, range(0x300, 0x370))) if c not in pairs and len(c.encode("utf-16-le")) == 2]
    return "".join(pairs) + "".join(gone), "".join(pairs.values())
