"""Token ids of a whole corpus: chunks cut by content are encoded once, and joints are repaired until the ids are exact.

A rolling hash cuts texts where their content says so, so that copied passages give equal chunks. A cut is moved to the
next place at which the tokenizer's own splitting always begins a new word; where there is none near, the cut stays
and the stretch between the surrounding such places is encoded again and replaces the tokens around the joint.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from kinweave.session import materialize

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("KINWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Bytes a chunk has on average between cuts, and at least.
CHUNK_BITS, CHUNK_LEAST = 8, 48
#: Bytes that a cut may be moved to a safe place.
REACH = 32
WINDOW = 16
#: Bytes of texts that are hashed together.
PART_BYTES = 1 << 22

# How byte_bpe_50k splits text into words before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoder(folder: str, name: str = "byte_bpe_50k"):
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def token_lengths(folder: str) -> np.ndarray:
    enc = encoder(folder)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], dtype=np.int64)


@lru_cache(1)
def _gear() -> np.ndarray:
    return np.random.RandomState(20110523).randint(0, 2**32, 256, dtype=np.uint64)


def safe_places(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which every text holding these bytes around has the start of a word of the tokenizer.

    A space between two visible ASCII characters begins a word; so does a kana or Chinese letter after a full-width
    stop or comma.
    """
    visible = (data > 0x20) & (data < 0x7F)
    places = np.flatnonzero(visible[:-2] & (data[1:-1] == 0x20) & visible[2:]) + 1 if len(data) > 2 else np.empty(0, dtype=np.int64)
    if len(data) > 5 and (data == 0xE3).any():
        a, b, c, d, e, f = (data[i : len(data) - 5 + i] for i in range(6))
        stop = (a == 0xE3) & (b == 0x80) & ((c == 0x81) | (c == 0x82))
        kana = (d == 0xE3) & (((e == 0x81) & (f >= 0x81)) | ((e == 0x82) & (f <= 0x96)) | ((e == 0x82) & (f >= 0xA1)) | ((e == 0x83) & (f <= 0xBA)))
        places = np.concatenate([places, np.flatnonzero(stop & (kana | ((d >= 0xE5) & (d <= 0xE8)))) + 3])
        places.sort()
    return places


def chunk_edges(texts: list[bytes]) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """For each text the byte offsets between its chunks, with both ends, and the stretches to be encoded again because
    a joint within isn't safe. Texts are hashed together, with a gap that keeps them apart.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + WINDOW)[:-1]]).astype(np.int64)
    data = np.frombuffer((b"\0" * WINDOW).join(texts), dtype=np.uint8)
    n = len(data)
    gear, h = _gear()[data], np.zeros(n, dtype=np.uint64)
    gaps = ((starts + sizes)[:-1, None] + np.arange(WINDOW)).ravel()
    gear[gaps] = 0
    for j in range(min(WINDOW, n)):
        h[j:] += gear[: n - j] << np.uint64(j)
    cuts = np.flatnonzero(((h >> np.uint64(20)) & np.uint64((1 << CHUNK_BITS) - 1)) == 0)
    owner = np.searchsorted(starts, cuts, side="right") - 1
    inside = cuts - starts[owner] < sizes[owner]
    cuts, owner, safe = cuts[inside] + 1, owner[inside], safe_places(data)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    near = np.searchsorted(safe, cuts)
    safe = np.append(safe, np.iinfo(np.int64).max)
    moved, cuts = safe[near].tolist(), cuts.tolist()
    return [_edges_of(t, start, cuts[lo:hi], moved[lo:hi], safe) for t, start, lo, hi in zip(texts, starts.tolist(), bounds, bounds[1:])]


def _edges_of(text: bytes, start: int, cuts: list[int], moved: list[int], safe: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    n = len(text)
    edges, joints, last = [0], [], 0
    for cut, place in zip(cuts, moved):
        if cut - start - last < CHUNK_LEAST:
            continue
        if place - cut <= REACH:
            cut = place - start
        else:
            cut -= start
            while cut < n and text[cut] & 0xC0 == 0x80:
                cut += 1
            if cut < n:
                joints.append(cut)
        if cut >= n:
            break
        edges.append(cut)
        last = cut
    edges.append(n)
    again: list[tuple[int, int]] = []
    for joint in joints:
        at = int(np.searchsorted(safe, joint + start))
        lo, hi = max(0, int(safe[at - 1]) - start) if at else 0, min(n, int(safe[at]) - start)
        if again and again[-1][1] >= lo:
            again[-1] = (again[-1][0], max(hi, again[-1][1]))
        else:
            again.append((lo, hi))
    return edges, again


def chunks(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte ranges of a text's chunks, and of the stretches to be encoded again."""
    edges, again = chunk_edges([text.encode("utf-8")])[0]
    return list(zip(edges, edges[1:])), again


def repaired(pieces: list[tuple[int, int, int, np.ndarray]], lengths: np.ndarray) -> list[int]:
    """Ids of a text from its chunks (kind 0) and the stretches encoded again (kind 1), as (kind, start, end, ids)."""
    ids = np.concatenate([np.asarray(p[3], dtype=np.int64) for p in pieces if p[0] == 0])
    starts = np.concatenate([p[1] + np.concatenate([[0], np.cumsum(lengths[np.asarray(p[3], dtype=np.int64)])[:-1]]) for p in pieces if p[0] == 0 and len(p[3])])
    keep, added = np.ones(len(ids), dtype=bool), []
    for kind, start, end, new in pieces:
        if kind:
            keep &= (starts < start) | (starts >= end)
            added.append((start, new))
    all_starts = np.concatenate([starts[keep], *[np.full(len(new), start) for start, new in added]])
    all_ids = np.concatenate([ids[keep], *[np.asarray(new, dtype=np.int64) for _, new in added]])
    return all_ids[np.argsort(all_starts, kind="stable")].tolist()


def _in_parts(sizes: list[int], most: int = PART_BYTES) -> Iterator[slice]:
    """Runs of texts of at most `most` bytes together; a longer one comes alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds edges, again and hashes: offsets between chunks, ends of the stretches to encode again, 16 bytes per chunk."""
    for batch in batches:
        texts = [(t or "").encode("utf-8") for t in batch.column("text").to_pylist()]
        edges, again, hashes = [], [], []
        for part in _in_parts([len(t) for t in texts]):
            for text, (own, more) in zip(texts[part], chunk_edges(texts[part])):
                edges.append(own if text else [])
                again.append([x for pair in more for x in pair])
                hashes.append([xxhash.xxh3_128_digest(text[lo:hi]) for lo, hi in zip(own, own[1:])] if text else [])
        added = (("edges", pa.array(edges, pa.list_(pa.int32()))), ("again", pa.array(again, pa.list_(pa.int32()))), ("hashes", pa.array(hashes, pa.list_(pa.binary()))))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(a for _, a in added)], [*batch.schema.names, *(name for name, _ in added)])


def _encode(folder: str):
    """Encodes texts where they lie: whole if no other text has one of its chunks, else by chunks, but those that
    another text encodes. Rows (doc_id, rid, ids, parts, led): ids of a text that needs no other, else its parts.
    """

    def text_parts(enc, lengths, text: bytes, row: dict, known: dict[bytes, list[int]]):
        encode = lambda lo, hi: enc.encode_ordinary(text[lo:hi].decode("utf-8"))
        leads = {x["hash"]: x["lead"] for x in row["shared"]}
        parts, led = [], []
        for lo, hi, key in zip(row["edges"], row["edges"][1:], row["hashes"]):
            if leads.get(key) is False:
                parts.append((0, lo, hi, key, None))
                continue
            if key not in known:
                known[key] = encode(lo, hi)
                if key in leads:
                    led.append({"hash": key, "ids": known[key]})
            parts.append((0, lo, hi, key, known[key]))
        parts += [(1, lo, hi, None, encode(lo, hi)) for lo, hi in zip(row["again"][::2], row["again"][1::2])]
        if all(p[4] is not None for p in parts):
            return repaired([(p[0], p[1], p[2], p[4]) for p in parts], lengths), None, led
        return None, [dict(zip(("kind", "start", "end", "hash", "ids"), p)) for p in parts], led

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(folder), token_lengths(folder)
        ids_type = pa.list_(pa.int32())
        part_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("ids", ids_type)]))
        led_type = pa.list_(pa.struct([("hash", pa.binary()), ("ids", ids_type)]))
        for batch in batches:
            out = []
            texts, shared = batch.column("text").to_pylist(), batch.column("shared").to_pylist()
            cut = batch.select(["edges", "again", "hashes"])
            for i, (text, of) in enumerate(zip(texts, shared)):
                if not text or not of:
                    out.append((enc.encode_ordinary(text) if text else [], None, None))
                else:
                    row = {name: cut.column(name)[i].as_py() for name in cut.schema.names} | {"shared": of}
                    out.append(text_parts(enc, lengths, text.encode("utf-8"), row, {}))
            columns = [pa.array([o[j] for o in out], t) for j, t in enumerate((ids_type, part_type, led_type))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), *columns], ["doc_id", "rid", "ids", "parts", "led"])

    return run


def _repair(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = token_lengths(folder)
        for batch in batches:
            ids = [repaired([(p["kind"], p["start"], p["end"], p["ids"]) for p in pieces], lengths) for pieces in batch["pieces"]]
            yield pd.DataFrame({"rid": batch["rid"], "ids": ids})

    return run


def encode_corpus(documents: DataFrame, doc_id: str, text: str, *, folder: str = TOKENIZERS) -> DataFrame:
    """Columns doc_id, ids: the ids by byte_bpe_50k of every row's text, without special tokens.

    Strings of special tokens are ordinary text; null and empty texts have an empty list; rows may repeat, ids may be
    null. A text of any length is cut whole. Of a chunk only its hash of 128 bits moves to find the texts that share
    it; it is encoded in the first of them, and only its ids go to the others. No rows give no rows.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = materialize(rows.mapInArrow(_cut, f"doc_id {kind}, text string, rid long, edges array<int>, again array<int>, hashes array<binary>"))
    chunk = cut.select("rid", F.explode(F.array_distinct("hashes")).alias("hash"))
    shared = materialize(chunk.groupBy("hash").agg(F.count("*").alias("n"), F.min("rid").alias("first")).where("n > 1").select("hash", "first"))
    of_text = chunk.join(shared, "hash").groupBy("rid").agg(F.collect_list(F.struct("hash", (F.col("rid") == F.col("first")).alias("lead"))).alias("shared"))
    parts = "array<struct<kind:int,start:int,end:int,hash:binary,ids:array<int>>>"
    encoded = materialize(cut.join(of_text, "rid", "left").mapInArrow(_encode(folder), f"doc_id {kind}, rid long, ids array<int>, parts {parts}, led array<struct<hash:binary,ids:array<int>>>"))
    led = encoded.where("led IS NOT NULL").select(F.explode("led").alias("l")).select("l.hash", F.col("l.ids").alias("led"))
    open_ = encoded.where("parts IS NOT NULL").select("rid", F.explode("parts").alias("p")).select("rid", "p.*").join(led, "hash", "left")
    pieces = open_.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", F.coalesce("ids", "led").alias("ids")))).alias("pieces"))
    mended = pieces.mapInPandas(_repair(folder), "rid long, ids array<int>")
    others = encoded.where("parts IS NOT NULL").select("doc_id", "rid").join(mended, "rid").select("doc_id", "ids")
    return encoded.where("parts IS NULL").select("doc_id", "ids").unionByName(others).select(F.col("doc_id").alias(doc_id), "ids")


def count_tokens(folder: str = TOKENIZERS):
    """A UDF for the number of tokens of a text; null and empty have none."""

    @F.pandas_udf(IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        enc = encoder(folder)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    return run
