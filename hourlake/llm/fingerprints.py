"""Lempel-Ziv fingerprints: minimum hashes of the phrases that a document is parsed into."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourlake.llm.common import SLICE_BYTES, slices

#: Minimum hashes in a fingerprint, each of 32 bits.
HASHES = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = (np.random.default_rng(11).integers(1, 1 << 32, HASHES, np.uint32) | 1)[:, None]
_OFFSETS = np.random.default_rng(13).integers(0, 1 << 32, HASHES, np.uint32)[:, None]


@functools.lru_cache(maxsize=1)
def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
        powers = np.full(n, np.uint64(x))
        powers[:1] = 1
        out.append(np.cumprod(powers))
    return tuple(out)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    up, down = _grown(1 << max(16, (n - 1).bit_length()))
    return up[:n], down[:n]


def phrase_ends(text: str, root: dict, node: dict, start: int = 0) -> tuple[dict, list[int]]:
    """Go on with a parse: each phrase is the longest known one and a character more.

    Returns the place in the tree of known phrases that the parse has reached, and the phrases' ends.
    """
    ends = []
    for i, c in enumerate(text, start + 1):
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            ends.append(i)
            node = root
    return node, ends


def phrase_ends_undone(text: str, root: dict, node: dict, start: int = 0) -> list[int]:
    """As ``phrase_ends``, but the new phrases are forgotten at the end."""
    ends, added = [], []
    for i, c in enumerate(text, start + 1):
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            added.append((node, c))
            ends.append(i)
            node = root
    for parent, c in added:
        del parent[c]
    return ends


def phrase_hashes(text: str, ends: list[int], start: int = 0) -> np.ndarray:
    """A 32-bit hash of each phrase from ``start`` to each end and on; the last may be an unfinished one."""
    n = len(text) - start
    if not n:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text[start:].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    # sum of code * odd ** place; a phrase's own place is taken out by the opposite power
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up, out=sums[1:])
    stops = np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)]) - start
    starts = np.concatenate([[0], stops[:-1]])
    h = (sums[stops] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the phrases; all ones for no phrase."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(hashes), 2048):
        out = np.minimum(out, (hashes[a : a + 2048] * _FACTORS + _OFFSETS).min(axis=1))
    return out


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minimum hashes: estimates the Jaccard similarity of the phrase sets."""
    return float((a == b).mean())


def two_parses(text: str, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a text and of it with the last half replaced by ``tail``.

    Both have the parse of the first part in common; a phrase across the cut is parsed with either tail.
    """
    cut = len(text) - len(text) // 2
    root: dict = {}
    node, ends = phrase_ends(text[:cut], root, root)
    last = ends[-1] if ends else 0
    common = signature(phrase_hashes(text[:last], ends))
    own = phrase_ends_undone(text[cut:], root, node, cut)
    _, edited = phrase_ends(tail, root, node, cut)
    return (
        np.minimum(common, signature(phrase_hashes(text, own, last))),
        np.minimum(common, signature(phrase_hashes(text[:cut] + tail, edited, last))),
    )


def fingerprint(text: str) -> np.ndarray:
    root: dict = {}
    return signature(phrase_hashes(text, phrase_ends(text, root, root)[1]))


def with_next(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Rows in ``parts`` blocks of consecutive keys, each block closed by a copy of the first row after it.

    Blocks are cut at approximate quantiles of the keys, so that one shuffle brings each text next to its
    follower. The first keys of the blocks, at most one per block, come to the driver and are broadcast.
    Columns: _block, _copy, _order, _key, _text; sorted within partitions.
    """
    order = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), order.alias("_order"))
    shares = [i / parts for i in range(1, parts)]
    cuts = np.unique(np.array(rows.approxQuantile("_order", shares, 0.25 / parts) if shares else [], np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def block(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, order.to_numpy(np.int64), side="right").astype(np.int32))

    firsts = {r["_block"]: r["first"] for r in rows.groupBy(block("_order").alias("_block")).agg(F.min("_order").alias("first")).collect()}
    found = sorted(firsts)
    closes = [(found[i - 1], firsts[b]) for i, b in enumerate(found)]
    heads = docs.sparkSession.createDataFrame(closes, "_block int, _order bigint")
    copies = rows.join(F.broadcast(heads), "_order").groupBy("_block", "_order").agg(F.min("_text").alias("_text"))
    columns = ["_block", "_copy", "_order", "_key", "_text"]
    both = (
        rows.withColumn("_block", block("_order")).withColumn("_copy", F.lit(False)).select(columns)
        .unionByName(copies.withColumn("_copy", F.lit(True)).withColumn("_key", F.lit(None).cast(rows.schema["_key"].dataType)).select(columns))
    )
    return both.repartition(parts, "_block").sortWithinPartitions("_block", "_copy", "_order", "_text")


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and how like they and the next text's are.

    The edited form has the last half of the code points (rounded down) replaced by as many first ones of
    the next text by ascending ``key``; the last text is followed by the first. Columns: ``key``, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Equal texts have equal
    fingerprints. Null texts count as empty; empty texts have the fingerprint of no phrase and are wholly
    alike. Null keys come first; rows of one key are ordered by text, so a repeated row follows itself.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if docs.select(key).isEmpty():
        parts = 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, done = None, None  # the row that waits for its follower's text, the one for its fingerprint
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                out: list[tuple] = []
                for b, copy, k, t in zip(*(part.column(c).to_pylist() for c in ("_block", "_copy", "_key", "_text")), strict=True):
                    if row is not None:
                        if row[0] != b:
                            raise ValueError("a block has no row after its last")
                        own, edited = two_parses(row[2], t[: len(row[2]) // 2])
                        if done is not None:
                            out.append(_finished(done, own))
                        done = (*row, t[: len(row[2]) // 2], own, edited)
                    row = (b, k, t)
                    if copy:
                        out.append(_finished(done, fingerprint(t)))
                        row, done = None, None
                if out:
                    keys, rows = zip(*out, strict=True)
                    arrays = [pa.array(keys, part.column("_key").type), *map(pa.array, zip(*rows, strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, ["_key", *NAMES])

    def _finished(done: tuple, after: np.ndarray) -> tuple:
        _, k, t, tail, own, edited = done
        digest = hashlib.sha256((t[: len(t) - len(t) // 2] + tail).encode()).hexdigest()
        return k, (len(t), digest, hexed(own), hexed(edited), likeness(own, edited), likeness(own, after))

    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text, parts).mapInArrow(run, schema).withColumnRenamed("_key", key)
