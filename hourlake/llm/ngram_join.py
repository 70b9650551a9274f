"""Join of texts on the Jaccard similarity of their word n-grams, candidates pruned by a Bayesian test."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from hourlake.llm.common import map_texts, texts_of
from hourlake.llm.components import components
from hourlake.session import shared_dir

#: Bands of minimum hashes: a pair of similarity 0.8 shares none with probability (1 - 0.8^6)^44 < 2e-6.
BANDS, ROWS = 44, 6
#: Minimum hashes compared between two tests of a pair, and the chance of reaching the threshold under which it is dropped.
STEP, TOLERANCE = 24, 1e-9
#: Texts and shingles of a chunk, on average. Larger components are compared chunk by chunk.
CHUNK_TEXTS, CHUNK_SHINGLES = 64, 200_000

_U = np.uint64
_rng = np.random.default_rng(5)
_FACTORS = (_rng.integers(1, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_OFFSETS = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
_BAND = _rng.integers(1, 1 << 63, ROWS, _U) | _U(1)
_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=1)
def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, _U(x))
        powers[:1] = 1
        out.append(np.cumprod(powers))
    return tuple(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: runs of letters and digits of the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, _U)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _letters()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[0::2], edges[1::2]
    up, down = _grown(1 << max(16, (len(codes) - 1).bit_length()))
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum((codes.astype(_U) + _U(1)) * up[: len(codes)], out=sums[1:])
    return _mixed((sums[stops] - sums[starts]) * down[starts])


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; of a shorter text, of all its words together."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, _U)
    for i in range(n):
        h = h * _U(_BASE) + words[i : i + len(h)]
    return np.unique(_mixed(h))


def minimum_hashes(shingled: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (shingled >> _U(32)).astype(np.uint32)
    for a in range(0, len(short), 1024):
        out = np.minimum(out, (short[a : a + 1024] * _FACTORS + _OFFSETS).min(axis=1))
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    rows = hashes.reshape(BANDS, ROWS).astype(_U)
    return _mixed((rows * _BAND).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U) * _U(_BASE)).view(np.int64)


@functools.lru_cache(maxsize=4)
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each n: equal ones among n minimum hashes under which a pair is dropped.

    With a uniform prior of the similarity, the chance that it is at least the threshold after m matches
    of n is that of at most m successes in n + 1 trials of the threshold's probability.
    """
    out = [0]
    for n in range(1, BANDS * ROWS + 1):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def compare(left: list[np.ndarray], right: list[np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (left, right) whose Jaccard similarity is at least ``threshold``.

    Pairs lose their place as soon as their minimum hashes say that they will not reach it; the rest are
    counted exactly. same: both lists are one, and each pair counts once.
    """
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    ratio = Fraction(threshold).limit_denominator(10**6)
    p, q = ratio.numerator, ratio.denominator
    fits = (np.minimum.outer(n, m) * q) >= (np.maximum.outer(n, m) * p)
    a, b = np.nonzero(np.triu(fits, 1) if same else fits)
    if not len(a):
        return a, b
    mine = np.stack([minimum_hashes(x) for x in left])
    theirs = mine if same else np.stack([minimum_hashes(x) for x in right])
    need, matches = least_matches(threshold), np.zeros(len(a), np.int64)
    for s in range(0, BANDS * ROWS, STEP):
        e = min(s + STEP, BANDS * ROWS)
        matches += (mine[a, s:e] == theirs[b, s:e]).sum(axis=1)
        stay = matches >= need[e]
        a, b, matches = a[stay], b[stay], matches[stay]
    keep = np.zeros(len(a), bool)
    if len(a):
        flat = np.concatenate(right)
        offsets = np.concatenate([[0], np.cumsum(m)[:-1]])
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        for i in np.unique(a):
            at = np.flatnonzero(a == i)
            # the right texts' shingles that the left text has, counted by text
            low, high = np.searchsorted(ranked, left[i], "left"), np.searchsorted(ranked, left[i], "right")
            counts = high - low
            spots = order[np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
            common = np.bincount(np.searchsorted(offsets, spots, "right") - 1, minlength=len(right))[b[at]]
            keep[at] = common * q >= (n[i] + m[b[at]] - common) * p
    return a[keep], b[keep]


def _lowest(nodes: list[int], pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """For each node, one of its component: the same for all."""
    parent = {x: x for x in nodes}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: top(x) for x in nodes}


def _unit_links(rows: list[tuple[int, int, str]], i: int, j: int, threshold: float, n: int) -> list[tuple[int, int, int]]:
    """(node, node of its local component, links) of one unit's rows (node, chunk, text)."""
    nodes = [[x for x, c, _ in rows if c == k] for k in (i, j)]
    sets = [[shingles(t, n) for _, c, t in rows if c == k] for k in ((i,) if i == j else (i, j))]
    a, b = compare(sets[0], sets[-1], threshold, i == j)
    if not len(a):
        return []
    left, right = np.array(nodes[0])[a].tolist(), np.array(nodes[1])[b].tolist()
    ends, counts = np.unique(left + right, return_counts=True)
    root = _lowest(ends.tolist(), zip(left, right, strict=True))
    return [(x, root[x], k) for x, k in zip(ends.tolist(), counts.tolist(), strict=True)]


def candidates(signed: DataFrame) -> DataFrame:
    """(node, root) of every text that shares a band with another text; root names their component.

    In each band's bucket all texts hang on the smallest one, so a bucket of any size gives no more rows than it has.
    """
    rows = signed.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    links = rows.join(shared.select("key", "low"), "key").where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    found = components(links)
    return found.union(found.select(F.col("root"), F.col("root")).distinct())


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``key``, class_id, text_id and n_links of every row.

    Words are runs of letters and digits of the lower-cased text, its set the distinct runs of ``n`` words
    (a shorter text: all its words). Two different texts are linked if the Jaccard similarity of their
    sets is at least ``threshold``. n_links: how many different texts the row's text is linked with; text_id:
    the smallest key of the rows with the same text; class_id: the smallest key of the rows that links and equal
    texts connect. Repeated rows are copies. Null texts count as empty; texts without words have no links,
    equal ones are a class. Null keys are ignored in the smallest keys. Other columns are ignored.
    """
    rows, facts = _join(docs, key, text, n, threshold)
    out = rows.join(facts, "node")
    return out.select(F.col("_key").alias(key), "class_id", "text_id", "n_links")


def text_hash(text: Column) -> Column:
    """What texts are dealt out by, and their name unless two different texts share it."""
    return F.xxhash64(text)


def text_digest(text: Column) -> Column:
    """What tells texts apart."""
    return F.unhex(F.md5(text.cast("binary")))


def _named(signed: DataFrame, base: str) -> DataFrame:
    """``signed`` with ``node``, a number of each different text: its hash or, where texts share that, its rank.

    Of the texts of one hash the one with the smallest digest keeps it. The others, a handful in a corpus of any size,
    are named by numbers that no hash has: those that follow one another below the smallest hash or, if that is the
    smallest number, above the largest.
    """
    spark = signed.sparkSession
    shared = signed.groupBy("hash").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("hash", "low")
    shared.write.parquet(f"{base}/shared-hashes")
    shared = spark.read.parquet(f"{base}/shared-hashes")
    if shared.isEmpty():
        return signed.withColumn("node", F.col("hash"))
    others = signed.join(shared, "hash").where("digest != low").select("hash", "digest").distinct()
    ranked = others.withColumn("rank", F.row_number().over(W.orderBy("hash", "digest")))
    least, most = signed.agg(F.min("hash"), F.max("hash")).first()
    down = least - (1 << 40) > -(1 << 63)
    ranked = ranked.withColumn("node", F.lit(least) - F.col("rank") if down else F.lit(most) + F.col("rank"))
    ranked.select("hash", "digest", "node").write.parquet(f"{base}/renamed")
    renamed = spark.read.parquet(f"{base}/renamed")
    return signed.join(renamed, ["hash", "digest"], "left").withColumn("node", F.coalesce("node", "hash"))


def _join(docs: DataFrame, key: str, text: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(_key, node) of every row, and for each node its text's hash and digest, text_id, class_id, n_links and its class's leader.

    Equal texts are one node. Nodes that share a band of minimum hashes hang together; each such
    component is compared in chunks of bounded size, pair by pair within and across chunks: the
    Bayesian test drops pairs, the others are verified exactly.
    """
    spark = docs.sparkSession
    base = shared_dir(spark, "ngram-join")
    plain = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = plain.withColumns({"hash": text_hash(F.col("_text")), "digest": text_digest(F.col("_text"))})

    def sign():
        def step(part: pa.RecordBatch) -> dict:
            sets = [shingles(t, n) for t in texts_of(part, "_text")]
            keys = [band_keys(minimum_hashes(s)) for s in sets if len(s)]
            lengths = np.array([BANDS if len(s) else 0 for s in sets])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            return {c: part.column(c) for c in ("_key", "hash", "digest")} | {
                "n_set": pa.array([len(s) for s in sets], pa.int64()),
                "keys": pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())),
            }

        return step

    kind = docs.schema[key].dataType.simpleString()
    map_texts(rows, sign, f"_key {kind}, hash bigint, digest binary, n_set bigint, keys array<bigint>", "_text").write.parquet(f"{base}/signed")
    signed = _named(spark.read.parquet(f"{base}/signed"), base)
    nodes = signed.groupBy("node", "hash", "digest").agg(F.min("_key").alias("text_id"), F.max("n_set").alias("n_set"))
    nodes.write.parquet(f"{base}/nodes")
    nodes = spark.read.parquet(f"{base}/nodes")

    candidates(signed.where("n_set > 0")).join(nodes, "node").write.parquet(f"{base}/candidates")
    found = spark.read.parquet(f"{base}/candidates")
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK_TEXTS, F.sum("n_set") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    sizes = found.groupBy("root").agg(chunks)
    wanted = found.join(sizes, "root").select("node", "root", F.col("hash").alias("_hash"), F.col("digest").alias("_digest"), "text_id", "chunks")
    same_row = (rows["hash"] == wanted["_hash"]) & rows["_key"].eqNullSafe(wanted["text_id"]) & (rows["digest"] == wanted["_digest"])
    # candidates grow with the corpus, so the join is the same at every size
    texts = rows.join(wanted.hint("merge"), same_row).select("node", "root", "chunks", "_text").dropDuplicates(["node"])
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), "chunks").cast("int"))
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = texts.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "chunk", "_text")
    units = units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def flush() -> list:
            return _unit_links(held, unit[1], unit[2], threshold, n) if len(held) > 1 else []

        for batch in batches:
            out = []
            for r, i, j, node, chunk, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r, i, j) != unit:
                    out += flush() if unit else []
                    unit, held = (r, i, j), []
                held.append((node, chunk, t))
            yield _links_batch(out)
        yield _links_batch(flush() if unit else [])

    units.mapInArrow(link, "a bigint, b bigint, n_links bigint").write.parquet(f"{base}/links")
    linked = spark.read.parquet(f"{base}/links")
    counts = linked.groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n_links"))
    classes = components(linked.select("a", "b"))
    nodes = nodes.join(counts, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "node")).alias("first")
    leaders = nodes.groupBy("root").agg(first).select("root", F.col("first.text_id").alias("class_id"), F.col("first.node").alias("leader"))
    facts = nodes.join(leaders, "root").select("node", "hash", "digest", "text_id", "class_id", "leader", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select("_key", "node"), facts


def _links_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n_links"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` per class, the one with the smallest key, with all its columns and nothing else.

    Of rows with this key and text the first by all columns stays.
    """
    names = [f"_d{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows, facts = _join(docs, key, text, n, threshold)
    leaders = facts.where("node = leader").select(F.col("hash").alias("_hash"), F.col("digest").alias("_digest"), F.col("text_id").alias("_leader_key"))
    own = F.coalesce(F.col(at[text]), F.lit(""))
    marked = docs.toDF(*names).withColumns({"_own": text_hash(own), "_name": text_digest(own)})
    same = (F.col("_own") == F.col("_hash")) & F.col(at[key]).eqNullSafe(F.col("_leader_key")) & (F.col("_name") == F.col("_digest"))
    kept = marked.join(leaders, same, "left_semi")
    if not rows.groupBy("_key", "node").count().where("count > 1").isEmpty():
        # maps have no order: their JSON stands for them
        order = [F.to_json(at[f.name]) if isinstance(f.dataType, T.MapType) else F.col(at[f.name]) for f in docs.schema]
        kept = kept.groupBy("_own", "_name").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row")).select("_row.*")
    return kept.select(*names).toDF(*docs.columns)
