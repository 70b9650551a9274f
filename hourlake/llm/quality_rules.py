"""Quality rules: counts of every document, failure rates of hosts shrunk by a beta prior, verdicts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hourlake.llm.common import join_small, map_texts, texts_of
from hourlake.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]+")
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted"]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    if len(seen) > len(words) - window:
        return 0  # too few repeated words for a repeated window
    # Windows by rank: the rank of twice the length comes from the ranks of its halves, without collisions.
    length = 1
    while length < window:
        pairs = ids[:-length] * np.uint64(len(words) + 1) + ids[length:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
        length *= 2
    twice = np.bincount(ids.astype(np.int64))[ids.astype(np.int64)] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window:] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts_of(text: str) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for one text."""
    words = WORD.findall(text)
    lines = text.split("\n")
    full, dup = 0, 0
    seen: set[str] = set()
    for line in lines:
        if WORD.search(line):
            full += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(len, SYMBOL.findall(text))),
        dup,
        repeated_words(words),
        full,
        sum(map(str.isupper, words)),
    )


def document_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and a struct ``_counts`` for each row."""
    schema = ", ".join(f"{c} bigint" for c in COUNTS)
    names = [f"_kept_{i}" for i in range(len(keep))]

    def make():
        def step(part: pa.RecordBatch) -> dict:
            numbers = np.array([counts_of(t) for t in texts_of(part, at)], np.int64).reshape(-1, len(COUNTS))
            return {n: part.column(n) for n in names} | {c: pa.array(numbers[:, i]) for i, c in enumerate(COUNTS)}

        return step

    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    narrow = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *([] if text in keep else [F.col(text).alias("_text")]))
    at = names[keep.index(text)] if text in keep else "_text"
    out = map_texts(narrow, make, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", " + schema, at)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.struct(*COUNTS).alias("_counts"))


def _c(name: str) -> Column:
    return F.col(f"_counts.{name}")


def base_failed() -> Column:
    return (_c("n_words") < 20) | (100 * _c("n_repeat_words") > 30 * _c("n_words"))


def rule_points() -> Column:
    """Points against a document: two for a gross failure, one for a mild one, which needs its host's word."""
    words = F.greatest(_c("n_words"), F.lit(1))
    points = [
        F.when(10 * _c("n_symbols") > 3 * words, 2).when(10 * _c("n_symbols") > words, 1),
        F.when(10 * _c("n_shouted") > 9 * words, 2).when(2 * _c("n_shouted") > words, 1),
        F.when(10 * _c("n_dup_lines") > 3 * _c("n_lines"), 1),
        F.when((_c("word_chars") > 20 * words) | (_c("word_chars") < 2 * words), 1),
    ]
    return sum((F.coalesce(p, F.lit(0)) for p in points[1:]), F.coalesce(points[0], F.lit(0)))


def host_verdicts(counted: DataFrame, host: str, threshold: float) -> tuple[DataFrame, int]:
    """One row per host with n, k, host_rate and blocked, written to the shared folder, and their number.

    The prior's mean is the corpus rate of failing documents; its strength comes from the variance of the
    hosts' rates beyond what their sizes explain (method of moments), between 1 and 1000 documents.
    Only the sums over hosts come to the driver.
    """
    spark, path = counted.sparkSession, shared_dir(counted.sparkSession, "host-verdicts")
    failed = (base_failed() | (rule_points() > 0)).cast("bigint")
    hosts = counted.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed).alias("k"))
    hosts.write.parquet(path)
    hosts = spark.read.parquet(path)
    docs, fails, rows = hosts.agg(F.sum("n"), F.sum("k"), F.count(F.lit(1))).first()
    mean = (fails / docs) if docs else 0.0
    strength = 1000.0
    if 0 < mean < 1:
        rate = F.col("k") / F.col("n")
        var, own = hosts.agg(F.avg((rate - mean) * (rate - mean)), F.avg(mean * (1 - mean) / F.col("n"))).first()
        between = var - own
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0) if between > 1e-12 else 1000.0
    host_rate = (F.col("k") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "k", host_rate.alias("host_rate"), (host_rate > threshold).alias("blocked")), rows


def quality_rules(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns ``keep``, the counts, base_failed, host_rate and kept of every document.

    A document goes if a base rule fails, if gross failures weigh two points, or if it has a point and
    its host is blocked: the host's share of failing documents, shrunk towards the corpus rate, is over
    ``threshold``. A document without a failure stays whatever its host. Null and empty texts have no
    words and fail; null hosts are one host; repeated rows count each; other columns are ignored.
    Documents are counted once for the hosts and once for the verdicts, instead of storing texts.
    """
    hosts, rows = host_verdicts(document_counts(docs, [host], text), host, threshold)
    verdicts = hosts.select("host", F.struct("host_rate", "blocked").alias("_verdict"))
    out = join_small(document_counts(docs, list(dict.fromkeys([*keep, host])), text), verdicts, "host", rows, left=host)
    kept = ~base_failed() & ~((rule_points() >= 2) | ((rule_points() > 0) & F.coalesce(F.col("_verdict.blocked"), F.lit(False))))
    columns = [F.col(f"_counts.{c}").alias(c) for c in COUNTS]
    more = [base_failed().alias("base_failed"), F.col("_verdict.host_rate").alias("host_rate"), kept.alias("kept")]
    return out.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], *columns, *more).toDF(*keep, *COUNTS, "base_failed", "host_rate", "kept")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and nothing else."""
    names = [f"_d{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    out = quality_rules(docs.toDF(*names), names, at[host], at[text], threshold)
    return out.where("kept").select(*names).toDF(*docs.columns)
