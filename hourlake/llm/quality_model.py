"""Quality from trusted positives and unlabelled text: a linear model of least non-negative unbiased risk."""

from __future__ import annotations

import functools
import operator
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourlake.llm.common import map_texts, release, texts_of
from hourlake.llm.toxicity import held_out
from hourlake.session import shared_dir

#: Signs that stand for words or structure rather than for sentences.
SIGNS = frozenset("#%&*@|/\\_~^<>=+$")
LETTER, CAPITAL, DIGIT, SPACE, POINT, SIGN, CALL = range(7)

FEATURES = [
    "capitals", "digits", "signs", "calls", "points", "words", "distinct", "top_word",
    "repeated_word", "new_pairs", "repeated_lines", "word_length", "letters", "line_words",
]
D = len(FEATURES)
#: Standardised features beyond this many deviations count as so many.
REACH = 8.0


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if ch in SIGNS or kind[0] == "S":
            out[c] = SIGN
        elif kind in ("Lu", "Lt"):
            out[c] = CAPITAL
        elif kind[0] == "N":
            out[c] = DIGIT
        elif kind[0] in "ZC":
            out[c] = SPACE
        elif kind[0] == "P":
            out[c] = CALL if ch in "!¡" else POINT
    out[0x3000:0x3004] = POINT
    out[0x1F000:0x20000] = SIGN
    return out


def features(text: str) -> list[float]:
    """``FEATURES`` of a text; roots spread small shares. No words give zeros but for the counts of signs."""
    words = text.split()
    n, w = len(text), len(words)
    kinds = np.bincount(classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=7).tolist() if n else [0] * 7
    letters, visible = kinds[LETTER] + kinds[CAPITAL], max(n - kinds[SPACE], 1)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    return [
        (kinds[CAPITAL] / max(letters, 1)) ** 0.5,
        (kinds[DIGIT] / visible) ** 0.5,
        min(kinds[SIGN] / (w + 1), 4.0) ** 0.5,
        min(kinds[CALL] / (w + 1), 4.0) ** 0.5,
        min(kinds[POINT] / (w + 1), 4.0) ** 0.5,
        np.log1p(w),
        np.log1p(len(counts)),
        (max(counts.values(), default=0) / (w + 1)) ** 0.5,
        (sum(map(operator.eq, words, words[1:])) / (w + 1)) ** 0.5,
        len(set(zip(words, words[1:], strict=False))) / max(w - 1, 1),
        ((len(lines) - len(set(lines))) / max(len(lines), 1)) ** 0.5,
        np.log1p(visible / (w + 1)),
        letters / visible,
        np.log1p(w / max(len(lines), 1)),
    ]


@dataclass
class Model:
    """Standardisation and weights (constant first); ``prior`` is the estimated share of positives, None without any."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float | None = None

    def rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -REACH, REACH)
        return np.column_stack([np.ones(len(z)), z])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.rows(x) @ self.weights, -40, 40)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), np.float64).reshape(-1, D)


def text_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    def make():
        def step(part: pa.RecordBatch) -> dict:
            x = np.array([features(t) for t in texts_of(part, text)], np.float32).reshape(-1, D)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, D, dtype=np.int32), x.ravel())
            return {key: part.column(key), "x": lists}

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs.select(key, text), make, f"{key} {kind}, x array<float>", text)


def with_trust(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``rows`` with ``trusted``: labelled 1 without contradiction and not held out.

    Rows without a key are dealt out by their features, not as one key.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_label"))
    kind = rows.schema[key].dataType
    good = known.where((F.col("_label") == 1) & ~held_out(key)).select(F.col(key).cast(kind).alias("_key"), F.lit(False).alias("_keyless"), F.lit(True).alias("_good"))
    keyed = rows.withColumn("_keyless", F.col(key).isNull()).withColumn("_key", F.coalesce(F.col(key), F.xxhash64("x").cast(kind)))
    return keyed.join(good, ["_key", "_keyless"], "left").withColumn("trusted", F.coalesce("_good", F.lit(False))).drop("_key", "_keyless", "_good")


def _summed(rows: DataFrame, fn, size: int) -> np.ndarray:
    """The sum over all rows of what ``fn`` gives for a batch, an array of ``size``; a row per place comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += fn(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["place", "value"])
        release()

    sums = rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in sums.collect():
        out[r["place"]] = r["value"]
    return out


@dataclass
class Sums:
    """Means over a class of documents at some weights: of the two losses, the rows, and their products."""

    n: float
    loss: float
    inverse_loss: float
    x: np.ndarray
    sx: np.ndarray
    hessian: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray) -> Sums:
        n, d = v[0], D + 1
        m = v[1:] / max(n, 1.0)
        return cls(n, m[0], m[1], m[2 : 2 + d], m[2 + d : 2 + 2 * d], m[2 + 2 * d :].reshape(d, d))


def at_weights(rows: DataFrame, model: Model, w: np.ndarray) -> tuple[Sums, Sums]:
    """The sums of the trusted and of all documents at weights ``w``: one pass over the features."""
    d = D + 1
    size = 3 + 2 * d + d * d

    def part(x: np.ndarray) -> np.ndarray:
        z = x @ w
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = np.logaddexp(0, -z)
        return np.concatenate([[len(x), loss.sum(), (loss + z).sum()], x.sum(0), s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

    def fn(batch: pa.RecordBatch) -> np.ndarray:
        x = model.rows(_matrix(batch))
        trusted = np.asarray(batch.column("trusted"), bool)
        return np.concatenate([part(x[trusted]), part(x)])

    v = _summed(rows, fn, 2 * size)
    return Sums.of(v[:size]), Sums.of(v[size:])


def separate(rows: DataFrame, model: Model, ridge: float, rounds: int) -> np.ndarray:
    """Weights that tell trusted documents from all, each class counting half, by Newton steps."""
    w = np.zeros(D + 1)
    for _ in range(rounds):
        p, u = at_weights(rows, model, w)
        gradient = 0.5 * (u.sx + p.sx - p.x) + ridge * w
        step = np.linalg.solve(0.5 * (u.hessian + p.hessian) + ridge * np.eye(D + 1), gradient)
        w = w - step
        if gradient @ step < 1e-5:
            break
    return w


def estimate_prior(rows: DataFrame, model: Model, w: np.ndarray, bins: int = 1000, sure: float = 0.1) -> float:
    """The share of positives among all documents: the least ratio of all to trusted ones above a score, if that is certain.

    Above any score stand at least prior times the share of the positives there. The bound with
    Hoeffding margins picks the score; the ratio there is the estimate. ``2 * bins`` counts come to the driver.
    """

    def fn(batch: pa.RecordBatch) -> np.ndarray:
        z = model.rows(_matrix(batch)) @ w
        place = np.minimum((bins / (1 + np.exp(-np.clip(z, -40, 40)))).astype(np.int64), bins - 1)
        trusted = np.asarray(batch.column("trusted"), bool)
        return np.concatenate([np.bincount(place[trusted], minlength=bins), np.bincount(place, minlength=bins)])

    counts = _summed(rows, fn, 2 * bins).reshape(2, bins)
    n = counts.sum(axis=1)
    above = counts[:, ::-1].cumsum(axis=1) / n[:, None]
    margin = np.sqrt(np.log(4 / sure) / 2 / n).sum()
    there = above[0] > 0
    ratio = above[1][there] / above[0][there]
    best = int(np.argmin(ratio + 1.01 * margin / above[0][there]))
    return float(np.clip(ratio[best], 0.01, 0.99))


def least_risk(rows: DataFrame, model: Model, prior: float, ridge: float, rounds: int) -> np.ndarray:
    """Weights of least non-negative risk with the logistic loss.

    The risk is prior * E_P[loss(z)] + max(0, E_U[loss(-z)] - prior * E_P[loss(-z)]). While the second term is
    positive the risk is convex, and Newton steps with halving go down; a step that makes it negative,
    which only overfitting does, is followed by one that lifts it to zero again.
    """

    def parts(p: Sums, u: Sums, w: np.ndarray) -> tuple[float, float]:
        negative = u.inverse_loss - prior * p.inverse_loss
        return prior * p.loss + max(0.0, negative) + ridge / 2 * w @ w, negative

    w = np.zeros(D + 1)
    p, u = at_weights(rows, model, w)
    risk, negative = parts(p, u, w)
    best, lowest, t = w, risk, 1.0
    for _ in range(rounds):
        hessian = u.hessian + ridge * np.eye(D + 1)
        if negative < 0:
            up = u.sx - prior * p.sx
            step = -np.linalg.solve(hessian, up)
            scale, expected = min(1.0, negative / (up @ step)), -np.inf
        else:
            gradient = u.sx - prior * p.x + ridge * w
            step = np.linalg.solve(hessian, gradient)
            scale, expected = t, 1e-4 * t * (gradient @ step)
            if gradient @ step < 1e-7:
                break
        new = w - scale * step
        p_new, u_new = at_weights(rows, model, new)
        risk_new, negative_new = parts(p_new, u_new, new)
        if risk_new <= risk - expected:
            w, p, u, risk, negative, t = new, p_new, u_new, risk_new, negative_new, min(1.0, 2 * t)
            if risk < lowest:
                best, lowest = w, risk
        else:
            t /= 2
            if t < 1e-3:
                break
    return best


def train(rows: DataFrame, ridge: float = 1e-4, rounds: int = 16) -> Model:
    """A model from stored features (key, x, trusted, held_out): every row that isn't held out is unlabelled text.

    Each pass adds up a few hundred numbers over all rows; nothing else comes to the driver. Without trusted
    rows every score will be 0.5.
    """
    rows = rows.where("NOT held_out").select("x", "trusted")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.concatenate([[len(x), np.count_nonzero(np.asarray(batch.column("trusted"), bool))], x.sum(0), (x * x).sum(0)])

    v = _summed(rows, moments, 2 + 2 * D)
    n, mean = max(v[0], 1.0), v[2 : 2 + D] / max(v[0], 1.0)
    model = Model(mean, np.sqrt(np.maximum(v[2 + D :] / n - mean * mean, 1e-6)), np.zeros(D + 1))
    if not v[1]:
        return model
    model.prior = estimate_prior(rows, model, separate(rows, model, ridge, 8))
    model.weights = least_risk(rows, model, model.prior, ridge, rounds)
    return model


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``key``, held_out, score in 0 to 1 and predicted (score >= ``threshold``) of every whole text.

    Features of every text are written once to the shared folder; the model is fitted on and applied to
    these. Positives are the documents labelled 1 that are not held out; other labels teach nothing. Null
    texts count as empty and are scored like any; repeated rows are scored each; a null key is not held out
    and has no label; a key labelled both 0 and 1 is no positive. Other columns are ignored.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "quality-features")
    found = with_trust(text_features(docs, key, text), labels, key, label)
    found.withColumn("held_out", held_out(key)).write.parquet(path)
    rows = spark.read.parquet(path)
    model = train(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("held_out"), pa.array(scores)], [key, "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = rows.select(key, "held_out", "x").mapInArrow(run, f"{key} {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
