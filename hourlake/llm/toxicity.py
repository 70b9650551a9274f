"""Toxicity by a weighted grammar over clauses, whose insults and weights are learned from labels."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hourlake.llm.common import filter_texts, map_texts, texts_of
from hourlake.session import shared_dir

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"«»“”„]")
QUOTES = frozenset("\"«»“”„")
#: Letters of the word beginnings that are tried as terms beside whole words, and words remembered by a task.
STEMS, REMEMBERED = (4, 5, 6), 300_000

TARGETS = frozenset("you your yours he she they him her them u du dich dir ihr euch sie er tu te toi vous votre il elle ils tú usted vosotros él ella ellos".split())
NEGATIONS = frozenset("not never no nobody isn aren wasn don nicht kein keine niemals nie ne pas jamais aucun nunca jamás ni tampoco".split())
REPORTS = frozenset("said says say called calls wrote claimed quoted sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())
THREATS = frozenset("kill killing murder hurt destroy stab töten umbringen zerstören tuer détruire frapper matar destruir golpear".split())
#: A negation reaches over so many words.
REACH = 3

FEATURES = ["plain", "targeted", "negated", "reported", "threat"]
#: Weights before any label is seen: constant, then as ``FEATURES``.
PRIOR = np.array([-3.0, 2.0, 2.5, 0.5, 0.5, 2.0])


@dataclass
class Model:
    """Insults: whole words and word beginnings with their weights. weights: constant, then ``FEATURES``."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=PRIOR.copy)

    def insult(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS)])


class Grammar:
    """Transducers over the tokens of a clause, run together: each token moves all of them.

    The insult transducer gives a word's weight, the negation one is on for ``REACH`` words, the
    reported-speech one within quotes or after a verb of speaking, the target one once the clause
    addresses somebody. A clause's weight goes to one kind: reported before negated before targeted.
    """

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def _heavy(self, word: str) -> float:
        if (w := self.memo.get(word)) is None:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            w = self.memo[word] = -1.0 if word in THREATS else self.model.insult(word)
        return w

    def features(self, text: str) -> list[float]:
        text = text.lower()
        heavy = self._heavy
        if not any(map(heavy, set(WORD.findall(text)))):
            return [0.0] * len(FEATURES)
        sums = dict.fromkeys(FEATURES, 0.0)
        for clause in CLAUSE.split(text):
            tokens = TOKEN.findall(clause)
            if any(heavy(t) for t in tokens):
                kind, weight = self._clause(tokens)
                sums[kind] += weight
        return [float(np.log1p(sums[f])) for f in FEATURES]

    def _clause(self, tokens: list[str]) -> tuple[str, float]:
        weight, negated, said, quoted, target, threat, off = 0.0, 0, False, False, False, 0, 0
        for t in tokens:
            if t in QUOTES:
                quoted = not quoted
                continue
            off = REACH if t in NEGATIONS else max(0, off - 1)
            said = said or t in REPORTS
            target = target or t in TARGETS
            w = self._heavy(t)
            if w < 0:
                threat += not off
            elif w:
                weight += w
                negated += bool(off)
        if threat and target and not (said or quoted):
            return "threat", weight + 3.0 * threat
        if (said or quoted) and weight:
            return "reported", weight
        if negated and weight:
            return "negated", weight
        return ("targeted" if target else "plain"), weight

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        z = self.model.weights[0] + x @ self.model.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def terms_of(text: str) -> set[str]:
    """Terms of a text: '=' and a word, '^' and a word's beginning."""
    words = {w for w in WORD.findall(text.lower()) if len(w) <= 24}
    return {"=" + w for w in words} | {"^" + w[:n] for n in STEMS for w in words if len(w) > n}


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(texts: DataFrame, only: set[str] | None = None) -> DataFrame:
    """(term, n): in how many of the sampled texts each term stands."""

    def make():
        def step(part: pa.RecordBatch) -> dict:
            seen: Counter[str] = Counter()
            for t in texts_of(part):
                seen.update(terms_of(t) if only is None else terms_of(t) & only)
            return {"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())}

        return step

    return map_texts(texts.select("text"), make, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def cover(lists: list[list[str]], clean: dict[str, int], times: int = 3, support: int = 3) -> list[str]:
    """Terms in order of the texts they newly explain, until none explains ``support`` more.

    A text is explained ``times`` times over, so that insults that go together are all found while
    words that only stand in copies of one toxic text are not. Texts without the label (``clean``) count
    ten times against a term; of a word and its beginnings only the best is taken.
    """
    need = [times] * len(lists)
    where: dict[str, list[int]] = {}
    for i, terms in enumerate(lists):
        for t in terms:
            where.setdefault(t, []).append(i)
    gain = {t: len(w) - 10 * clean.get(t, 0) for t, w in where.items()}
    chosen: list[str] = []
    while gain:
        best = max(gain, key=lambda t: (gain[t], len(t), t))
        if gain[best] < support:
            break
        chosen.append(best)
        for t in [t for t in gain if t[1:].startswith(best[1:]) or best[1:].startswith(t[1:])]:
            del gain[t]
        for i in where[best]:
            need[i] -= 1
            if need[i] == 0:
                for t in lists[i]:
                    if t in gain:
                        gain[t] -= 1
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (constant first) that maximise the likelihood under a normal prior around ``prior``."""
    x = np.column_stack([np.ones(len(x)), x])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int) -> DataFrame:
    """Distinct labelled texts, at most about ``bound`` rows per label, that are not held out; written once.

    Rows are chosen by a hash of their key, so the choice doesn't depend on partitions. Only the chosen
    keys are broadcast. Of several labels of one key the largest counts; null labels are ignored.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "toxicity-sample")
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_toxic"))
    known = known.where(~held_out(key))
    n = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for value, count in n.items():
        share = F.when(F.col("_toxic") == value, bound / max(count, 1)).otherwise(share)
    chosen = known.where(place < share).withColumnRenamed(key, "_id")
    sample = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    sample.select("text", F.col("_toxic").alias("toxic")).dropDuplicates().write.parquet(path)
    return spark.read.parquet(path)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = 4000, lift: float = 20.0, support: int = 3) -> Model:
    """Learn insults and the weights of the clause kinds from at most about ``bound`` rows per label.

    A word or word beginning is an insult if it is at least ``lift`` times as frequent in toxic texts as in
    others and helps to cover the toxic texts. What comes to the driver is bounded by the sample. Without
    toxic labels the model knows threats only.
    """
    sample = training_sample(docs, labels, key, text, label, bound)
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    model = Model()
    if not n_toxic:
        return model
    in_toxic = {r["term"]: r["n"] for r in _counts(toxic).where(F.col("n") >= support).collect()}
    in_clean = {r["term"]: r["n"] for r in _counts(clean, set(in_toxic)).collect()} if n_clean else {}
    ratio = {t: ((n + 0.5) / (n_toxic + 1)) / ((in_clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in in_toxic.items()}
    weights = {t: min(float(np.log(r)), 6.0) for t, r in ratio.items() if r >= lift}
    known = set(weights)

    def of_texts():
        def step(part: pa.RecordBatch) -> dict:
            return {"terms": pa.array([sorted(terms_of(t) & known) for t in texts_of(part)], pa.list_(pa.string()))}

        return step

    lists = [r["terms"] for r in map_texts(toxic.select("text"), of_texts, "terms array<string>").collect()]
    for t in cover(lists, in_clean, support=support):
        (model.words if t[0] == "=" else model.stems)[t[1:]] = weights[t]

    def of_features():
        grammar = Grammar(model)

        def step(part: pa.RecordBatch) -> dict:
            return {"x": pa.array([grammar.features(t) for t in texts_of(part)], pa.list_(pa.float64())), "toxic": part.column("toxic")}

        return step

    kind = sample.schema["toxic"].dataType.simpleString()
    rows = map_texts(sample, of_features, f"x array<double>, toxic {kind}").where("toxic in (0, 1)").collect()
    model.weights = logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), PRIOR)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score in 0 to 1 and predicted (score >= 0.5) of every whole text.

    Null and empty texts get the score of a text without toxic clauses; repeated rows are scored each;
    a null key is not held out; other columns are ignored.
    """

    def make():
        grammar = Grammar(model)

        def step(part: pa.RecordBatch) -> dict:
            return {key: part.column(key), "score": pa.array(grammar.scores(texts_of(part, text)))}

        return step

    kind = docs.schema[key].dataType.simpleString()
    out = map_texts(docs.select(key, text), make, f"{key} {kind}, score double", text)
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose texts are not toxic, with all their columns."""

    def make():
        grammar = Grammar(model)
        return lambda part: grammar.scores(texts_of(part, text)) < 0.5

    return filter_texts(docs, make, text)
