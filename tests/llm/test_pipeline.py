"""The pipeline stage by stage against plain versions of its operators' rules."""

import hashlib
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from hourlake.llm import toxicity
from hourlake.llm.common import table
from tests.llm.test_tables import plain_join, plain_poisson
from tests.llm.test_texts import plain_counts, tiktoken_encoding


def plain_good(rows):
    """doc_ids that the quality rules keep."""
    verdicts = []
    for r in rows:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = sum(1 for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        n, chars, symbols, dup, repeated = plain_counts(text)
        shouted, least = sum(w.isupper() for w in words), max(n, 1)
        points = 2 if 10 * symbols > 3 * least else int(10 * symbols > least)
        points += 2 if 10 * shouted > 9 * least else int(2 * shouted > least)
        points += int(10 * dup > 3 * lines) + int(chars > 20 * least or chars < 2 * least)
        verdicts.append((r["doc_id"], r["source"], n < 20 or 100 * repeated > 30 * n, points))
    sizes = Counter(h for _, h, _, _ in verdicts)
    fails = Counter(h for _, h, failed, points in verdicts if failed or points)
    mean = sum(fails.values()) / len(verdicts)
    between = np.mean([(fails[h] / n - mean) ** 2 - mean * (1 - mean) / n for h, n in sizes.items()])
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0) if between > 1e-12 else 1000.0
    blocked = {h for h, n in sizes.items() if (fails[h] + mean * strength) / (n + strength) > 0.5}
    return [k for k, h, failed, points in verdicts if not (failed or points >= 2 or (points and h in blocked))]


def plain_mix(rows):
    """How often each doc_id stands in the mix: sources weigh by the root of their size."""
    sizes = Counter(r["source"] for r in rows)
    scale = len(rows) / sum(np.sqrt(n) for n in sizes.values())
    units = {r["doc_id"]: int(hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52 for r in rows}
    return +Counter({r["doc_id"]: plain_poisson(units[r["doc_id"]], scale / np.sqrt(sizes[r["source"]])) for r in rows})


def test_every_stage_does_what_its_rule_says(spark, sf_dir, monkeypatch):
    given = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            given[name] = docs
            return stage(spark, docs, sf_dir)

        return name, run

    names = [name for name, _ in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, sf_dir)
    columns = table(spark, sf_dir, "documents").columns
    assert all(given[name].columns == columns for name in names)
    rows = {name: given[name].collect() for name in names}
    ids = {name: Counter(r["doc_id"] for r in rows[name]) for name in names}
    assert len(rows["quality_rules"]) == table(spark, sf_dir, "documents").count()

    assert ids["toxicity"] == Counter(plain_good(rows["quality_rules"]))
    model = toxicity.train(given["toxicity"], table(spark, sf_dir, "labels"))
    civil = toxicity.score(given["toxicity"], model).where("predicted = 0").collect()
    assert ids["ngram_join"] == Counter(r["doc_id"] for r in civil)
    joined = plain_join([(r["doc_id"], r["text"]) for r in rows["ngram_join"]])
    assert ids["mixing"] == Counter(k for k, class_id, _, _ in joined if k == class_id)
    assert ids["bpe"] == plain_mix(rows["mixing"])

    enc, texts = tiktoken_encoding(), {r["doc_id"]: r["text"] or "" for r in rows["bpe"]}
    found = out.collect()
    assert Counter(r["doc_id"] for r in found) == ids["bpe"]
    for r in found:
        tokens = np.array(enc.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert bytes(r["ids"]) == tokens and r["n_tokens"] == len(tokens) // 4
        assert r["ids_sha256"] == hashlib.sha256(tokens).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows_and_no_rows_go_through_every_stage(spark, odd, documents, tmp_path):
    prose = [" ".join(f"{w}{i}" for w in ("wort", "haus", "baum") for i in range(n, n + 12)) for n in range(6)]
    good = documents([*((100 + i, t, f"src{i % 2}") for i, t in enumerate(prose)), (100, prose[0], "src0"), (200, prose[0], "src1"), (None, prose[5] + " ende", None)])
    names = [c for c in odd.columns if c not in good.columns]
    every = odd.unionByName(good.selectExpr("*", *[f"doc_id AS `{n}`" for n in names]))
    labels = spark.createDataFrame([(101, 1, 0), (None, 1, 1), (103, None, None), (103, 0, 1), (103, 1, 0)], "doc_id bigint, quality int, toxic int")
    for name, docs in (("odd", every), ("none", every.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    texts = {r["doc_id"]: r["text"] for r in every.where("doc_id >= 100 OR doc_id IS NULL").collect()}
    assert {r["doc_id"] for r in found} <= set(texts) and 200 not in {r["doc_id"] for r in found}
    for r in found:
        if r["doc_id"] is not None:
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    none = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
