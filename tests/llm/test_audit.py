"""Filter interactions, token alignment and the quality model against plain versions of their rules."""

import hashlib
import heapq
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hourlake.llm import alignment, interactions, quality_model
from hourlake.llm.common import table
from tests.llm.conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LABELS = "doc_id bigint, quality int, toxic int"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- interactions -----------------------------------------------------------------------------


def plain_failures(docs):
    """(part, doc_id, set of filters it fails) of rows with doc_id, source and text."""
    out = []
    for r in docs:
        t, words = r["text"] or "", re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["C"] = 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)
        fails["E"] = any(o["doc_id"] is not None and r["doc_id"] is not None and o["doc_id"] < r["doc_id"] and (o["text"] or "") == t for o in docs)
        out.append((r["source"] or "", r["doc_id"], {f for f, x in fails.items() if x}))
    return out


def plain_audit(docs, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[k] == 1 and r["doc_id"] is not None} for k in ("quality", "toxic"))
    parts = defaultdict(list)
    for part, key, fails in plain_failures(docs):
        parts[part].append((key, fails))
    out = {}
    for part, rows in parts.items():
        sums = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(f in x for _, x in rows) - len(removed), sum(x == {f} for _, x in rows),
                    sum(k in good for k, _ in removed), sum(k in toxic for k, _ in removed), f,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = sums[v[-1]]
    return out


def audited(df, labels, **kw):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows_of(interactions.interactions(df, labels, **kw))}


def test_interactions_of_a_table(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    assert audited(docs, labels) == plain_audit(rows_of(docs), rows_of(labels))


def test_interactions_of_odd_rows(spark, documents, odd):
    labels = spark.createDataFrame([(3, 1, 1), (3, 0, None), (None, 1, 1), (6, None, None), (9, 1, 0), (10, 0, 1)], LABELS)
    assert audited(odd, labels) == plain_audit(rows_of(odd), rows_of(labels))
    copies = documents([(i % 40, f"text {i % 3} #", "hot" if i % 3 else None) for i in range(300)] + [(None, "text 1 #", "hot")] * 3)
    assert audited(copies, labels) == plain_audit(rows_of(copies), rows_of(labels))
    assert audited(odd.limit(0), labels) == {} and len(audited(odd, labels.limit(0))) == 600 * 4


def test_potentials_are_those_of_the_definition(spark):
    worth = [0] + [((i * 7919) % 101) + 10**13 for i in range(1, 32)]
    got = spark.createDataFrame([(worth,)], "v array<bigint>").select(interactions.potentials("v").alias("p")).first()["p"]
    plain = [0]
    for s in range(1, 32):
        members = [1 << i for i in range(5) if s >> i & 1]
        plain.append((120 * worth[s] + sum(plain[s - m] for m in members)) / len(members))
    assert got[0] == 0 and np.allclose(got, plain, rtol=1e-12)


# --- alignment --------------------------------------------------------------------------------


def plain_alignment(docs):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = {c: n for n, c in enumerate(chr(x) for x in range(256)) if c.isprintable() and not c.isspace() and c != "\xad"}
    chars |= {chr(256 + i): n for i, n in enumerate(x for x in range(256) if x not in chars.values())}
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    links, out = {}, {}
    for n, r in enumerate(docs):
        t = r["text"] or ""
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a, bytes_b = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a], [of_b[i] for i in ids_b]
        whole = (" " + t).encode()
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            links[n], out[n] = [], (0, 0, 0, "")
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(x) for x in parts]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links[n] = [(x, y) for x, (s, e) in zip(ids_a, spans[0]) for y, (u, v) in zip(ids_b, spans[1]) if s < v and u < e] if len(t) < 3000 else sweep(ids_a, ids_b, *spans)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for low, high in zip([0, *both], both):
            sides = [",".join(str(x) for x, (s, e) in zip(i, sp) if low <= s and e <= high) for i, sp in ((ids_a, spans[0]), (ids_b, spans[1]))] if len(t) < 3000 else None
            groups.append("|".join(sides) if sides else None)
        text = ";".join(groups) if len(t) < 3000 else None
        out[n] = (len(ids_a), len(ids_b), len(both), hashlib.sha256(text.encode()).hexdigest() if text is not None else None)
    counts = Counter(x for xs in links.values() for x in xs)
    most = defaultdict(int)
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    found = []
    for n, r in enumerate(docs):
        n_a, n_b, n_groups, digest = out[n]
        found.append((r["doc_id"], n_a, n_b, n_groups, len(links[n]), sum(counts[x] == most[x[1]] for x in links[n]), sum(counts[x] for x in links[n]), digest))
    return found


def sweep(ids_a, ids_b, spans_a, spans_b):
    j, out = 0, []
    for x, (s, e) in zip(ids_a, spans_a):
        while spans_b[j][1] <= s:
            j += 1
        k = j
        while k < len(ids_b) and spans_b[k][0] < e:
            out.append((x, ids_b[k]))
            k += 1
    return out


def aligned(df, **kw):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [tuple(r[n] for n in names) for r in rows_of(alignment.align(df, A, B, **kw))]


def same(got, want):
    hidden = {w[:7] for w in want if w[7] is None}
    def order(rows):
        return sorted((x[:7] + (None if x[:7] in hidden else x[7],) for x in rows), key=str)
    assert order(got) == order(want)


@pytest.mark.parametrize("settings", [{}, {"radix": 3, "fan_in": 2}])
def test_alignment_of_a_table(spark, sf_dir, settings):
    docs = table(spark, sf_dir, "documents").repartition(7, "doc_id")
    same(aligned(docs, **settings), plain_alignment(rows_of(docs)))


def test_alignment_of_odd_rows(spark, documents, odd):
    more = ["a  b", " lead", "trail ", "a\n b\n  c", "\n", "▁x y", "<s> </s> <unk>", "x y z w", "é ﬁ １２", "\x00 a", "a\r\nb", "I've  x'll\t'", "  ", "　 a"]
    df = odd.drop("kept", "node", "key", "word", "value", "score", "_text", "_key").unionByName(documents([(100 + i, t, None) for i, t in enumerate(more)]))
    df = df.selectExpr("*", "doc_id AS row", "text AS data", "1 AS radix")
    same(aligned(df, radix=5, fan_in=2), plain_alignment(rows_of(df)))
    assert aligned(df.limit(0)) == []
    assert all(x[1:] == (0, 0, 0, 0, 0, 0, "") for x in aligned(documents([None, "", "▁"])))


def test_segments_and_whole_texts_give_the_same_tokens():
    aligner = alignment.Aligner(A, B)
    for t in [x for x in ODD if x]:
        segments = aligner.cut(t)
        assert " " + t == "".join(" " + s for s in segments)
        whole = aligner.a.encode(" " + t, add_special_tokens=False).ids
        assert whole == [i for s in segments for i in aligner.a.encode(" " + s, add_special_tokens=False).ids]
        if "" not in segments:
            assert aligner.b.encode(t) == [i for s in segments for i in aligner.b.encode(s)]


def test_runs_and_merges():
    draw = np.random.default_rng(3)
    runs, total = [], Counter()
    for size in (0, 1, 5, 40_000, 100_000, 17):
        keys = np.unique(draw.integers(0, 1 << 40, size) // draw.integers(1, 1 << 22))
        counts = draw.integers(1, 1 << 50, len(keys))
        if len(keys):
            assert np.array_equal(np.concatenate(list(alignment.unpack(alignment.pack(keys, counts), 2)), axis=1), [keys, counts])
        runs.append(alignment.pack(keys, counts))
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    blocks = list(alignment.merge(runs + runs[3:4]))
    for k, c in alignment.merge(runs[3:4]):
        total.update(dict(zip(k.tolist(), c.tolist())))
    keys = np.concatenate([k for k, _ in blocks])
    assert (np.diff(keys) > 0).all() and dict(zip(keys.tolist(), np.concatenate([c for _, c in blocks]).tolist())) == dict(total)
    assert heapq.merge is not None and list(alignment.merge([])) == []


# --- quality model ----------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    found = quality_model.score(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_labels_of_held_out_rows_and_negatives_teach_nothing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first = {r["doc_id"]: r["score"] for r in quality_model.score(docs, labels).collect()}
    held = "crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0"
    changed = labels.where(f"NOT ({held}) AND quality = 1").selectExpr("doc_id", "quality", "1 - toxic AS toxic")
    again = {r["doc_id"]: r["score"] for r in quality_model.score(docs, changed).collect()}
    assert first.keys() == again.keys() and all(abs(first[k] - again[k]) < 1e-6 for k in first)


def test_quality_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], LABELS)
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in quality_model.score(odd, none).collect())
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (6, 0, 1), (6, 1, 0), (9, 1, 0), (7, 1, 0)], LABELS)
    rows = quality_model.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert quality_model.score(odd.limit(0), labels).count() == 0


def test_prior_and_risk_on_known_mixtures(spark):
    draw = np.random.default_rng(11)
    d = quality_model.D
    positive, negative = draw.normal(0, 1, (3000, d)), draw.normal(0, 1, (1000, d)) + np.r_[2.5, 2.5, np.zeros(d - 2)]
    trusted = draw.normal(0, 1, (1500, d))
    rows = [(x.tolist(), False) for x in np.vstack([positive, negative])] + [(x.tolist(), True) for x in trusted]
    df = spark.createDataFrame(rows, "x array<float>, trusted boolean").selectExpr("*", "false AS held_out")
    model = quality_model.train(df)
    assert abs(model.prior - 4500 / 5500) < 0.08
    right = np.concatenate([model.scores(positive) >= 0.5, model.scores(negative) < 0.5])
    assert right.mean() > 0.93
