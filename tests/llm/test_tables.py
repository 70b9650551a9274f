"""Operators on many rows against plain versions of their rules."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourlake.llm import chat, components, mixing, ngram_join, warc
from hourlake.llm.common import join_small, table
from hourlake.session import shared_dir


def plain_sets(texts, n=5):
    out = {}
    for t in texts:
        words = re.findall(r"[^\W_]+", (t or "").lower())
        n_now = min(n, len(words))
        out[t or ""] = {tuple(words[i : i + n_now]) for i in range(len(words) - n_now + 1)} if words else set()
    return out


def plain_join(rows):
    """(key, class_id, text_id, n_links) of rows (key, text)."""
    sets = plain_sets({t for _, t in rows})
    texts = list(sets)
    where = defaultdict(set)
    for t in texts:
        for s in sets[t]:
            where[s].add(t)
    links = defaultdict(set)
    for t in texts:
        common = Counter(u for s in sets[t] for u in where[s])
        links[t] = {u for u, k in common.items() if u != t and 10 * k >= 8 * len(sets[t] | sets[u])}
    top, keys = {}, defaultdict(list)
    for k, t in rows:
        keys[t or ""].append(k)
    for t in texts:
        if t not in top:
            stack, group = [t], {t}
            while stack:
                for u in links[stack.pop()] - group:
                    group.add(u)
                    stack.append(u)
            known = [k for u in group for k in keys[u] if k is not None]
            top |= dict.fromkeys(group, min(known, default=None))
    return Counter((k, top[t or ""], min((x for x in keys[t or ""] if x is not None), default=None), len(links[t or ""])) for k, t in rows)


def near_copies(n=150, words=120, seed=3):
    """A large group of near copies of one text, each of its own."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    return [" ".join(w if rng.random() > 0.012 else f"x{rng.integers(1000)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("many", [False, True])
def test_ngram_join_finds_every_link(spark, sf_dir, odd, documents, many, monkeypatch):
    df = documents(near_copies() + near_copies(5, seed=4) + ["a b c d", "A b, c d!", "a b c e"]) if many else table(spark, sf_dir, "documents")
    if many:
        monkeypatch.setattr(ngram_join, "CHUNK_TEXTS", 16)
    for frame in (df, odd):
        rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
        got = Counter(map(tuple, ngram_join.ngram_join(frame).select("doc_id", "class_id", "text_id", "n_links").collect()))
        assert got == plain_join(rows)
        kept = ngram_join.keep_one(frame)
        classes = {r[1] for r in plain_join(rows)}
        assert kept.columns == frame.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, classes))


def test_ngram_join_of_nothing(odd):
    assert ngram_join.ngram_join(odd.limit(0)).count() == 0
    assert ngram_join.keep_one(odd.limit(0)).count() == 0


def test_pruning_keeps_similar_pairs_and_drops_others():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(1, 1 << 63, 4000, np.uint64))
    sets = [np.sort(np.concatenate([pool[:a], pool[2000 + b : 2000 + b + 400 - a]])) for a in range(300, 401, 4) for b in (0, 500)]
    a, b = ngram_join.compare(sets, sets, 0.8, True)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    need = ngram_join.least_matches(0.8)
    assert need[24] > 4 and need[-1] > 150 and need[0] == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [tuple(map(int, rng.integers(2000, 2060, 2))) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}
    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    want = {x: top(x) for x in parent if top(x) != x}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_poisson(u, mean):
    k, term = 0, np.exp(-mean)
    total = term
    while total <= u:
        k += 1
        term *= mean / k
        total += term
    return k


def test_mix_inverts_the_poisson_distribution(spark, documents):
    rows = [(i, f"text {i}", "big" if i % 3 else ("small" if i % 2 else None)) for i in range(3000)]
    df = documents(rows, ["mean", "_steps"])
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), (None, 0.5), ("unused", 9.0)], "source string, weight double")
    got = mixing.mix(df, weights, total=4500).select(*df.columns[:6], "_copy", "_copies", "_order").collect()
    sizes, scale = Counter(s for _, _, s in rows), 4500 / 4.5
    means = {s: w * scale / sizes[s] for s, w in (("big", 1.0), ("small", 3.0), (None, 0.5))}
    counts = Counter(r["doc_id"] for r in got)
    for i, _, s in rows:
        u = int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert counts[i] == plain_poisson(u, means[s])
    assert Counter(r["_copy"] for r in got)[1] == len(counts)
    by_source = Counter(r["source"] for r in got)
    assert abs(by_source["small"] - 3000) < 300 and abs(by_source["big"] - 1000) < 150
    order = [r["_order"] for r in got]
    assert order == sorted(order) and [r["doc_id"] for r in got] != sorted(r["doc_id"] for r in got)


def test_mix_of_odd_rows(spark, odd):
    assert mixing.mix(odd, total=100).columns == [*odd.columns, "_copy", "_copies", "_order"]
    assert mixing.mix(odd.limit(0)).count() == 0
    no_weights = spark.createDataFrame([], "source string, weight double")
    assert mixing.mix(odd, no_weights).count() == 0
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(2000.0)).alias("x")).first()["x"]
    assert abs(steps[-1] - 1) < 1e-9 and steps[2000] == pytest.approx(0.5, abs=0.02)


def test_a_large_table_of_verdicts_is_joined_by_salts(spark, monkeypatch):
    from hourlake.llm import common

    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(300)], "id bigint, k string")
    right = spark.createDataFrame([("hot", 1), (None, 2), ("cold", 3)], "key string, v int")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    out = join_small(df, right, "key", 3, buckets=8, left="k")
    assert out.columns == ["id", "k", "v"] and {(r["k"], r["v"]) for r in out.collect()} == {("hot", 1), (None, 2)} and out.count() == 300


def plain_chat(rows):
    convs = defaultdict(set)
    for c, turn, role, text in rows:
        convs[c].add((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: tuple(x[2:] for x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, t in turns.items():
        longer = any(len(u) > len(t) and u[: len(t)] == t for u in turns.values())
        first = min((d for d, u in turns.items() if u == t and d is not None), default=None)
        if not longer and first == c:
            out[c] = (len(t), "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in t))
    return out


def test_chat_keeps_maximal_conversations(spark, sf_dir, monkeypatch):
    schema = "conv_id bigint, turn bigint, role string, text string, pos int, h1 int"
    long = [(50, i, "user", f"t{i}", 0, 0) for i in range(40)]
    rows = [
        (1, 0, "user", "hi", 0, 0), (2, 0, "user", "hi", 0, 0), (2, 1, "assistant", "hello", 0, 0), (3, 0, "user", "hi", 0, 0), (3, 1, "assistant", "hello", 1, 1),
        (4, 0, "assistant", "hi", 0, 0), (5, 1, "assistant", "hello", 0, 0), (6, None, None, None, 0, 0), (None, 0, "user", "hi", 0, 0), (None, 1, "user", "x", 0, 0),
        (7, 5, "user", "hi", 0, 0), (7, 5, "user", "hi", 0, 0), (7, 5, "user", "hj", 0, 0), *long, *[(51, *r[1:]) for r in long[:33]],
    ]
    monkeypatch.setattr(chat, "BLOCK", 16)
    small = spark.createDataFrame(rows, schema)
    for df in (small, table(spark, sf_dir, "conversations"), small.limit(0)):
        got = defaultdict(dict)
        for r in chat.chat_format(df).collect():
            got[r["conv_id"]][r["part"]] = r
        whole = {c: (p[0]["n_turns"], "".join(p[i]["rendered"] for i in range(len(p)))) for c, p in got.items()}
        assert whole == plain_chat([tuple(r[:4]) for r in df.select("conv_id", "turn", "role", "text").collect()])


def plain_warc(rows, least=0):
    groups = defaultdict(list)
    for i, html in rows:
        groups[html or ""].append(i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        top = max((x for x in groups[html or ""] if x is not None), default=None)
        revisit = len(data) >= least and top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, sf_dir, least):
    odd = [(1, "u", "<p>ä\r\n\r\n</p>", 0), (2, None, "<p>ä\r\n\r\n</p>", 0), (3, "u\r\nX: y", None, 0), (4, "u", "", 0), (5, "u", "x" * 300_000, 0), (None, "u", "x" * 300_000, 0), (None, None, None, 0), (6, "u", "abc", 0), (7, "u", "abc", 0), (7, "u", "abc", 0)]
    odd = spark.createDataFrame(odd, "page_id bigint, url string, html string, digest int")
    for pages in (odd, table(spark, sf_dir, "pages"), odd.limit(0)):
        path = shared_dir(spark, "warc-test")
        warc.write_archives(pages, path, least=least)
        back = warc.read_archives(spark, path)
        rows = [(r["page_id"], r["html"]) for r in pages.collect()]
        assert Counter(tuple(r[:5]) for r in back.drop("payload").collect()) == plain_warc(rows, least)
        for r in back.where("record_type = 'response'").collect():
            assert hashlib.sha1(r["payload"]).digest() == base64.b32decode(r["payload_digest"])


def archive(records):
    import struct

    import zstandard

    content = warc.train_dictionary([b"WARC/1.1 text and more text" * 3])
    compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content))
    return struct.pack("<II", warc.DICTIONARY, len(content)) + content + b"".join(compress.compress(r) for r in records)


def test_warc_damage_is_an_error():
    good = [warc.record(i, "u", b"some payload" * 9, None, False) for i in range(3)]
    data = archive(good)
    assert list(warc.read_frames(data)) == good and [warc.parse_record(x)[0] for x in good] == [0, 1, 2]
    for broken in (data[:-3], data[:5], b"RIFF" + data, data + b"\x01\x02"):
        with pytest.raises(Exception):
            list(warc.read_frames(broken))
    for wrong in (good[0][:-1], good[0].replace(b"some payload", b"same payload", 1), b"nothing", good[0] + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(wrong)


@pytest.mark.parametrize("names", [1, 7])
def test_texts_that_share_a_hash_stay_apart(spark, sf_dir, odd, monkeypatch, names):
    monkeypatch.setattr(ngram_join, "text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(names)))
    for df in (table(spark, sf_dir, "documents"), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = [tuple(r) for r in ngram_join.ngram_join(df).collect()]
        assert Counter(got) == Counter(plain_join(rows))
    docs = table(spark, sf_dir, "documents")
    kept = ngram_join.keep_one(docs)
    classes = {k: c for k, c, _, _ in plain_join([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes.values()))


def test_one_of_repeated_rows_with_a_map_stays(spark, documents):
    prose = " ".join(f"wort{i}" for i in range(40))
    df = documents([(1, prose, "a"), (1, prose, "a"), (2, prose, "b")]).withColumn("tags", F.create_map(F.lit("x"), F.col("doc_id")))
    kept = ngram_join.keep_one(df).collect()
    assert [(r["doc_id"], r["tags"]) for r in kept] == [(1, {"x": 1})]
