"""Byte-level BPE: pairs contracted to a fixpoint by a recursive query inside each task, and decoding."""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import heapq
import os

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from hourlake.llm.common import map_texts, texts_of
from hourlake.llm.segments import segments

#: Words of up to so many bytes, after the cuts that no token crosses, go through the recursive query.
LONGEST = 2047
#: Words longer than this are cut first.
CUT_FROM = 32
#: Bytes of distinct words in one query; rows of all its steps; tokens decoded in one query; pieces remembered by a worker.
WORD_BYTES, QUERY_ROWS, DECODED, REMEMBERED = 192 << 10, 2_500_000, 400_000, 500_000
#: Bytes of texts or ids handled at once.
SLICE_BYTES = 2 << 20

#: Each step contracts the best pair of every word that has one and looks up only the two pairs beside it;
#: a word without such a pair takes no further step.
CONTRACT = """
WITH RECURSIVE s AS (
    SELECT w, pos, l, r, id, 0::INTEGER AS step FROM pairs LEFT JOIN merges ON k = (l::BIGINT << 32) + r
    UNION ALL
    SELECT x.w, x.pos, x.l, x.r, CASE WHEN x.k IS NULL THEN x.id ELSE m.id END, x.step
    FROM (
        SELECT w, step, pos, id, l, r, CASE WHEN beside THEN (l::BIGINT << 32) + r END AS k
        FROM (
            SELECT s.w, s.step + 1::INTEGER AS step, s.id, s.pos - (s.pos > b.best & 2047)::INTEGER AS pos,
                CASE WHEN s.pos = (b.best & 2047) + 1 THEN (b.best >> 11)::INTEGER ELSE s.l END AS l,
                CASE WHEN s.pos = (b.best & 2047) - 1 THEN (b.best >> 11)::INTEGER ELSE s.r END AS r,
                abs(s.pos - (b.best & 2047)) = 1 AS beside
            FROM s JOIN (SELECT w, min((id::BIGINT << 11) + pos) AS best FROM s WHERE id IS NOT NULL GROUP BY w) b USING (w)
            WHERE s.pos <> b.best & 2047
        )
    ) x LEFT JOIN merges m ON m.k = x.k
)
SELECT s.w, coalesce(s.id, s.l) AS l, CASE WHEN s.id IS NULL THEN s.r ELSE -1 END AS r
FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) f USING (w, step)
ORDER BY s.w, s.pos
"""

#: The tokens' bytes as characters of the same numbers.
DECODE = "SELECT doc, string_agg(bytes, '' ORDER BY pos) AS bytes FROM tokens GROUP BY doc"


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token's bytes; the rank is its id."""
    path = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> pa.Table:
    """(l, r, id) for each two tokens whose bytes together are a token."""
    ranks = load_ranks(path)
    rows = [(ranks[t[:i]], ranks[t[i:]], n) for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return pa.table(dict(zip("l r id".split(), np.array(rows, np.int64).T, strict=True)))


def _connect() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": "false"})


def contract_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long word, with a heap instead of a step over all pairs."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[p], i, p) for i in range(len(parts) - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
            if (p := pair + parts[after[j]]) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if (k := before[i]) >= 0 and (p := parts[k] + pair) in ranks:
            heapq.heappush(heap, (ranks[p], k, p))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Ids of pieces, as little-endian 32-bit numbers; one per worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = load_ranks(path), regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        inside = np.frombuffer(b"".join(t[i : i + 2] for t in self.ranks for i in range(len(t) - 1)), np.uint8)
        self.joined = np.zeros(1 << 16, bool)
        self.joined[inside[::2].astype(np.int64) << 8 | inside[1::2]] = True
        self.con = _connect()
        self.con.register("merge_rows", merge_table(path))
        self.con.execute("CREATE TABLE merges AS SELECT (l << 32) + r AS k, id::INTEGER AS id FROM merge_rows")
        self.pieces: dict[str, bytes] = {}

    def _parts(self, word: bytes) -> list[bytes]:
        """A long word between such neighbouring bytes as no token holds: no contraction crosses them."""
        if len(word) <= CUT_FROM:
            return [word]
        x = np.frombuffer(word, np.uint8).astype(np.int64)
        cuts = [0, *(np.flatnonzero(~self.joined[x[:-1] << 8 | x[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """Words that are tokens are looked up, the others contracted together."""
        out, parts = {}, {}
        for w in words:
            b = w.encode()
            if (n := self.ranks.get(b)) is not None:
                out[w] = n.to_bytes(4, "little")
            else:
                parts[w] = self._parts(b)
        ids, batch, size, rows = {}, [], 0, 0
        for p in {p for ps in parts.values() for p in ps}:
            if len(p) == 1:
                ids[p] = int(self.single[p[0]]).to_bytes(4, "little")
            elif len(p) > LONGEST:
                ids[p] = np.array(contract_long(p, self.ranks), "<u4").tobytes()
            else:
                batch.append(p)
                size, rows = size + len(p), rows + len(p) * len(p) // 2
                if size >= WORD_BYTES or rows >= QUERY_ROWS:
                    ids |= self._contract(batch)
                    batch, size, rows = [], 0, 0
        ids |= self._contract(batch) if batch else {}
        for w, ps in parts.items():
            out[w] = ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])
        return out

    def _contract(self, words: list[bytes]) -> dict[bytes, bytes]:
        lengths = np.array([len(w) for w in words])
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        inner = np.flatnonzero(w[1:] == w[:-1])
        self.con.register("pairs", pa.table({"w": w[inner], "pos": pos[inner], "l": ids[inner], "r": ids[inner + 1]}))
        found = self.con.execute(CONTRACT).fetchnumpy()
        # Each word is the left sides of its pairs and the right side of the last one. A last pair that still
        # had an id became that token, and nothing stands to its right.
        at = np.searchsorted(found["w"], np.arange(len(words) + 1))
        flat = np.insert(found["l"], at[1:], found["r"][at[1:] - 1])
        ends = (4 * np.cumsum(flat >= 0)[at[1:] + np.arange(len(words))]).tolist()
        joined = flat[flat >= 0].astype("<u4").tobytes()
        return {x: joined[a:b] for x, a, b in zip(words, [0, *ends], ends, strict=False)}

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces that are not known yet.

        Pieces that begin with a blank or newline and end with something else are searched for words in one
        text, as no word crosses their ends; the others one by one.
        """
        together = [p for p in pieces if p[0] in " \n" and not p[-1].isspace()]
        alone = {p: self.pattern.findall(p) for p in pieces.difference(together)}
        found = self.pattern.findall("".join(together))
        self.pieces |= self._words({*found, *(w for ws in alone.values() for w in ws)} - self.pieces.keys())
        known = self.pieces.__getitem__
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        wanted = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))
        at = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[at], wanted):
            raise ValueError("the pattern has words that cross a blank after a word")
        first = 0
        for p, last in zip(together, at.tolist(), strict=True):
            if last > first:
                self.pieces[p] = b"".join(map(known, found[first : last + 1]))
            first = last + 1
        for p, ws in alone.items():
            if len(ws) > 1:
                self.pieces[p] = b"".join(map(known, ws))

    def encode(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # hundreds of thousands of small strings are remembered: none of them is garbage
        try:
            cut = [segments(t) for t in texts]
            used = set().union(*cut)
            if len(self.pieces) > REMEMBERED:
                self.pieces = {p: self.pieces[p] for p in used & self.pieces.keys()}
            if new := used - self.pieces.keys():
                self._learn(new)
            known = self.pieces.__getitem__
            return [b"".join(map(known, pieces)) for pieces in cut]
        finally:
            gc.enable()


class Decoder:
    """Bytes of lists of ids; one per worker."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.known = np.fromiter(ranks.values(), np.int64)
        names = [""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            names[n] = token.decode("latin-1")
        self.vocabulary, self.con = pa.array(names), _connect()

    def decode(self, joined: list[bytes]) -> list[bytes]:
        """Bytes of each row's ids; a long row is decoded in parts."""
        lists = [np.frombuffer(x, "<u4") for x in joined]
        out: list[list[str]] = [[] for _ in lists]
        rest = [(i, x[a : a + DECODED]) for i, x in enumerate(lists) for a in range(0, len(x), DECODED)]
        first = 0
        while first < len(rest):
            stop, size = first, 0
            while stop < len(rest) and (stop == first or size + len(rest[stop][1]) <= DECODED):
                size += len(rest[stop][1])
                stop += 1
            now, first = rest[first:stop], stop
            flat = np.concatenate([x for _, x in now]).astype(np.int64)
            if not np.isin(flat, self.known, kind="table").all():
                raise ValueError("an id is not in the rank file")
            doc = np.repeat(np.arange(len(now)), [len(x) for _, x in now])
            named = pa.DictionaryArray.from_arrays(pa.array(flat, pa.int32()), self.vocabulary)
            self.con.register("tokens", pa.table({"doc": doc, "pos": np.arange(len(flat)), "bytes": named}))
            for n, text in self.con.execute(DECODE).fetchall():
                out[now[n][0]].append(text)
        return ["".join(parts).encode("latin-1") for parts in out]


@functools.lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, which keeps its pieces from task to task."""
    return Encoder(path, pattern)


@functools.lru_cache(maxsize=1)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens and ids (32-bit little-endian, joined) of every whole text.

    ``path`` is a rank file that every worker can open (or one added with ``addFile``); each match of
    ``pattern`` is encoded separately, without special tokens. Within a task the distinct words' pairs are
    rows that join the merge table; a recursive query contracts each word's leftmost pair of the
    smallest rank until none is left. Null texts count as empty, which have no ids; repeated rows are
    encoded each; other columns are ignored.
    """

    def make():
        encoder = _encoder(path, pattern)

        def step(part: pa.RecordBatch) -> dict:
            ids = encoder.encode(texts_of(part, text))
            return {key: part.column(key), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs.select(key, text), make, f"{key} {kind}, n_tokens bigint, ids binary", text, SLICE_BYTES)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and decoded, the bytes of each row's ids, by an ordered aggregation of the tokens' bytes.

    Null ids count as none. An id that is not in the rank file is an error.
    """
    names = [f"_c{i}" for i in range(len(encoded.columns))]
    at = names[encoded.columns.index(ids)]

    def make():
        decoder = _decoder(path)

        def step(part: pa.RecordBatch) -> dict:
            rows = [x or b"" for x in part.column(at).to_pylist()]
            return {n: part.column(n) for n in names} | {"decoded": pa.array(decoder.decode(rows), pa.binary())}

        return step

    schema = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, encoded.schema, strict=True)) + "decoded binary"
    return map_texts(encoded.toDF(*names), make, schema, at, SLICE_BYTES).toDF(*encoded.columns, "decoded")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``key``, n_tokens, the ids if wanted, and the sha-256 of each row's ids and of what they decode to.

    What ``encode`` and then ``decode`` give, by one worker of each running task instead of two.
    """

    def make():
        encoder, decoder = _encoder(path, pattern), _decoder(path)

        def step(part: pa.RecordBatch) -> dict:
            ids = encoder.encode(texts_of(part, text))
            out = {key: part.column(key), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            out |= {"ids": pa.array(ids, pa.binary())} if keep_ids else {}
            hashes = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, decoder.decode(ids))]
            return out | {n: pa.array(h, pa.string()) for n, h in zip(("ids_sha256", "decoded_sha256"), hashes, strict=True)}

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens bigint, {'ids binary, ' * keep_ids}ids_sha256 string, decoded_sha256 string"
    return map_texts(docs.select(key, text), make, schema, text, SLICE_BYTES)
