"""Two tokenizers aligned: tokens that overlap, and how often their ids are linked in the whole corpus.

Pair counts come from an external sort. Tasks spill (pair, document) records, cut by the radix of the
pair, as runs compressed with zstd and sorted by the second tokenizer's id first. Merges with a heap of
bounded fan-in count each pair; as all pairs of one second id stand together, its maximum is known when the
next one begins. The runs of documents then meet the counts of their radix and give back what each
document is owed.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hourlake.llm.common import release, slices, texts_of
from hourlake.llm.segments import CAREFUL, ODD_SPACE
from hourlake.session import shared_dir

#: Radix of a pair: its second id modulo this. A task that hands out counts holds those of one radix.
RADIX = 64
#: Records in memory before they are spilled; runs that one heap merges at once; records of a block.
SPILL, FAN_IN, BLOCK = 1_500_000, 64, 1 << 14
#: Bytes of texts handled at once, of texts that go to a library at once, and segments remembered by a worker.
SLICE_BYTES, BATCH_BYTES, REMEMBERED = 1 << 20, 256 << 10, 500_000
#: Segments that a library gets as one text.
LINE = 64
#: Numbers of rows are task << ROW_BITS | place.
ROW_BITS = 40

DOC = "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, row bigint"
RUN = "radix int, run bigint, kind string, records bigint, data binary"


# --- runs -------------------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as zstd frames of ``BLOCK`` rows each: the first column as differences, bytes by place."""
    compress, out = zstandard.ZstdCompressor(level=1).compress, []
    n = len(columns[0])
    for a in range(0, n, BLOCK):
        part = [c[a : a + BLOCK] for c in columns]
        rows = np.array([np.diff(part[0], prepend=0), *part[1:]], np.int64)
        frame = compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes())
        out += [len(frame).to_bytes(4, "little"), frame]
    return b"".join(out)


def unpack(data: bytes, width: int) -> Iterator[np.ndarray]:
    """The blocks of a run, each an array of ``width`` rows of numbers."""
    decompress, at = zstandard.ZstdDecompressor().decompress, 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        raw = np.frombuffer(decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(width, 8, -1)
        rows = raw.transpose(0, 2, 1).copy().view(np.int64).reshape(width, -1)
        rows[0] = np.cumsum(rows[0])
        yield rows
        at += 4 + size


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts, first)


def merge(runs: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (pair, count) merged into blocks of different pairs, ascending, with their sums.

    The heap holds the runs by the last pair of their block in memory. Up to the smallest of these all runs
    have shown what they hold, so that much is summed and given out, and the run on top moves on.
    """
    heap: list[tuple[int, int]] = []
    blocks, sources = {}, {}
    for i, data in enumerate(runs):
        sources[i] = unpack(data, 2)
        if (block := next(sources[i], None)) is not None:
            blocks[i] = block
            heap.append((int(block[0][-1]), i))
    heapq.heapify(heap)
    while heap:
        last, top = heapq.heappop(heap)
        keys, counts = [], []
        for i, block in blocks.items():
            if cut := int(np.searchsorted(block[0], last, side="right")):
                keys.append(block[0][:cut])
                counts.append(block[1][:cut])
                blocks[i] = block[:, cut:]
        if keys:
            yield summed(np.concatenate(keys), np.concatenate(counts))
        if (block := next(sources[top], None)) is not None:
            blocks[top] = block
            heapq.heappush(heap, (int(block[0][-1]), top))
        else:
            del blocks[top]


# --- tokens -----------------------------------------------------------------------------------


def _local(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def _byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Aligns texts segment by segment; one per worker, which remembers frequent segments.

    A segment begins with a blank that follows something else than white space. Neither tokenizer has a
    token across such a place: the first cuts words there, the second has no piece with a blank after another
    character. Both is looked up when they are loaded; if it doesn't hold, texts are not cut.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(_local(path_a)), sentencepiece.SentencePieceProcessor(model_file=_local(path_b))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.size_a = self.a.get_vocab_size()
        byte, tokens = _byte_of_char(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = (
            [np.array([f"{i}{sign}" for i in range(len(of))], object) for sign in signs] for of, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))
        )
        with open(_local(path_a), encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        cuts_a = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cuttable = cuts_a and all(t["special"] for t in spec["added_tokens"]) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        """Segments by number, -1 for such as don't come back byte by byte; their numbers, groups and links."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers, self.pairs, self.ends = array("q"), array("q"), array("q")

    def cut(self, text: str) -> list[str]:
        """The segments of a blank and the text, each without its first blank."""
        if not self.cuttable:
            return [text]
        if ODD_SPACE.search(text):
            return [x.removeprefix(" ") if i else x for i, x in enumerate(CAREFUL.split(text))]
        words = text.split(" ")
        if "" not in words and "\n " not in text:
            return words
        out = [words[0]]
        for w in words[1:]:
            # A blank after a blank or a newline begins no segment.
            if not out[-1] or out[-1][-1] in " \n":
                out[-1] += " " + w
            else:
                out.append(w)
        return out

    def _align(self, text: str, a: list[int], b: list[int]) -> int:
        """The number of a segment: a walk over both token lists meets each overlapping pair once."""
        bytes_a, bytes_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        whole = b" " + text.encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return -1
        size, links, groups = self.size_a, 0, []
        i, j, from_a, from_b, end_a, end_b = 0, 0, 0, 0, len(bytes_a[0]), len(bytes_b[0])
        while True:
            self.pairs.append(b[j] * size + a[i])
            links += 1
            if end_a == end_b:
                i, j = i + 1, j + 1
                groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                if i == len(a):
                    break
                from_a, from_b = i, j
                end_a, end_b = end_a + len(bytes_a[i]), end_b + len(bytes_b[j])
            elif end_a < end_b:
                i += 1
                end_a += len(bytes_a[i])
            else:
                j += 1
                end_b += len(bytes_b[j])
        self.numbers.extend((len(a), len(b), len(groups), links))
        self.ends.append(len(self.pairs))
        self.groups.append(";".join(groups))
        return len(self.groups) - 1

    def _alone(self, segment: str) -> None:
        ids = self.a.encode_batch_fast([" " + segment], add_special_tokens=False)[0].ids
        self.known[segment] = self._align(segment, ids, self.b.encode(segment))

    def _together(self, segments: list[str]) -> None:
        """Align segments as one text. Where its tokens don't end with each segment or don't give it back, halve it."""
        if len(segments) == 1:
            return self._alone(segments[0])
        text = " ".join(segments)
        whole = b" " + text.encode()
        lines = [" ".join(segments[i : i + LINE]) for i in range(0, len(segments), LINE)]
        found = [x.ids for x in self.a.encode_batch_fast([" " + x for x in lines], add_special_tokens=False)]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (found, self.b.encode(lines, num_threads=1)))
        back = all(b"".join(map(x.__getitem__, ids.tolist())) == whole for x, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        cuts = np.cumsum([len(s.encode()) + 1 for s in segments])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not back or not np.isin(cuts, common, assume_unique=True).all():
            half = len(segments) // 2
            self._together(segments[:half])
            return self._together(segments[half:])
        # The first token of b that ends after a's begins, and the first one that ends where a's ends or later.
        first = np.searchsorted(ends_b, ends_a - self.lengths_a[a], side="right")
        per = np.searchsorted(ends_b, ends_a) - first + 1
        at_a = np.repeat(np.arange(len(a)), per)
        at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(per) - per, per) + first[at_a]
        link_ends = np.searchsorted(ends_a[at_a], cuts, side="right")
        # Tokens in the order group, side, place, each with the sign that follows it.
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = np.isin(ends_a, common, assume_unique=True), np.isin(ends_b, common, assume_unique=True)
        names = np.concatenate([np.where(last_a, self.names_a[1][a], self.names_a[0][a]), np.where(last_b, self.names_b[1][b], self.names_b[0][b])])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = names[order].tolist()
        count_a, count_b, count_g = (np.searchsorted(x, cuts, side="right") for x in (ends_a, ends_b, common))
        number, before = len(self.groups), self.ends[-1] if self.ends else 0
        numbers = np.diff(np.column_stack([count_a, count_b, count_g, link_ends]), axis=0, prepend=0)
        self.numbers.frombytes(np.ascontiguousarray(numbers, np.int64).tobytes())
        self.pairs.frombytes((b[at_b] * self.size_a + a[at_a]).tobytes())
        self.ends.frombytes((link_ends + before).astype(np.int64).tobytes())
        start = 0
        for i, (s, end) in enumerate(zip(segments, (count_a + count_b).tolist(), strict=True)):
            self.groups.append("".join(words[start:end])[:-1])
            self.known[s] = number + i
            start = end

    def learn(self, segments: set[str]) -> None:
        """Align segments that are not known yet: those that end with other than white space in batches of about equal bytes."""
        batch, size = [], 0
        for s in segments - self.known.keys():
            if not s or s[-1].isspace():
                self._alone(s)
                continue
            batch.append(s)
            size += len(s) + 1
            if size >= BATCH_BYTES:
                self._together(batch)
                batch, size = [], 0
        if batch:
            self._together(batch)

    def align(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's segments; none of an empty text or one that a tokenizer doesn't give back."""
        gc.disable()  # what is remembered is no garbage
        try:
            if len(self.known) > REMEMBERED:
                self.forget()
            cut = [self.cut(t) if t else [] for t in texts]
            self.learn(set().union(*cut))
            known = self.known.__getitem__
            found = [np.fromiter(map(known, segments), np.int64, len(segments)) for segments in cut]
            for i, x in enumerate(found):
                if len(x) and x.min() < 0:  # the whole text, as one segment, decides
                    self.learn({texts[i]})
                    found[i] = np.array([k for k in (known(texts[i]),) if k >= 0], np.int64)
            return found
        finally:
            gc.enable()

    def totals(self, found: list[np.ndarray]) -> np.ndarray:
        """n_a, n_b, n_groups and n_links of each text, as columns."""
        numbers = np.frombuffer(self.numbers, np.int64).reshape(-1, 4) if self.numbers else np.zeros((0, 4), np.int64)
        return np.array([numbers[x].sum(axis=0) for x in found], np.int64).reshape(-1, 4)

    def digest(self, segments: np.ndarray) -> str:
        if not len(segments):
            return ""
        return hashlib.sha256(";".join(map(self.groups.__getitem__, segments.tolist())).encode()).hexdigest()

    def document_pairs(self, found: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, row, count) of the texts of a slice: each pair once per text."""
        if not any(map(len, found)):
            return (np.zeros(0, np.int64),) * 3
        used, at = np.unique(np.concatenate(found), return_inverse=True)
        doc = np.repeat(np.arange(len(found)), list(map(len, found)))
        both, times = np.unique(doc * len(used) + at, return_counts=True)
        doc, at = both // len(used), both % len(used)
        ends = np.frombuffer(self.ends, np.int64)
        starts = np.where(used > 0, ends[used - 1], 0)
        per = (ends[used] - starts)[at]
        place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(starts[at], per)
        keys, index = np.unique(np.frombuffer(self.pairs, np.int64)[place], return_inverse=True)
        # One number for (text, pair): there are fewer than 2^31 of either in a slice.
        both, counts = summed(np.repeat(doc, per) * len(keys) + index, np.repeat(times, per))
        return keys[both % len(keys)], rows[both // len(keys)], counts


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Spill:
    """Records of a task, given out as sorted runs per radix whenever there are many."""

    def __init__(self, task: int, radix: int, size_a: int):
        self.next_run, self.radix, self.size_a = task << ROW_BITS, radix, size_a
        self.pairs, self.rows, self.counts, self.held = [], [], [], 0

    def add(self, pairs: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
        self.pairs.append(pairs)
        self.rows.append(rows)
        self.counts.append(counts)
        self.held += len(pairs)
        if self.held >= SPILL:
            yield from self.give_out()

    def give_out(self) -> Iterator[dict]:
        if not self.held:
            return
        pairs, rows, counts = map(np.concatenate, (self.pairs, self.rows, self.counts))
        self.pairs, self.rows, self.counts, self.held = [], [], [], 0
        place = pairs // self.size_a % self.radix
        order = np.lexsort((rows, pairs, place))
        pairs, rows, counts, place = pairs[order], rows[order], counts[order], place[order]
        ends = np.searchsorted(place, np.arange(self.radix + 1))
        for r, a, b in zip(range(self.radix), ends, ends[1:], strict=False):
            if a == b:
                continue
            keys, sums = summed(pairs[a:b], counts[a:b])
            for kind, columns in (("docs", (pairs[a:b], rows[a:b], counts[a:b])), ("pairs", (keys, sums))):
                yield {"radix": r, "run": self.next_run, "kind": kind, "records": len(columns[0]), "data": pack(*columns)}
            self.next_run += 1


def encode(docs: DataFrame, path_a: str, path_b: str, key: str, text: str, radix: int) -> DataFrame:
    """Rows of two kinds: a document's own numbers, and runs of its task's records (``radix`` not null)."""
    schema = f"{DOC.format(kind=docs.schema[key].dataType.simpleString())}, {RUN}"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = _aligner(path_a, path_b), TaskContext.get().partitionId()
        spill, row = Spill(task, radix, aligner.size_a), task << ROW_BITS

        def given(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in arrow], names)

        kind = None
        for batch in batches:
            kind = kind or batch.schema.field(key).type
            long, string = pa.int64(), pa.string()
            types = [kind, long, long, long, long, string, long, pa.int32(), long, string, long, pa.binary()]
            arrow = [pa.field(n, t) for n, t in zip(names, types, strict=True)]
            for part in slices(batch, text, SLICE_BYTES):
                found = aligner.align(texts_of(part, text))
                rows = np.arange(row, row + len(found))
                row += len(found)
                totals = aligner.totals(found)
                own = {"doc_id": part.column(key), "row": pa.array(rows, long), "groups_sha256": pa.array(map(aligner.digest, found), string)}
                own |= {n: pa.array(totals[:, i], long) for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                yield given(own, len(found))
                for new in spill.add(*aligner.document_pairs(found, rows)):
                    yield given({k: pa.array([v], arrow[names.index(k)].type) for k, v in new.items()}, 1)
            release()
        for new in spill.give_out():
            yield given({k: pa.array([v], arrow[names.index(k)].type) for k, v in new.items()}, 1)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


# --- counting ---------------------------------------------------------------------------------


def _grouped(df: DataFrame, by: list[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, "kind", "run")


def _merged(runs: DataFrame, by: list[str], final: bool, size_a: int) -> DataFrame:
    """The runs of each group merged into one: (radix, run, kind, records, data).

    ``final`` adds to each pair whether its count is the largest of its second id, ties included; the
    pairs of one second id are held until the next one begins.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _groups(batches, by):
            blobs = [r["data"] for r in rows]
            for n, columns in enumerate(_maxima(merge(blobs), size_a) if final else _pieces(merge(blobs))):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group[0]], pa.int32()), pa.array([rows[0]["run"] + n], pa.int64()), pa.array(["counts" if final else "pairs"]),
                        pa.array([len(columns[0])], pa.int64()), pa.array([pack(*columns)], pa.binary()),
                    ],
                    ["radix", "run", "kind", "records", "data"],
                )
            release()

    return _grouped(runs, by).select(*by, "run", "data").mapInArrow(run, RUN)


def _groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of equal ``by``."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (group := tuple(r[c] for c in by)) != now:
                if rows:
                    yield now, rows
                now, rows = group, []
            rows.append(r)
    if rows:
        yield now, rows


def _pieces(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """One run: all blocks of a merge. It has no more pairs than two vocabularies leave to a radix."""
    held = list(blocks)
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _maxima(blocks: Iterator[tuple[np.ndarray, np.ndarray]], size_a: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(pair, count, 1 if the largest of its second id else 0), complete second ids at a time."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def best(keys, counts):
        side = keys // size_a
        first = np.flatnonzero(np.diff(side, prepend=-1))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(side)))
        return keys, counts, (counts == most).astype(np.int64)

    for k, c in blocks:
        keys, counts = np.concatenate([keys, k]), np.concatenate([counts, c])
        if len(keys) >= 4 * BLOCK and (ready := int(np.searchsorted(keys, keys[-1] // size_a * size_a))):
            yield best(keys[:ready], counts[:ready])
            keys, counts = keys[ready:], counts[ready:]
    if len(keys):
        yield best(keys, counts)


def count_pairs(runs: DataFrame, base: str, size_a: int, fan_in: int = FAN_IN) -> DataFrame:
    """Runs of kind ``counts``: every pair of the corpus with its count and whether that is its second id's largest.

    While a radix has more than ``fan_in`` runs, they are merged by ``fan_in`` in groups, so no task opens more
    at once; each round is a table in the shared folder. Only the largest number of runs of a radix comes to
    the driver.
    """
    spark, level = runs.sparkSession, 0
    runs = runs.where("kind = 'pairs'")
    while (most := runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0) > fan_in:
        groups = -(-most // fan_in)
        dealt = runs.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int"))
        _merged(dealt, ["radix", "part"], False, size_a).write.parquet(f"{base}/level-{level}")
        runs, level = spark.read.parquet(f"{base}/level-{level}"), level + 1
    _merged(runs, ["radix"], True, size_a).write.parquet(f"{base}/counts")
    return spark.read.parquet(f"{base}/counts")


def owed(runs: DataFrame, counts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(row, n_best, count_sum): what the pairs of each document add up to, by radix and part of the runs.

    The runs of a radix are dealt out to parts of about ``fan_in``; its counts go to each part, before the runs.
    """
    docs = runs.where("kind = 'docs'")
    parts = docs.groupBy("radix").agg(F.ceil(F.count(F.lit(1)) / fan_in).cast("int").alias("parts"))
    to = F.broadcast(parts)  # a row per radix
    dealt = docs.join(to, "radix").withColumn("part", F.pmod(F.xxhash64("run"), "parts").cast("int"))
    copies = counts.join(to, "radix").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["radix", "part", "kind", "run", "data"]
    both = dealt.select(columns).unionByName(copies.select(columns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (group := (r["radix"], r["part"])) != now:
                    now, held, table = group, [], None
                if r["kind"] == "counts":
                    held += unpack(r["data"], 3)
                    continue
                if table is None:
                    table, held = np.concatenate(held, axis=1), []
                    table = table[:, np.argsort(table[0])]
                yield contributions(r["data"], table)
        release()

    sums = _grouped(both, ["radix", "part"]).select("radix", "part", "kind", "data").mapInArrow(run, "row bigint, n_best bigint, count_sum bigint")
    return sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def contributions(data: bytes, table: np.ndarray) -> pa.RecordBatch:
    """(row, n_best, count_sum) of the documents of a run; whole numbers all the way."""
    pairs, rows, n = np.concatenate(list(unpack(data, 3)), axis=1)
    at = np.searchsorted(table[0], pairs)
    order = np.argsort(rows, kind="stable")
    rows, n, at = rows[order], n[order], at[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    best, total = np.add.reduceat(n * table[2][at], first), np.add.reduceat(n * table[1][at], first)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows[first], best, total)], ["row", "n_best", "count_sum"])


def align(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", radix: int = RADIX, fan_in: int = FAN_IN
) -> DataFrame:
    """Per document: tokens of both tokenizers, groups between common ends, links, and the corpus-wide weight of its links.

    ``path_a`` is a byte-level ``tokenizers`` file, ``path_b`` a sentencepiece model that every worker can open (or
    ones added with ``addFile``). The first encodes a blank and the text, the second the text. n_links counts
    pairs of tokens that overlap; a pair of ids counts how many links of the corpus it stands in.
    n_best are the links whose count is the largest of their second id, ties included; count_sum adds up the
    counts. groups_sha256 hashes ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and such as either tokenizer does not give back byte by byte, have no tokens:
    zeros and an empty hash. Repeated rows count each; null keys stay; other columns are ignored. ``radix``
    bounds the counts that a task holds: a radix has at most (second ids / radix) times (first ids) pairs.
    """
    spark: SparkSession = docs.sparkSession
    base = shared_dir(spark, "alignment")
    encode(docs, path_a, path_b, key, text, radix).write.parquet(f"{base}/encoded")
    encoded = spark.read.parquet(f"{base}/encoded")
    runs = encoded.where("radix IS NOT NULL").select("radix", "run", "kind", "records", "data")
    counts = count_pairs(runs, base, _vocabulary_size(path_a), fan_in)
    sums = owed(runs, counts, fan_in)
    own = encoded.where("radix IS NULL").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row")
    out = own.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select(F.col("doc_id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@functools.lru_cache(maxsize=2)
def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))).get_vocab_size()
