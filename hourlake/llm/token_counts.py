"""Token counts with the tokenizer library, lengths only."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterable

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from hourlake.llm.common import map_texts, texts_of
from hourlake.llm.segments import segments

#: Bytes of distinct pieces that go to the library at once, and pieces remembered by a task.
BATCH_BYTES, REMEMBERED = 256 << 10, 300_000


@functools.lru_cache(maxsize=2)
def _library(path: str):
    """(lengths of many texts, whether texts may be cut at safe places)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])) for t in spec["added_tokens"])
    safe = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain
    return (lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]), safe


def balanced(pieces: Iterable[str], limit: int = BATCH_BYTES):
    """Lists of pieces of about equal bytes."""
    batch, size = [], 0
    for p in pieces:
        batch.append(p)
        size += len(p) + 16
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit of every whole text.

    ``path`` is a tokenizers ``.json`` or sentencepiece ``.model`` file that exists on every worker
    (or was added with ``addFile``). No special tokens are added; their strings in a text are treated
    as the library does by default. Texts are cut at safe boundaries where the model has such,
    repeated pieces are encoded once, and the distinct pieces go to the library in batches of equal
    bytes. Null and empty texts have 0 tokens; repeated rows are counted each; other columns are ignored.
    """

    def make():
        lengths, safe = _library(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        known: dict[str, int] = {}

        def step(part: pa.RecordBatch) -> dict:
            texts = texts_of(part, text)
            cut = [segments(t) if safe else [t] for t in texts]
            if len(known) > REMEMBERED:
                known.clear()
            for batch in balanced({p for pieces in cut for p in pieces} - known.keys()):
                known.update(zip(batch, lengths(batch), strict=True))
            n_tokens = [sum(map(known.__getitem__, pieces)) for pieces in cut]
            return {
                key: part.column(key),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
            }

        return step

    kind = docs.schema[key].dataType.simpleString()
    out = map_texts(docs.select(key, text), make, f"{key} {kind}, n_bytes bigint, n_tokens bigint", text)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
