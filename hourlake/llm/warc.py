"""WARC archives of Zstandard frames, one per record, with the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from hourlake.llm.common import slices

#: Magic numbers of a frame, of the skippable frame that holds the dictionary, and of any skippable frame.
FRAME, DICTIONARY, SKIPPABLE, SKIP_MASK = 0xFD2FB528, 0x184D2A5D, 0x184D2A50, 0xFFFFFFF0
#: An empty skippable frame, all ASCII: Spark's text writer puts it after each row of an archive.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
#: Bytes of a trained dictionary, and payloads at an archive's start and bytes of each that it is trained on.
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 16 << 10, 200, 4 << 10
LEVEL = 3
#: The record's date; fixed, so that a repeated task writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP headers of the page but not its payload."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", "".join(uri.split())),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields.insert(2, ("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        fields.insert(3, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields), b"", b""])
    return head + block + CRLF + CRLF


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from the samples; from too few or too short ones, their bytes as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", html: str = "html", least: int = 0) -> None:
    """Write a record per row of ``pages`` to compressed archives below ``path``, one per task.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest key is written as a
    response and the others as revisits of it; smaller payloads are all responses. Null texts have an empty
    payload. Rows without a key are revisits of the largest key, or responses if no equal page has
    one; rows that repeat a key and payload are all responses. Each archive's dictionary is trained on the first
    pages of its task. Spark's own writer commits the files, so a lost task leaves none.
    """
    plain = pages.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    plain = plain.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least
    last = plain.where(large).groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = plain.join(last.select("digest", "last"), "digest", "left").select("id", "uri", "html", F.when(large, F.col("last")).alias("last"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = None
        for batch in batches:
            for part in slices(batch, "html"):
                out, pages = [], [(i, u, h.encode(), to) for i, u, h, to in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                if compress is None:
                    content = train_dictionary([p[:SAMPLE_BYTES] for _, _, p, _ in pages[:SAMPLES] if p])
                    out.append(struct.pack("<II", DICTIONARY, len(content)) + content)
                    options = {"level": LEVEL, "write_content_size": True, "write_checksum": True}
                    compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), **options)
                out += [compress.compress(record(i, u, p, to, to is not None and i != to)) for i, u, p, to in pages]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    frames = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", SEPARATOR).text(path)


def read_frames(data: bytes, chunk: int = 64 << 10) -> Iterator[bytes]:
    """The contents of an archive's frames, one at a time. The dictionary is in the leading skippable frame."""
    view, at, first, dictionary = memoryview(data), 0, True, None
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & SKIP_MASK == SKIPPABLE:
            if first and magic == DICTIONARY:
                content = bytes(view[at + 8 : at + 8 + size])
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
            at += 8 + size
            if at > len(view):
                raise ValueError("the archive ends within a frame")
        elif magic == FRAME:
            reader, parts, fed = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), [], at
            while not reader.eof:
                if fed >= len(view):
                    raise ValueError("the archive ends within a frame")
                parts.append(reader.decompress(view[fed : fed + chunk]))
                fed += min(chunk, len(view) - fed)
            at = fed - len(reader.unused_data)
            yield b"".join(parts)
        else:
            raise ValueError("neither a frame nor a skippable frame")
        first = False


def parse_record(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload), headers and lengths checked."""
    head, found, rest = data.partition(CRLF + CRLF)
    version, *lines = head.split(CRLF)
    if not found or not version.startswith(b"WARC/1."):
        raise ValueError("a record has no header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != CRLF + CRLF:
        raise ValueError("a record's length is not that of its header")
    if fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise ValueError("a record's block has another digest than its header")
    http, _, payload = block.partition(CRLF + CRLF)
    sizes = [x.split(b":")[1] for x in http.split(CRLF) if x.lower().startswith(b"content-length:")]
    n, digest, kind = int(sizes[0]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != n or digest_of(payload) != digest):
        raise ValueError("a payload is not what its headers say")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return number("warc-record-id"), n, digest, kind, number("warc-refers-to"), payload if kind == "response" else None


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def read_archives(spark, path: str, payload: bool = True) -> DataFrame:
    """A row per record of the archives below ``path``; damaged ones are an error. A revisit has no payload.

    An archive is a split of its own, as its dictionary is needed for every record.
    """
    names = NAMES if payload else NAMES[:-1]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for frame in read_frames(content.as_py()):
                    row = parse_record(frame)
                    rows.append(row)
                    size += len(row[-1] or b"") if payload else 100
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.mapInArrow(run, schema + ", payload binary" * payload)
