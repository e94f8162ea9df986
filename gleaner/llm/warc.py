"""WARC files: a writer, and a reader that splits files into blocks.

A block of a file starts anywhere, and the magic of a record may also stand
inside a payload.  So each task lists every place of its block where a record
header can be parsed, with the offset of the record that would follow; only
places that are reached from the start of the file are records.  Inside a block
the chains are contracted to where they leave it; between blocks pointer jumping
doubles the hop in every round, so that the number of rounds is the logarithm of
the number of blocks in the longest file.  Payloads are read last, for reachable
records only, and are never shuffled.

Files are opened by URI through pyarrow's file systems.  Files of gzip members,
one a record, are read the same way: a candidate is a place where a member with a
record header starts, and its successor is where the member ends.

Nulls, empties and breaks: a NULL payload is marked in the header and read back as NULL, an empty
one as empty; NULL page_id and url have no header line.  A url with line breaks
or blanks at its ends is percent-encoded, and marked so.  A record that runs past the end of its file
is dropped, and so is what follows a break of the chain.  Repeated rows are
repeated records, very long payloads are read in one piece, columns of ``pages``
other than page_id, url and html are ignored.  An empty file or folder has no
records.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import cut, lean

BLOCK = 4 << 20
HEAD = 1 << 16
MAGIC = b"WARC/1."
END = b"\r\n\r\n"
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d{1,18})[ \t]*$", re.I | re.M)
_PAGE = re.compile(rb"^warc-record-id:[ \t]*<urn:page:(-?\d{1,19})>[ \t]*$", re.I | re.M)
_URL = re.compile(rb"^warc-target-uri:[ \t]*(.*?)[ \t]*$", re.I | re.M)
_ESCAPED = re.compile(rb"^x-escaped-uri:", re.I | re.M)
_NO_PAYLOAD = re.compile(rb"^x-no-payload:", re.I | re.M)


def write_warc(pages: DataFrame, folder: str) -> None:
    """One record a row of ``pages`` (page_id, url, html), a file a partition."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    odd = F.col("url").rlike("[\\r\\n]|^[ \\t]|[ \\t]$")
    escaped = F.col("url")
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    body = F.coalesce(F.col("html"), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.when(odd, escaped).otherwise(F.col("url"))),
        F.when(odd, "X-Escaped-URI: true\r\n").otherwise(""),
        F.lit("Content-Type: text/html\r\n"),
        F.when(F.col("html").isNull(), "X-No-Payload: true\r\n").otherwise(""),
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
    )
    pages.select(record.alias("value")).write.option("lineSep", END.decode()).text(folder)


class _Files:
    """Open files of a task, by URI."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def read(self, path: str, at: int, size: int) -> bytes:
        if path != self.path:
            system, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
            self.path, self.file = path, system.open_input_file(inner)
        return self.file.read_at(size, at)


def parse_header(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The header block at ``at`` and the offset after it; None if none is there or it is cut off."""
    stop = data.find(END, at)
    if stop < 0 or not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        return None
    return data[at:stop].replace(b"\r\n", b"\n"), stop + 4


def candidates(read, path: str, start: int, block: int, length: int) -> list[tuple[int, int, int]]:
    """(record start, payload start, next record) for every parsable header that starts in the block."""
    data = read(path, start, min(block + HEAD, length - start))
    out, at = [], data.find(MAGIC)
    while 0 <= at < block:
        size = HEAD
        while (found := parse_header(data, at)) is None and start + len(data) < length and data.find(END, at) < 0:
            size *= 2  # a header that is longer than what was read
            data += read(path, start + len(data), min(size, length - start - len(data)))
        if found and (n := _LENGTH.search(found[0])):
            follow = start + found[1] + int(n[1]) + 4
            if follow <= length:
                out.append((start + at, start + found[1], follow))
        at = data.find(MAGIC, at + 1)
    return out


GZIP = b"\x1f\x8b\x08"


def zipped_candidates(read, path: str, start: int, block: int, length: int) -> list[tuple[int, int, int]]:
    """``candidates`` for a file of gzip members: (member start, member start, next member)."""
    data = read(path, start, min(block + len(GZIP), length - start))
    out, at = [], data.find(GZIP)
    while 0 <= at < block:
        unzip, here, head = zlib.decompressobj(31), start + at, b""
        piece = data[at : at + HEAD]
        try:
            while piece and not unzip.eof:
                got = unzip.decompress(piece)
                if len(head) < len(MAGIC):
                    head += got[: len(MAGIC)]
                    if not MAGIC.startswith(head[: len(MAGIC)]):
                        break
                here += len(piece)
                piece = read(path, here, min(1 << 20, length - here)) if not unzip.eof else b""
        except zlib.error:
            pass
        if unzip.eof and head.startswith(MAGIC):
            out.append((start + at, start + at, here - len(unzip.unused_data)))
        at = data.find(GZIP, at + 1)
    return out


def _exits(found: list[tuple[int, int, int]]) -> list[int]:
    """Where the chain from each candidate leaves the block."""
    out: dict[int, int] = {}
    for start, _, follow in reversed(found):
        out[start] = out.get(follow, follow)
    return [out[start] for start, _, _ in found]


def _candidate_batches(block: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for b in batches:
            for path, length, at in zip(*(b.column(c).to_pylist() for c in ("path", "length", "at"))):
                zipped = files.read(path, 0, len(GZIP)) == GZIP
                found = (zipped_candidates if zipped else candidates)(files.read, path, at, block, length)
                n = len(found)
                cols = list(zip(*found)) if n else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array([at] * n, pa.int64()), *(pa.array(c, pa.int64()) for c in cols), pa.array(_exits(found), pa.int64())],
                    names=["path", "block", "start", "body", "follow", "leaves"],
                )

    return run


def _payload_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks each block from its entry and reads the records."""
    files, due = _Files(), None
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("path", "block", "start", "body", "follow", "entry")))
        out, held = [], 0
        for path, block, start, body, follow, entry in rows:
            if not (entry or due == (path, block, start)):
                continue
            due = (path, block, follow)
            raw = files.read(path, start, follow - start)
            if raw.startswith(GZIP):
                raw = zlib.decompress(raw, 31)
                parsed = parse_header(raw, 0)
                size = parsed and _LENGTH.search(parsed[0])
                if not size or parsed[1] + int(size[1]) > len(raw):
                    continue
                raw, body = raw[: parsed[1] + int(size[1])] + END, start + parsed[1]
            head = raw[: body - start].replace(b"\r\n", b"\n")
            page, url = _PAGE.search(head), _URL.search(head)
            html = None if _NO_PAYLOAD.search(head) else raw[body - start : -4].decode("utf-8", "replace")
            link = url[1].decode("utf-8", "replace") if url else None
            if link and _ESCAPED.search(head):
                link = unquote(link)
            out.append((path, start, follow - start, int(page[1]) if page else None, link, html))
            held += len(raw)
            if held > 16 << 20:
                yield _records(out)
                out, held = [], 0
        if out:
            yield _records(out)


_RECORD = "path string, offset long, size long, page_id long, url string, html string"


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def reachable(found: DataFrame) -> DataFrame:
    """(path, start): the candidates at which the chain from the start of a file enters a block."""
    jump = cut(found.select("path", F.col("start").alias("a"), F.col("leaves").alias("b")))
    reach = cut(found.where("start = 0").select("path", "start").distinct())
    n = reach.count()
    while n:
        step = reach.join(jump, (reach["path"] == jump["path"]) & (reach["start"] == jump["a"])).select(reach["path"], F.col("b").alias("start"))
        reach = cut(reach.unionByName(step).distinct())
        more = reach.count()
        if more == n:
            break
        n = more
        on = jump.select(F.col("path").alias("p"), F.col("a").alias("b2"), F.col("b").alias("c"))
        jump = cut(jump.join(on, (F.col("path") == F.col("p")) & (F.col("b") == F.col("b2"))).select("path", "a", F.col("c").alias("b")))
    return reach


def read_warc(spark: SparkSession, folder: str, block: int = BLOCK, glob: str = "*") -> DataFrame:
    """(path, offset, size, page_id, url, html): the records of all files of a folder."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    files = cut(listed.where("length > 0").select("path", "length"))
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("at"))
    tasks = max(1, files.agg(F.sum(F.ceil(F.col("length") / block))).first()[0] or 1)
    tasks = min(int(tasks), 20_000)
    found = cut(blocks.repartition(tasks).mapInArrow(lean(_candidate_batches(block)), "path string, block long, start long, body long, follow long, leaves long"))
    entries = reachable(found).withColumn("entry", F.lit(True))
    marked = found.join(entries, ["path", "start"], "left").select("path", "block", "start", "body", "follow", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.repartition(tasks, "path", "block").sortWithinPartitions("path", "block", "start").mapInArrow(lean(_payload_batches), _RECORD)
