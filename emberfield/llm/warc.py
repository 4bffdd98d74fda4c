"""WARC archives of pages: whole-file gzip archives are normalised to one gzip member per record, with a sidecar offset index.

``write_archives`` decides which pages are responses and which revisit one of equal payload, and lets Spark's text writer
put the records into ``.gz`` files: one gzip stream a file, as many crawlers leave them. ``normalise`` inflates each stream once, in
pieces, and writes every record as a member of its own to a ``.warc.gz`` file; a line per record (offset, length, id, type,
target) goes to a sidecar beside it. ``read_archives`` needs the sidecars alone to plan: they are dealt by archive and span, so that a
large archive is read by many tasks, each seeking to its members.

A file is one task's work in ``normalise``, as a gzip stream has no other entry point; memory is bounded by pieces of
``STEP`` bytes, whatever the size of file or record. Files are written under a hidden name and moved when complete, so that
a lost or repeated attempt leaves the same files. Archives lie in a folder that all executors share; it is reached by ``pyarrow.fs``.

Defined results: null payloads are empty. Of records with equal payloads (SHA-1, length and XXH64) of at least ``least`` bytes
that with the smallest page id is the response, null ids last, then that with the smallest XXH64 of the url; rows that repeat its id and url
are responses like it. The others revisit it, and their records hold no payload. Null urls leave the target out, control characters in a url are
percent-encoded. No pages give no records. A stream that ends early or a record without its end raises ValueError with the
file's name. Extra columns of pages are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm.common import Batch

STEP = 1 << 20
#: Compression level of members.
LEVEL = 6
#: Equal payloads are dealt over so many keys.
SALTS = 64
#: Compressed bytes of archives that one task reads back.
SPAN = 32 << 20
CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string, target string"
RECORDS = (
    "record_id string, record_type string, target string, page_id bigint, payload_bytes bigint, payload_digest string, "
    "refers_to bigint, intact boolean, payload binary"
)
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*?)[ \t]*\r?$", re.M)
_PAGE = re.compile(r"<urn:page:(-?[0-9]+)>")


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of 40 hexadecimal digits, five of them (20 bits) to four letters at a time."""
    fours = [
        F.translate(F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0"), BASE32_HEX, BASE32) for i in range(8)
    ]
    return F.concat(*fours)


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, url, html)`` to page_id, url, payload, payload_bytes, digest (base 32), record_type and refers_to."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("payload")).select(
        "*",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.unhex(F.sha1(F.col("payload").cast("binary"))).alias("sha1"),
        F.xxhash64("payload").alias("check"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt"),
    )
    same = ["sha1", "payload_bytes", "check"]
    rank = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("page_id"), F.xxhash64("url").alias("url_hash"))
    parts = keyed.where(F.col("payload_bytes") >= least).groupBy(*same, "salt").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("part"))
    whole = parts.groupBy(*same).agg(F.sum("n").alias("n"), F.min("part").alias("first")).where("n > 1").drop("n")
    handed = parts.select(*same, "salt").join(whole, same)
    revisit = F.col("first").isNotNull() & (F.col("first") != rank)
    return keyed.join(handed, [*same, "salt"], "left").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        base32_of_hex(F.hex("sha1")).alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, _record_id(F.col("first.page_id"), F.col("first.url_hash"))).alias("refers"),
        _record_id(F.col("page_id"), F.xxhash64("url")).alias("record_id"),
    )


def _record_id(page_id: Column, url_hash: Column) -> Column:
    without = F.concat_ws(":", F.lit("none"), F.hex(url_hash), F.hex("check"))
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), without), F.lit(">"))


def _target(url: Column) -> Column:
    """The url with control characters percent-encoded, so that it stays on its line."""
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def record(decided: DataFrame, date: str = DATE) -> DataFrame:
    """Decided pages to ``value``: one WARC record each, without the two line ends that close it."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(CRLF),
    )
    clean = F.when(F.col("url").rlike("[\\x00-\\x1F\\x7F]"), _target(F.col("url"))).otherwise(F.col("url"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Refers-To", F.col("refers")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    return decided.select(head.alias("head"), block.alias("block")).select(
        F.concat("head", line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), "block").alias("value")
    )


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = DATE) -> None:
    """One record per page in gzip files of one stream each, by Spark's own writer and its commit."""
    writer = record(decide(pages, least), date).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    writer.text(folder)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


class Inflated:
    """Records of a gzip stream (or of several after each other), inflated in pieces as they are asked for."""

    def __init__(self, chunks: Iterator[bytes], name: str) -> None:
        self.chunks, self.name = chunks, name
        self.engine, self.left, self.full = None, b"", False
        self.buffer, self.at = b"", 0

    def _more(self) -> bool:
        while True:
            if not self.left and not self.full:
                self.left = next(self.chunks, b"")
                if not self.left:
                    if self.engine is not None:
                        raise ValueError(f"{self.name} ends inside a gzip stream")
                    return False
            if self.engine is None:
                self.engine = zlib.decompressobj(31)
            made = self.engine.decompress(self.left, STEP)
            self.left, self.full = self.engine.unconsumed_tail, len(made) == STEP
            if self.engine.eof:
                self.left, self.full, self.engine = self.engine.unused_data, False, None
            if made:
                self.buffer, self.at = self.buffer[self.at :] + made, 0
                return True

    def head(self) -> bytes | None:
        """Up to the next empty line, with it; None at the end."""
        seen = self.at
        while (end := self.buffer.find(b"\r\n\r\n", seen)) < 0:
            behind = max(len(self.buffer) - self.at - 3, 0)
            if not self._more():
                if len(self.buffer) > self.at:
                    raise ValueError(f"{self.name} ends inside a header")
                return None
            seen = self.at + behind
        own, self.at = self.buffer[self.at : end + 4], end + 4
        return own

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if self.at == len(self.buffer) and not self._more():
                raise ValueError(f"{self.name} ends inside a record")
            own = self.buffer[self.at : self.at + min(size, STEP)]
            self.at += len(own)
            size -= len(own)
            yield own

    def close_record(self) -> None:
        if b"".join(self.body(4)) != b"\r\n\r\n":
            raise ValueError(f"{self.name} holds a record without its end")


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head)}


def _length(head: dict[str, str], name: str) -> int:
    size = head.get("content-length", "")
    if not size.isdigit():
        raise ValueError(f"{name} holds a record without a length")
    return int(size)


def _chunks(source) -> Iterator[bytes]:
    while piece := source.read(STEP):
        yield piece


def normalise_file(source: str, target: str) -> Iterator[dict]:
    """Rewrite one archive; gives the rows of its index as the members are written."""
    store, path = _store(source)
    to, place = _store(target)
    folder, name = place.rsplit("/", 1)
    to.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    offset = 0
    with store.open_input_stream(path, compression=None) as raw, to.open_output_stream(hidden, compression=None) as out:
        with to.open_output_stream(hidden + ".idx", compression=None) as side:
            stream = Inflated(_chunks(raw), source)
            while (head := stream.head()) is not None:
                known = fields(head)
                member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                size = out.write(member.compress(head))
                for piece in stream.body(_length(known, source)):
                    size += out.write(member.compress(piece))
                stream.close_record()
                size += out.write(member.compress(b"\r\n\r\n") + member.flush())
                row = {
                    "archive": target,
                    "offset": offset,
                    "length": size,
                    "record_id": known.get("warc-record-id"),
                    "record_type": known.get("warc-type"),
                    "target": known.get("warc-target-uri"),
                }
                side.write(json.dumps(row).encode() + b"\n")
                yield row
                offset += size
    to.move(hidden, place)
    to.move(hidden + ".idx", place + ".idx")


def _exists(path: str) -> bool:
    store, place = _store(path)
    return store.get_file_info(place).type == pyarrow.fs.FileType.File


def settle_file(path: str, folder: str, consume: bool) -> int:
    """Normalise one archive into a folder; gives its number of records. An attempt after one that consumed the file counts its sidecar."""
    name = path.rsplit("/", 1)[1].removesuffix(".gz").removesuffix(".txt").removesuffix(".warc")
    made = f"{folder}/{name}.warc.gz"
    if consume and not _exists(path) and _exists(made + ".idx"):
        store, place = _store(made + ".idx")
        with store.open_input_stream(place, compression=None) as side:
            return sum(piece.count(b"\n") for piece in _chunks(side))
    count = sum(1 for _ in normalise_file(path, made))
    if consume:
        store, place = _store(path)
        store.delete_file(place)
    return count


def normalise(spark: SparkSession, source: str, target: str, consume: bool = False) -> int:
    """Every ``.gz`` file of a folder to ``.warc.gz`` and ``.warc.gz.idx`` in another; gives the number of records.

    With ``consume`` a file is deleted once its archive and sidecar are in place. The names of the files are all that the driver sees.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).inputFiles()
    paths = [unquote(p) for p in listed]
    if not paths:
        return 0

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield Batch.from_pydict({"n": [settle_file(paths[i], target, consume)]})

    return spark.range(0, len(paths), 1, len(paths)).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars of all archives of a folder."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


class _Archive:
    """Members of one archive at rising offsets; near ones are read together."""

    def __init__(self, path: str) -> None:
        self.path = path
        store, place = _store(path)
        self.file = store.open_input_file(place)
        self.start, self.window = 0, b""

    def member(self, offset: int, length: int) -> Iterator[bytes]:
        if length > STEP:
            for at in range(offset, offset + length, STEP):
                yield self.file.read_at(min(STEP, offset + length - at), at)
            return
        if not self.start <= offset <= offset + length <= self.start + len(self.window):
            self.start, self.window = offset, self.file.read_at(max(length, STEP), offset)
        yield self.window[offset - self.start : offset - self.start + length]


def read_member(chunks: Iterator[bytes], name: str, payloads: bool = True) -> dict:
    """One record of its own gzip member. A revisit has the digest and the length its headers tell of the full payload."""
    stream = Inflated(chunks, name)
    known = fields(stream.head() or b"")
    size = _length(known, name)
    told = known.get("warc-payload-digest", "").removeprefix("sha1:")
    hashed, kept, length = hashlib.sha1(), [], size
    web = known.get("content-type", "").replace(" ", "").startswith("application/http")
    if web:
        http = stream.head() or b""
        size -= len(http)
        length = int(fields(http).get("content-length", size))
    for piece in stream.body(size):
        hashed.update(piece)
        if payloads:
            kept.append(piece)
    stream.close_record()
    revisit = known.get("warc-type") == "revisit"
    found = base64.b32encode(hashed.digest()).decode()
    page = _PAGE.fullmatch(known.get("warc-record-id", ""))
    refers = _PAGE.fullmatch(known.get("warc-refers-to", ""))
    return {
        "record_id": known.get("warc-record-id"),
        "record_type": known.get("warc-type"),
        "target": known.get("warc-target-uri"),
        "page_id": int(page[1]) if page else None,
        "payload_bytes": length if revisit else size,
        "payload_digest": told if revisit else found,
        "refers_to": int(refers[1]) if refers else None,
        "intact": None if revisit or not told else told == found,
        "payload": b"".join(kept) if payloads and not revisit else None,
    }


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the normalised archives of a folder, found by their sidecars; without payloads on request.

    ``intact`` tells whether a payload has the digest of its header (null where there is none, or no payload).
    """
    index = read_index(spark, folder)
    total = index.agg(F.sum("length")).first()[0] or 0
    schema = pa.schema(
        [
            *((n, pa.string()) for n in ("record_id", "record_type", "target")),
            ("page_id", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("refers_to", pa.int64()),
            ("intact", pa.bool_()),
            ("payload", pa.binary()),
        ]
    )

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        archive = None
        for batch in batches:
            rows, size = [], 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None or archive.path != path:
                    archive = _Archive(path)
                rows.append(read_member(archive.member(offset, length), path, payloads))
                size += len(rows[-1]["payload"] or b"")
                if size > 8 * STEP:
                    yield Batch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield Batch.from_pylist(rows, schema)

    parts = index.select("archive", "offset", "length").repartition(
        max(1, -(-total // SPAN)), "archive", F.floor(F.col("offset") / SPAN)
    )
    return parts.sortWithinPartitions("archive", "offset").mapInArrow(run, RECORDS)
