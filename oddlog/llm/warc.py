"""Web archives (WARC 1.1) compressed record by record with Zstandard and a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; one frame per record follows. ``write`` makes such
files through Spark's own text sink: a row is a frame, and the separator between rows is an empty skippable frame, so the
files are valid archives in any file system that Spark can write. ``read`` takes any such files, with or without a
dictionary, decodes them piece by piece, one record at a time, and validates version, headers, lengths and digests.

A record whose frame is sound but whose content is not gives a row with ``problem``; reading goes on behind it. Damage to
the frames themselves gives one row with ``problem`` for the rest of the archive. Nothing is dropped silently.

Of pages with equal payloads of at least ``LEAST`` bytes the one with the largest id is a ``response``, the others are
``revisit`` records without payload that refer to it. Rows that repeat that id and payload are responses too; rows without
an id revisit the largest one, or are responses if no row of the payload has an id. A null or empty text is a payload of 0
bytes, a null address has no header, control characters and spaces of an address are percent-encoded. A payload is held
in memory whole, an archive's compressed bytes once. Other columns of the pages are ignored. An empty table gives an empty
archive, which has no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddlog.session import join_side

from .common import batch, text_batches

LEAST = 1000  # bytes from which equal payloads are written once
RECORDS = 10_000  # of an archive
SAMPLE_ROWS, SAMPLE_CHARS = 500, 8192  # what a dictionary is trained on
DICTIONARY_BYTES = 32768
LEVEL = 3
PIECE = 1 << 16  # bytes of an archive decoded at once
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
FRAME = 0xFD2FB528
SKIPPABLE = 0x184D2A50  # to 0x184D2A5F
DICTIONARY = 0x184D2A5D
END = b"\r\n\r\n"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
NAMED = "<urn:page:{}>"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

KINDS = {
    "archive": pa.string(),
    "record_id": pa.string(),
    "record_type": pa.string(),
    "target_uri": pa.string(),
    "refers_to": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "payload": pa.binary(),
    "problem": pa.string(),
}
SCHEMA = "archive string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"


def skippable(magic: int, content: bytes = b"") -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


SEPARATOR = skippable(SKIPPABLE).decode("ascii")


def trained(samples: list[bytes]) -> bytes:
    """A dictionary for payloads like ``samples``; empty if these are too few or too short."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    return skippable(DICTIONARY, zstandard.compress(dictionary)) if dictionary else skippable(SKIPPABLE)


def record(name: str, uri: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record; with ``refers_to`` a revisit, which keeps the length and digest of its payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = http + (b"" if refers_to else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {uri}"] if uri is not None else []),
        *([f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT}"] if refers_to else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + END + block + END


def encoded_uri(uri: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", uri)


class Malformed(ValueError):
    """What is wrong with a record or an archive."""


def headers(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Malformed("a header without a name")
        if found.setdefault(key := name.decode("utf-8", "replace").strip().lower(), text := value.decode("utf-8", "replace").strip()) != text:
            raise Malformed(f"two values of {key}")
    return found


def length(value: str) -> int:
    if not re.fullmatch("[0-9]+", value):
        raise Malformed("a length that is no number")
    return int(value)


def parsed(data: bytes) -> dict:
    """The columns of one record, all of its headers and lengths checked; raises ``Malformed``."""
    head, gap, rest = data.partition(END)
    version, *lines = head.split(b"\r\n")
    if version not in VERSIONS or not gap:
        raise Malformed("no version line or no end of headers")
    found = headers(lines)
    if missing := [name for name in REQUIRED if not found.get(name)]:
        raise Malformed(f"no {missing[0]}")
    size = length(found["content-length"])
    if len(rest) != size + len(END) or not rest.endswith(END):
        raise Malformed("the block is not as long as its header says")
    kind, block = found["warc-type"], rest[:size]
    payload: bytes | None = block
    stated = size
    if found.get("content-type", "").startswith("application/http"):
        top, gap, payload = block.partition(END)
        status, *lines = top.split(b"\r\n")
        if not status.startswith(b"HTTP/") or not gap:
            raise Malformed("no HTTP header in the block")
        stated = length(headers(lines).get("content-length", str(len(payload))))
    if kind == "revisit":
        if not found.get("warc-refers-to"):
            raise Malformed("a revisit that refers to nothing")
        if payload:
            raise Malformed("a revisit with a payload")
        payload = None
    elif stated != len(payload):
        raise Malformed("the payload is not as long as its header says")
    digest = None if payload is None else hashlib.sha1(payload).digest()
    if named := found.get("warc-payload-digest"):
        method, _, value = named.partition(":")
        try:
            told = base64.b32decode(value) if method == "sha1" else None
        except ValueError:
            raise Malformed("a digest that cannot be read") from None
        if told and digest and told != digest:
            raise Malformed("the payload's digest is another one")
        digest = digest or told
    return {
        "record_id": found["warc-record-id"],
        "record_type": kind,
        "target_uri": found.get("warc-target-uri"),
        "refers_to": found.get("warc-refers-to"),
        "payload_bytes": stated,
        "payload_digest": digest and digest.hex(),
        "payload": payload,
    }


class Frames:
    """The decoded record frames of one archive, which is fed piece by piece."""

    def __init__(self):
        self.rest = b""
        self.skip = 0
        self.begun = False
        self.reader = zstandard.ZstdDecompressor()
        self.frame = None
        self.parts: list[bytes] = []

    def lead(self, magic: int, size: int) -> bool:
        """Whether the whole of the leading dictionary frame, if that is what comes, has arrived."""
        if self.begun or magic != DICTIONARY:
            self.rest, self.skip = self.rest[8:], size
            return True
        if len(self.rest) < 8 + size:
            return False
        content, self.rest = self.rest[8 : 8 + size], self.rest[8 + size :]
        if content[:4] == FRAME.to_bytes(4, "little"):
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        return True

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.rest += piece
        while self.rest:
            if self.skip:
                gone = min(self.skip, len(self.rest))
                self.rest, self.skip = self.rest[gone:], self.skip - gone
            elif self.frame:
                try:
                    self.parts.append(self.frame.decompress(self.rest))
                except zstandard.ZstdError as wrong:
                    raise Malformed(f"a frame that cannot be decoded: {wrong}") from None
                self.rest = self.frame.unused_data
                if self.frame.eof:
                    yield b"".join(self.parts)
                    self.frame, self.parts = None, []
            else:
                magic = int.from_bytes(self.rest[:4], "little")
                if len(self.rest) < 4:
                    return
                if magic == FRAME:
                    self.frame = self.reader.decompressobj()
                elif magic & ~15 != SKIPPABLE:
                    raise Malformed("neither a frame nor a skippable one")
                elif len(self.rest) < 8 or not self.lead(magic, int.from_bytes(self.rest[4:8], "little")):
                    return
                self.begun = True

    def close(self) -> None:
        if self.rest or self.skip or self.frame:
            raise Malformed("the archive ends inside a frame")


def decoded(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Records of archives, whose pieces (path, last, piece) come in order."""
    frames, broken = Frames(), False
    for pieces in batches:
        rows: list[dict] = []
        for path, last, piece in zip(*(column.to_pylist() for column in pieces.columns)):
            try:
                for data in () if broken else frames.feed(piece):
                    try:
                        row = parsed(data)
                        rows.append({"archive": path, **row, "payload": row["payload"] if payloads else None})
                    except Malformed as wrong:
                        rows.append({"archive": path, "problem": str(wrong)})
                if last and not broken:
                    frames.close()
            except Malformed as wrong:
                rows.append({"archive": path, "problem": str(wrong)})
                broken = True  # the rest of this archive cannot be read
            if last:
                frames, broken = Frames(), False
        yield batch(KINDS, [[row.get(name) for row in rows] for name in KINDS])


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives at ``path``; revisits have the length and digest of the payload they refer to."""
    files = text_batches(spark).read.format("binaryFile").load(path).where("length > 0")
    count = F.expr(f"cast((length - 1) div {PIECE} as int)")
    cut = F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(F.col("content"), i * PIECE + 1, F.lit(PIECE)))
    pieces = files.select("path", count.alias("n"), F.posexplode(cut).alias("at", "piece"))
    ordered = pieces.select("path", (F.col("at") == F.col("n")).alias("last"), "piece")
    return ordered.mapInArrow(lambda batches: decoded(batches, payloads), SCHEMA)


def deduplicated(pages: DataFrame) -> DataFrame:
    """``pages`` (id, uri, payload) with ``original``: the id that a page revisits, null for responses.

    Payloads are compared by digest: counted per digest, and only digests that occur twice are joined back.
    """
    size = F.octet_length("payload")
    keyed = pages.withColumn("key", F.unhex(F.sha2("payload", 256)))
    groups = keyed.where(size >= LEAST).groupBy("key").agg(F.max("id").alias("largest"), F.count("*").alias("n"))
    twice = join_side(groups.where("n > 1 and largest is not null").select("key", "largest"), "payloads")
    original = F.when(F.col("id").isNull() | (F.col("id") != F.col("largest")), F.col("largest"))
    return keyed.join(twice, "key", "left").select("id", "uri", "payload", original.alias("original"))


def name_of(page: object) -> str:
    return NAMED.format("" if page is None else page)


def framed(batches: Iterator[pa.RecordBatch], dictionary: bytes, records: int, date: str) -> Iterator[pa.RecordBatch]:
    """A frame per page, and before every ``records`` of them the frame that an archive begins with."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
    lead, written = leading_frame(dictionary), 0
    for rows in batches:
        frames = []
        for page, uri, payload, original in zip(*(column.to_pylist() for column in rows.columns)):
            if written % records == 0:
                frames.append(lead)
            uri = None if uri is None else encoded_uri(uri)
            refers = None if original is None else name_of(original)
            frames.append(writer.compress(record(name_of(page), uri, payload.encode(), refers, date)))
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    text_col: str = "html",
    records: int = RECORDS,
    date: str = DATE,
) -> None:
    """Write a record per row to archives of at most ``records`` records in the folder ``path``.

    The dictionary is trained on the beginnings of ``SAMPLE_ROWS`` payloads; it decides about size only.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).alias("payload")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), payload)
    samples = rows.select(F.substring("payload", 1, SAMPLE_CHARS)).limit(SAMPLE_ROWS).collect()
    dictionary = trained([row[0].encode() for row in samples if row[0]])
    text_batches(pages.sparkSession)
    frames = deduplicated(rows).mapInArrow(lambda batches: framed(batches, dictionary, records, date), "frame binary")
    sink = frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("compression", "none")
    sink.option("maxRecordsPerFile", records + 1).text(path)


def page_of(name: Column) -> Column:
    """The id in a record's name, null if it has none."""
    return F.nullif(F.regexp_extract(name, "^<urn:page:(.*)>$", 1), F.lit(""))
