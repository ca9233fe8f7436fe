import base64
import glob
import hashlib
import os
import random

import pyarrow as pa
import pytest
import zstandard

from oddlog.llm import warc
from oddlog.llm.queries import QUERIES
from oddlog.session import new_path

SCHEMA = "page_id long, url string, html string, payload string, frame int"


def read_by_hand(data):
    """Headers and blocks of an archive, by the library's own reader."""
    dictionary = None
    if data[:4] == (0x184D2A5D).to_bytes(4, "little"):
        size = int.from_bytes(data[4:8], "little")
        dictionary, data = zstandard.decompress(data[8 : 8 + size]), data[8 + size :]
    reader = zstandard.ZstdDecompressor(dict_data=dictionary and zstandard.ZstdCompressionDict(dictionary))
    out = []
    while data:
        if data[:4] == (0x184D2A50).to_bytes(4, "little"):
            data = data[8:]
            continue
        frame = reader.decompressobj()
        text = frame.decompress(data)
        data = frame.unused_data
        head, rest = text.split(b"\r\n\r\n", 1)
        out.append((head.decode().split("\r\n"), rest[:-4]))
    return out


def brute(rows):
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        known = [p for p in groups[html or ""] if p is not None]
        original = max(known) if len(data) >= 1000 and known else None
        again = original is not None and page != original
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", original if again else None))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(5)
    long = ["".join(rng.choice("ab é\r\n<p>") for _ in range(1200)) for _ in range(5)]
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<html><body><p>text {i}" * rng.randint(1, 200) + "</p>") for i in range(100)]
    rows += [(200 + i, None, long[i % 5]) for i in range(40)]
    rows += [(300 + i, "http://a b\r\nX: y", "short") for i in range(3)]  # equal, but short
    rows += [(400, "", None), (401, "x", ""), (None, None, None), (None, "x", long[0]), (240, "x", long[0]), (240, "x", long[0])]
    rows += [(None, "x", "n" * 1000), (None, "y", "n" * 1000), (500, "x", "é" * 500), (501, "x", "é" * 500), (502, "x", "é" * 499 + "a")]
    rows += [(600, "x", "P*M\x18\x00\x00\x00\x00\r\n\r\n" * 200), (601, "x", "long " * 400_000)]
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "extra", 1) for r in sample()], SCHEMA)


def test_query_equals_a_plain_version(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, QUERIES["op12_warc"](spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(sample())


def test_files_are_archives_with_a_dictionary_and_a_frame_per_record(spark, pages):
    path = new_path(spark, "t-warc")
    warc.write(pages.coalesce(2), path, records=30)
    names, count = glob.glob(f"{path}/part-*"), 0
    assert len(names) >= 5
    for name in names:
        with open(name, "rb") as file:
            data = file.read()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
        records = read_by_hand(data)
        assert 0 < len(records) <= 30
        count += len(records)
        for head, block in records:
            assert head[0] == "WARC/1.1" and f"Content-Length: {len(block)}" in head
    assert count == len(sample())


def test_texts_come_back_whole(spark, pages):
    path = new_path(spark, "t-warc")
    warc.write(pages, path)
    rows = warc.read(spark, path).collect()
    assert all(r.problem is None for r in rows)
    by_name = {(r.record_id, r.payload_digest): r for r in rows if r.record_type == "response"}
    for page, url, html in sample():
        found = [r for r in rows if r.record_id == warc.name_of(page) and r.payload_digest == hashlib.sha1((html or "").encode()).hexdigest()]
        assert found
        for r in found:
            whole = r if r.record_type == "response" else by_name[(r.refers_to, r.payload_digest)]
            assert bytes(whole.payload).decode() == (html or "") and (r.payload is None) == (r.record_type == "revisit")
    assert {r.target_uri for r in rows if r.record_id == "<urn:page:300>"} == {"http://a%20b%0D%0AX:%20y"}


def good(payload=b"<p>x", **other):
    return warc.record("<urn:page:7>", "http://x/", payload, None)


def frames(*records, dictionary=b""):
    return (warc.leading_frame(dictionary) if dictionary else b"") + b"".join(zstandard.compress(r) for r in records)


def asked(data, size):
    pieces = [data[i : i + size] for i in range(0, len(data), size)]
    columns = [["f"] * len(pieces), [i == len(pieces) - 1 for i in range(len(pieces))], pieces]
    arrays = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["path", "last", "piece"])
    return [row for out in warc.decoded(iter([arrays]), True) for row in out.to_pylist()]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_pieces_of_any_size(size):
    data = warc.skippable(0x184D2A53, b"skipped") + frames(good(), good(b"y" * 900)) + warc.skippable(0x184D2A5D, b"late") + frames(good(b""))
    assert [r["payload"] for r in asked(data, size)] == [b"<p>x", b"y" * 900, b""]


@pytest.mark.parametrize(
    "old, new, problem",
    [
        (b"WARC/1.1", b"WARC/9.9", "version"),
        (b"WARC-Date", b"WARC-Tade", "warc-date"),
        (b"Content-Length: 4\r\n", b"Content-Length: 5\r\n", "payload is not as long"),
        (b"Content-Length: 4\r\n", b"Content-Length: x\r\n", "no number"),
        (b"sha1:", b"sha1:A", "digest"),
        (b"<p>x", b"<p>xx", "block is not as long"),
        (b"<p>x", b"<p>y", "another one"),
        (b"HTTP/1.1", b"PTTH/1.1", "HTTP header"),
        (b"WARC-Type: response", b"WARC-Type: revisit", "refers to nothing"),
        (b"WARC-Target-URI: http://x/", b"WARC-Type: request", "two values"),
        (b"WARC-Target-URI: http://x/", b"nothing", "without a name"),
    ],
)
def test_each_fault_is_a_row_and_reading_goes_on(old, new, problem):
    bad = good().replace(old, new, 1)
    assert bad != good()
    first, second = asked(frames(bad, good(b"next")), 50)
    assert problem in first["problem"] and second["payload"] == b"next" and second["problem"] is None


def test_damaged_frames_end_an_archive_only():
    whole = frames(good(), good(b"second"))
    cut = asked(whole[:-3], 50)
    assert cut[0]["payload"] == b"<p>x" and "ends inside" in cut[1]["problem"] and len(cut) == 2
    assert "neither" in asked(whole + b"rubbish", 50)[2]["problem"]
    torn = bytearray(whole)
    torn[len(frames(good())) + 9] ^= 255
    assert len([r for r in asked(bytes(torn), 10_000) if r["problem"]]) == 1
    plain = base64.b64decode(base64.b64encode(whole))
    assert [r["problem"] for r in asked(plain, 5)] == [None, None]


def test_other_archives(spark):
    path = new_path(spark, "t-warc")
    os.makedirs(path.removeprefix("file:"))
    dictionary = warc.trained([f"<html><body>{i} some common words of all pages {i * i}</body></html>".encode() * 5 for i in range(400)])
    assert dictionary
    writer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nwarc-record-id: <urn:x>\r\nWARC-Date: d\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with open(f"{path}/a.warc.zst", "wb") as file:
        file.write(warc.leading_frame(dictionary) + writer.compress(info) + writer.compress(good()))
    with open(f"{path}/b.warc.zst", "wb") as file:
        file.write(warc.skippable(warc.DICTIONARY, dictionary) + writer.compress(good(b"raw dictionary")))
    open(f"{path}/c.warc.zst", "wb").close()
    rows = warc.read(spark, path).collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in rows) == [("response", b"<p>x"), ("response", b"raw dictionary"), ("warcinfo", b"abc")]


def test_empty_table(spark, pages, tmp_path):
    pages.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op12_warc"](spark, str(tmp_path)).count() == 0
