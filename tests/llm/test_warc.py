import base64
import gzip
import hashlib
import os
import zlib

import pytest

from emberfield.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest int"


def slow(rows, least=0):
    out = []
    for page_id, url, html in rows:
        raw = (html or "").encode()
        rank = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
        first = min((r for r in rows if (r[2] or "") == (html or "")), key=rank)
        revisit = len(raw) >= least and rank(first) != rank((page_id, url))
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "revisit" if revisit else "response", first[0] if revisit else None))
    return sorted(out, key=str)


def made(spark, rows, tmp_path, least=0, files=None):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    if files:
        df = df.repartition(files)
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    warc.write_archives(df, one, least)
    assert warc.normalise(spark, one, two) == len(rows)
    return warc.read_archives(spark, two)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (None, "http://c/", "same"),
    (7, "http://d/\r\nWARC-Type: evil\x00", "line\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
    (8, "", None), (2, "http://e/%0A", ""), (-4, "http://f/", "é 𝄞"), (11, "http://g/", "x" * 3_000_000),
    (12, "http://h/", "x" * 3_000_000), (3, "http://b/", "same"), (None, None, "alone"), (20, "u", "\r\n"),
]


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip_against_brute_force(spark, tmp_path, least):
    found = made(spark, ROWS, tmp_path, least)
    assert got(found) == slow(ROWS, least)
    bodies = sorted((r["page_id"], bytes(r["payload"]).decode()) for r in found.where("record_type = 'response' and page_id is not null").collect())
    want = sorted((r[0], next(h or "" for p, u, h in ROWS if p == r[0])) for r in slow(ROWS, least) if r[3] == "response" and r[0] is not None)
    assert bodies == want
    assert found.where("intact = false or (record_type = 'response' and intact is null)").count() == 0
    assert {r["target"] for r in found.where("page_id = 7").collect()} == {"http://d/%0D%0AWARC-Type: evil%00"}


def test_every_record_is_a_member_and_sidecars_tell_where(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * (i % 40)) for i in range(300)]
    made(spark, rows, tmp_path, files=3)
    index = warc.read_index(spark, f"file://{tmp_path}/two").collect()
    assert len(index) == 300 and len({(r["archive"], r["offset"]) for r in index}) == 300
    for r in index[::17]:
        with open(r["archive"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            engine = zlib.decompressobj(31)
            text = engine.decompress(f.read(r["length"]))
        assert engine.eof and not engine.unused_data and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        assert r["record_id"].encode() in text
    whole = b"".join(gzip.open(f"{tmp_path}/two/{f}").read() for f in sorted(os.listdir(tmp_path / "two")) if f.endswith(".gz"))
    before = b"".join(gzip.open(f"{tmp_path}/one/{f}").read() for f in sorted(os.listdir(tmp_path / "one")) if f.endswith(".gz"))
    assert whole == before


def test_one_payload_for_most_rows(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "often" if i % 3 else f"page {i}") for i in range(1, 400)]
    assert got(made(spark, rows, tmp_path, files=5)) == slow(rows)


def test_no_pages(spark, tmp_path):
    assert got(made(spark, [], tmp_path)) == []


def test_foreign_archives(spark, tmp_path):
    """Several members before, other record types, no target: all are kept; damage is told with the file's name."""
    os.makedirs(tmp_path / "in")
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: resource\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    raw = gzip.compress(one + two[:20]) + gzip.compress(two[20:] + one)
    (tmp_path / "in" / "a.warc.gz").write_bytes(raw)
    assert warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out") == 3
    found = warc.read_archives(spark, f"file://{tmp_path}/out").collect()
    assert sorted((r["record_type"], r["payload_bytes"], bytes(r["payload"]), r["page_id"]) for r in found) == [
        ("resource", 0, b"", None), ("warcinfo", 3, b"abc", None), ("warcinfo", 3, b"abc", None),
    ]
    for damaged in (raw[:-9], gzip.compress(one[:-1]), gzip.compress(one[:-4] + b"xxxx"), gzip.compress(one[:40])):
        (tmp_path / "in" / "a.warc.gz").write_bytes(damaged)
        with pytest.raises(ValueError, match="a.warc.gz"):
            list(warc.normalise_file(f"{tmp_path}/in/a.warc.gz", f"{tmp_path}/out2/a.warc.gz"))
    assert not [f for f in os.listdir(tmp_path / "out2") if not f.startswith(".")]


def test_pieces_of_any_size(monkeypatch, tmp_path):
    raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, os.urandom(n)) for n in (0, 1, 5, 4000, 17))
    (tmp_path / "a.gz").write_bytes(gzip.compress(raw))
    for step in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(warc, "STEP", step)
        rows = list(warc.normalise_file(f"{tmp_path}/a.gz", f"{tmp_path}/b{step}.warc.gz"))
        assert len(rows) == 5 and gzip.decompress((tmp_path / f"b{step}.warc.gz").read_bytes()) == raw


def test_a_repeated_attempt_after_the_source_went(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i}") for i in range(50)]
    one, two = f"file://{tmp_path}/one dir", f"file://{tmp_path}/two"
    warc.write_archives(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).coalesce(1), one)
    files = [f for f in os.listdir(tmp_path / "one dir") if f.endswith(".gz")]
    assert warc.normalise(spark, one, two, consume=True) == 50 and not os.path.exists(tmp_path / "one dir" / files[0])
    assert sum(warc.settle_file(f"{one}/{f}", two, True) for f in files) == 50
    assert got(warc.read_archives(spark, two)) == slow(rows)
