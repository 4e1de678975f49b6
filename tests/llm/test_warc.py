import base64
import gzip
import hashlib
import io
import zlib

from bindery.llm import warc

PAGES = [
    (5, "http://a/1", "<p>é€</p>"),
    (3, "http://a/2", "<p>é€</p>"),
    (9, "http://a/3\r\nX: y", "<p>é€</p>"),
    (1, None, None),
    (2, "u", ""),
    (4, "u", "x" * 300_000),
    (None, "n", "only null"),
    (None, "n", "<p>é€</p>"),
    (7, "r", "twice"),
    (7, "r", "twice"),
    (8, "h", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, payload int").repartition(3)


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def wanted(rows, least=0):
    out = []
    for page_id, _, html in rows:
        body = html or ""
        same = [p for p, _, h in rows if (h or "") == body and p is not None]
        n = len(body.encode())
        refers = min(same) if same and len([1 for _, _, h in rows if (h or "") == body]) > 1 and n >= least and min(same) != page_id else None
        out.append((page_id, n, sha(body), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    for least in (0, 6):
        manifest = warc.write_warc(pages(spark), min_revisit_bytes=least)
        got = warc.page_records(manifest).collect()
        assert sorted(map(tuple, got), key=str) == wanted(PAGES, least)


def test_payloads_come_back_and_archives_roll(spark):
    manifest = warc.write_warc(pages(spark), roll_bytes=200)
    assert manifest.count() > 3
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    read = warc.read_warc(manifest).filter("record_type = 'response'").collect()
    assert {(r.record_id, bytes(r.payload).decode()) for r in read} >= {("<urn:page:4>", "x" * 300_000), ("<urn:page:3>", "<p>é€</p>")}
    assert all(r.error is None for r in read)


def test_no_pages(spark):
    manifest = warc.write_warc(pages(spark).limit(0))
    assert manifest.count() == 0 and warc.page_records(manifest).count() == 0


def archive(*payloads):
    return [gzip.compress(warc.record(i, "http://x", p, None, "1970-01-01T00:00:00Z")) for i, p in enumerate(payloads)]


def test_records_are_members_any_reader_can_inflate():
    members = archive(b"one", b"two")
    assert gzip.decompress(b"".join(members)).count(b"WARC/1.1") == 2
    got = list(warc.read_records(io.BytesIO(b"".join(members))))
    assert [r["payload"] for r in got] == [b"one", b"two"]


def test_pieces_smaller_than_anything(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    got = list(warc.read_records(io.BytesIO(b"".join(archive(b"", b"two" * 50, b"\r\n\r\n")))))
    assert [r["payload"] for r in got] == [b"", b"two" * 50, b"\r\n\r\n"]


def test_damage_is_reported_after_the_sound_records():
    one, two = archive(b"one", b"two" * 400)
    plain = zlib.decompress(two, 31)
    cases = [
        one + two[:-9],  # cut off
        one + two[:40] + b"\x00" + two[41:],  # bytes changed
        one + gzip.compress(plain.replace(b"twotwo", b"twoTWO", 1)),  # digest
        one + gzip.compress(plain[:-1]),  # framing
        one + b"no gzip at all",
    ]
    for raw in cases:
        got = list(warc.read_records(io.BytesIO(raw)))
        assert len(got) == 2 and got[0]["payload"] == b"one" and got[1]["error"]
