import base64
import gzip
import hashlib
import random

from peerscreen.llm import warc
from peerscreen.llm.common import fresh_path

SHAPE = "page_id long, url string, html string"


def pages():
    rng = random.Random(2)
    odd = ["", None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb", "é日本🙂" * 500, "\r\n\r\n", "x" * 300_000]
    rows = [(i, f"https://www.s{i % 7}.example.com:8080/p/{i % 11}?q={i}#f", rng.choice(odd + [f"page {i}"])) for i in range(60)]
    return rows + [(60, None, "page 1"), (61, "not a url \n with breaks", "page 1"), (None, "http://n.example/", "page 1"), (3, "http://again.example/", rows[3][2])]


def test_round_trip(spark):
    rows = pages()
    got = warc.histories(spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 as id", "2 as payload", "3 as digest", "4 as range")).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and i > first[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    have = [(r.id and int(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_payloads_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    path = fresh_path(spark, "archives")
    rows = pages()[:60]
    warc.write(spark.createDataFrame(rows, SHAPE), path)
    back = warc.payloads(spark, path).where("record_type = 'response'").collect()
    wanted = {str(i): (h or "").encode() for i, _, h in rows}
    assert len(back) > 5 and all(bytes(r.payload) == wanted[r.id] for r in back)
    assert warc.archives(spark, path).count() > 3


def test_merge_is_globally_ordered(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 100)
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{i % 50}.example/{i % 9}", f"page {i % 40} " * 40) for i in range(900)]
    got = warc.histories(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(got) == 900 and len({r.range for r in got}) > 3 and len({r.run for r in got}) > 3
    got.sort(key=lambda r: (r.range, r.position))
    keys = [warc.order(r.asDict()) for r in got]
    assert keys == sorted(keys)


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 8, 20):
        lists = [sorted((rng.randint(0, 30), i) for _ in range(rng.choice([0, 1, 5, 40]))) for i in range(k)]
        assert list(warc.LoserTree(lists)) == sorted(x for part in lists for x in part)


def test_members_one_after_another():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:capture:7>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: d\r\n"
    digest = base64.b32encode(hashlib.sha1(b"hey").digest()).decode().encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nhey"
    record += b"WARC-Payload-Digest: sha1:" + digest + b"\r\nContent-Length: " + str(len(http)).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"
    found = list(warc.records(gzip.compress(record) + gzip.compress(record)))
    assert [r["id"] for r in found] == ["7", "7"] and found[1]["offset"] == len(record)


def test_empty_table(spark):
    assert warc.histories(spark.createDataFrame([], SHAPE)).collect() == []
