"""Web archives: writing captures, reading them back, and merging their index.

A capture becomes a WARC record whose block is an HTTP response with the page as payload. Of
captures with equal payloads the one with the smallest id is stored in full; the others are
revisit records, which keep the HTTP header, and with it the payload's length, and refer to it.

Every archive read back gives a capture run, sorted by URL key, time and record within its task.
Runs are dealt by key range to tasks that merge their parts of all k runs with a tree of
losers; ranges follow each other, so the parts, one after another, are the history of all captures.

Edge cases: a null page counts as an empty payload; a null URL is written as an empty one; a
null id has its own record, always in full, that nothing refers to; rows that repeat the smallest
id of a payload are all in full; control characters in a URL are percent-encoded; an empty table
gives no archives and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from peerscreen.llm.common import clear, fresh_path, let, stored

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:capture:"
END = "\r\n\r\n"

ARCHIVE_BYTES = 32_000_000  # of records, before compression
RANGE_ROWS = 100_000  # captures merged in one task
BEGAN = 1_577_836_800  # 2020-01-01, where a table has no times


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32: five hex digits at a time are four letters."""
    letters = lambda h, i: F.translate(
        F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )
    return let(F.sha1(data), lambda h: F.concat(*[letters(h, i) for i in range(8)]))


def with_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (id, url, payload, captured) with digest, bytes, record_type and refers_to.

    Only payloads that occur twice or more are looked up; pages themselves aren't shuffled
    as long as those fit Spark's broadcast limit.
    """
    df = pages.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    narrow = df.select("id", "digest", "bytes").where((F.col("bytes") >= least_bytes) & F.col("id").isNotNull())
    again = narrow.groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = stored(again, "payloads")
    out = df.join(again, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("id") > F.col("first"))
    return out.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))}).drop("first")


def record(df: DataFrame) -> Column:
    """A record's text, without the two line ends that close it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    full = F.col("record_type") == "response"
    body = F.when(full, F.col("payload")).otherwise("")
    named = lambda c: F.concat(F.lit(f"<{NAME}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(VERSION + "\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", named(F.col("id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.date_format(F.col("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(full, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", named(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
        http,
        body,
    )


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None, least_bytes: int = 0) -> None:
    """Archives of about ARCHIVE_BYTES under `path`, compressed as a whole; one record per row."""
    when = F.col(captured) if captured else F.timestamp_seconds(F.lit(BEGAN) + F.coalesce(F.col(page_id).cast("long"), F.lit(0)))
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    address = F.when(F.regexp_like(address, F.lit(r"[\x00-\x20\x7F]")), F.replace(F.url_encode(address), F.lit("+"), F.lit("%20"))).otherwise(address)
    rows = pages.select(
        F.col(page_id).alias("id"), address.alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"), when.alias("captured")
    )
    total = rows.agg(F.sum(F.octet_length("payload").cast("long") + 600)).first()[0] or 0
    typed = with_types(rows, least_bytes)
    records = typed.select(record(typed).alias("value"), F.xxhash64("id", "url").alias("h")).repartition(int(total // ARCHIVE_BYTES) + 1, "h")
    records.select("value").write.option("lineSep", END).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Host labels from the right, then path and query, so that a site's captures lie together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url, re.I)
    if not m:
        return url.lower()
    labels = m[1].lower().removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (m[2] or "/").lower()


class Stream:
    """Bytes of a compressed archive, in order, a little more than one record at a time."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        self.data, self.piece, self.at = memoryview(data), piece, 0
        self.inflate = zlib.decompressobj(31)
        self.held, self.place, self.past = bytearray(), 0, 0

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + self.piece]
        self.at += len(part)
        while len(part):
            self.held += self.inflate.decompress(part)
            part = self.inflate.unused_data
            if part:  # another member follows
                self.inflate = zlib.decompressobj(31)
        return True

    def until(self, end: bytes) -> bytes | None:
        start = self.place
        while (k := self.held.find(end, start)) < 0:
            start = max(self.place, len(self.held) - len(end))
            if not self.more():
                return None
        out = bytes(self.held[self.place : k])
        self.place = k + len(end)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.place < n:
            if not self.more():
                raise ValueError("a record ends too early")
        out = bytes(self.held[self.place : self.place + n])
        self.place += n
        return out

    def forget(self) -> None:
        if self.place > 4 * self.piece:
            self.past += self.place
            del self.held[: self.place]
            self.place = 0


def records(data: bytes) -> Iterator[dict]:
    """Parsed records of an archive, payloads checked against their digests."""
    stream = Stream(data)
    while True:
        offset = stream.past + stream.place
        head = stream.until(END.encode())
        if head is None:
            return
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {offset}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.take(int(fields["content-length"]))
        http, _, payload = block.partition(END.encode())
        stream.take(len(END))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
        full = fields["warc-type"] == "response"
        if full and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload at {offset} isn't what its record says")
        name = lambda v: v.strip("<>").removeprefix(NAME) or None
        yield {
            "url_key": url_key(fields["warc-target-uri"]),
            "captured": fields["warc-date"],
            "id": name(fields["warc-record-id"]),
            "url": fields["warc-target-uri"],
            "record_type": fields["warc-type"],
            "refers_to": name(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
            "payload_bytes": size,
            "payload_digest": digest,
            "offset": offset,
            "length": stream.past + stream.place - offset,
            "payload": payload if full else None,
        }
        stream.forget()


INDEX = "url_key string, captured string, id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, offset long, length long"
_FIELDS = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in INDEX.split(", ")]


def order(row: dict) -> tuple:
    return row["url_key"], row["captured"], row["id"] or "", row["offset"]


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """All records with their payloads; null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_FIELDS, ("payload", pa.binary())])
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for r in records(content.as_py()):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives(spark, path).mapInArrow(read, INDEX + ", payload binary")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per archive: the index columns, run (its archive) and place in it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_FIELDS, ("run", pa.string()), ("place", pa.int64())])
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for r in records(content.as_py()):
                    del r["payload"]
                    rows.append(r)
                rows.sort(key=order)
                run = name.as_py().rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_pylist([r | {"run": run, "place": i} for i, r in enumerate(rows)], schema=schema)

    return archives(spark, path).mapInArrow(read, INDEX + ", run string, place long")


class LoserTree:
    """Merges sorted lists: each inner node remembers the loser of its match, the winner plays on."""

    def __init__(self, lists: list[list[tuple]]):
        self.lists, self.k = lists, len(lists)
        self.next = [0] * self.k
        self.losers = [-1] * self.k  # [0] is the winner
        self.heads = [x[0] if x else None for x in lists]
        for i in range(self.k):
            self._play(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.next[w] += 1
            self.heads[w] = self.lists[w][self.next[w]] if self.next[w] < len(self.lists[w]) else None
            self._play(w)


def merged(index: DataFrame) -> DataFrame:
    """The captures of all runs in one order: range after range, and `position` within each.

    A URL with very many captures is spread over ranges too, by time and record.
    """
    n = index.count() // RANGE_ROWS + 1
    dealt = index.repartitionByRange(n, "url_key", "captured", F.coalesce("id", F.lit("")), "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        rows = table.to_pylist()
        parts: dict[str, list[tuple]] = {}
        for i, r in enumerate(rows):
            parts.setdefault(r["run"], []).append((r["place"], i))
        # A run's part may reach the task in several pieces; places put them in the run's order.
        lists = [[(*order(rows[i]), run, i) for _, i in sorted(part)] for run, part in sorted(parts.items())]
        taken = table.take(pa.array([head[-1] for head in LoserTree(lists)], type=pa.int64()))
        taken = taken.append_column("position", pa.array(range(len(rows)), type=pa.int64()))
        yield from taken.combine_chunks().to_batches()

    out = dealt.mapInArrow(merge, INDEX + ", run string, place long, position long")
    return out.withColumn("range", F.spark_partition_id())


def histories(pages: DataFrame, **names) -> DataFrame:
    """Pages written to archives in the shared folder, read back, their runs merged."""
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write(pages, path, **names)
    return merged(stored(clear(runs(spark, path), "position", "range"), "captures"))
