"""WARC archives of pages, and their capture index by external merge.

Writing: one record per page, as text with the record end as line separator, so
that Spark's own writer makes the archives on any file system. Of pages with
equal payloads, the one of the smallest id is a response with the payload and
the others are revisits that name it.

Reading: each archive is walked record by record along Content-Length; the index
counts bytes of the uncompressed archive.

Index: every archive gives one capture run sorted by URL key, time and id. The
runs are cut at common splitters of the key range and each range is merged from
its slices of all runs by a tree of losers. Ranges follow one another, so the
index is ordered as a whole; a URL with very many captures is cut by time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm.common import Shelf

#: Mean payload bytes of an archive; an archive is read as one value.
ARCHIVE_BYTES = 8 << 20
#: Mean captures merged by one task.
RANGE_ROWS = 20_000
END = "\r\n\r\n"
RECORD = (
    "page_id string, url string, captured string, record_type string, refers_to string, payload_bytes long, "
    "payload_digest string, archive string, at long, size long"
)


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: eight groups of five digits become four letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(0, 40, 5):
        value = F.conv(F.substring(hexadecimal, k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.pmod(F.shiftright(value, s), F.lit(32)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def crawl_time(page_id: Column) -> Column:
    """Pages without a time of their own were captured one a second, in the order of their ids, in a round of a hundred years."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(page_id.cast("long"), F.lit(0)), F.lit(100 * 365 * 86400)))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame, shelf: Shelf, least: int = 0) -> DataFrame:
    """Pages with payload, digest, record_type and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    facts = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32(F.sha1(payload.cast("binary"))).alias("payload_digest"),
        (F.col("captured").cast("string") if "captured" in pages.columns else crawl_time(F.col("page_id"))).alias("captured"),
    )
    # rows of one payload meet as partial minima; the join deals large groups out again
    first = shelf.put(facts.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = facts.join(first, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least) & F.coalesce(F.col("first") < F.col("page_id"), F.lit(False))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def write_archives(described: DataFrame, path: str, archives: int) -> None:
    """One compressed WARC file per task; a revisit has headers only."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    none = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), none(F.col("page_id")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("captured")), F.concat(F.lit("WARC-Target-URI: "), clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    described.repartition(archives, F.xxhash64("page_id", "url", "payload_digest")) \
        .select(F.concat(head, F.lit(END), block).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(name: str, data: bytes) -> Iterator[tuple]:
    """The records of one archive; a response is checked against its digest."""
    at = 0
    while at < len(data):
        split = data.index(END.encode(), at)
        head = dict(x.split(": ", 1) for x in data[at:split].decode("utf-8", "replace").split("\r\n")[1:])
        size = int(head["Content-Length"])
        body = data[split + 4 : split + 4 + size]
        page = head["WARC-Record-ID"][10:-1]
        digest = head["WARC-Payload-Digest"].partition(":")[2]
        if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"{name}: the record at byte {at} doesn't match its digest")
        end = split + 8 + size
        refers = head.get("WARC-Refers-To")
        yield (None if page == "none" else page, head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Type"], refers[10:-1] if refers else None,
               size if head["WARC-Type"] == "response" else int(head["WARC-Payload-Length"]), digest, name, at, end - at)
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, payloads checked and left behind."""
    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(list(parse(name.rpartition("/")[2], gzip.decompress(data))), columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(walk, RECORD).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def url_key(url: Column) -> Column:
    """Host labels in reverse, then the path, in lower case and without scheme, www and fragment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?:]*", 0), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?:]*(?::\d+)?(.*)$", 1), r"/$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


class LoserTree:
    """Merges sorted lists: inner nodes hold the losers of their matches, the root the overall winner."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.n = runs, [0] * len(runs), max(1, len(runs))
        self.losers = [-1] * self.n
        for leaf in range(len(runs)):
            self._enter(leaf)

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or x is not None and (x, a) < (y, b)

    def _enter(self, leaf: int) -> None:
        """First matches: a run waits at the first node without an opponent."""
        winner, node = leaf, (leaf + self.n) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        if not self.runs:
            return
        while (value := self._head(winner := self.losers[0])) is not None:
            yield value
            self.at[winner] += 1
            node = (winner + self.n) // 2
            while node:
                if self._beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.losers[0] = winner


def capture_index(captures: DataFrame, rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures ordered by (url_key, captured, page_id), with their place in the URL's history.

    The output's partitions follow one another in that order.
    """
    spark = captures.sparkSession
    shelf = Shelf(spark)
    keyed = captures.withColumn("url_key", url_key(F.col("url")))
    runs = shelf.put(keyed.sortWithinPartitions("archive", "url_key", "captured", "page_id"))
    n = runs.count() if rows is None else rows
    order = ["url_key", "captured", "page_id", "archive", "at"]
    fields = [f for f in runs.columns if f not in order]
    # pandas would turn numbers beside a null into floats: no id is null there, and the ones referred to are text
    types = ", ".join(f"{f.name} {'string' if f.name == 'refers_to' else f.dataType.simpleString()}" for f in [runs.schema[c] for c in order + fields])
    none = F.lit(-(2**63))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame(columns=order + fields), *frames])
        if not len(held):
            return
        slices = [list(part[order + fields].itertuples(index=False, name=None)) for _, part in held.groupby("archive", sort=True)]
        yield pd.DataFrame(list(LoserTree(slices)), columns=order + fields)

    dealt = runs.repartitionByRange(max(1, -(-n // range_rows)), *order).sortWithinPartitions("archive", *order[:3], "at")
    plain = dealt.select(*order, *fields).withColumns({"page_id": F.coalesce("page_id", none), "refers_to": F.col("refers_to").cast("string")})
    return plain.mapInPandas(merge, types).withColumns({"page_id": F.when(F.col("page_id") != none, F.col("page_id")), "refers_to": F.col("refers_to").cast("long")})


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives, read them back and merge their index.

    Rows: the index order (url_key, captured, page_id, ...) with record_type,
    refers_to, payload_bytes and payload_digest. A null html is an empty
    payload; empty payloads are equal to one another like others. Pages with a
    null id or url are written with the id ``none`` or an empty url; a null id
    never becomes the one referred to unless it is alone. Repeated rows with the
    same id are all responses if theirs is the smallest id. An empty table gives
    no rows.
    """
    spark = pages.sparkSession
    shelf = Shelf(spark)
    described = records(pages, shelf, least)
    total, n = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))), F.count("*")).first()
    path = shelf.path()
    write_archives(described, path, max(1, -(-(total or 0) // ARCHIVE_BYTES)))
    return capture_index(read_archives(spark, path), n)
