"""WARC archives: writing, and reading back what a chain from the file's start reaches.

Writing: one record a page, payload as the block. Of pages with one payload of at
least min_bytes bytes, those with the largest page_id are responses and the others
revisits of it, which have no block. Spark's text writer with the record end as its
line end writes the files, so its commit protocol covers lost tasks. Each holds at
most max_records records. Files are plain, not compressed, so any reader of WARC can
start at any record, and Spark reads a large one in several tasks.

Reading: the text reader with the magic as its line end deals out what stands
between two magics; a chunk's offset is the sum of the lengths before it. From each
chunk's headers comes a candidate (offset, successor). Payloads may hold the magic
or whole forged records, so pointer jumping from offset 0 marks those that the chain
reaches; the rest is payload. A record that is one chunk is digested where it is
read; only files with a record of several chunks are read again to join these.

Nulls: a null html is the empty payload; a null page_id is kept, and revisits the
largest page_id with its payload if there is one. A payload is one row, whatever its
length; one with the magic inside is joined from its pieces. Columns of other names are
not read. Pages that tie for the largest
page_id of a payload are all responses. An empty table gives empty archives and an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 8 groups of 20 bits, 4 digits each. The argument is a column of an earlier select, or it would be computed for each digit."""
    group = lambda g: F.conv(F.substring(sha1, 5 * g + 1, 5), 16, 10).cast("int")
    digit = lambda n, k: F.substring(F.lit(BASE32), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, 1)
    return F.concat(*[digit(group(g), k) for g in range(8) for k in range(4)])


def write(pages: DataFrame, scratch: Scratch, name: str = "archive", min_bytes: int = 0, max_records: int = 50_000) -> str:
    """Write the archives and return their folder. Columns read: page_id, url, html."""
    base = pages.select(pages["page_id"], pages["url"], F.coalesce(pages["html"], F.lit("")).alias("html"))
    base = base.withColumn("bytes", F.octet_length("html")).withColumn("sha1", F.sha1("html")).withColumn("digest", base32(F.col("sha1")))
    twice = base.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that Spark knows its size and broadcasts it only if it is small.
    twice = scratch.save(twice.where("n > 1").select("digest", "first"), f"{name}-repeated")
    rec = base.join(twice, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), 0).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    path = f"{scratch.path}/{name}"
    out = rec.select(F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("html"))))
    out.write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", max_records).text(path)
    return path


def _chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, at, seq, value): what stands between magics; in a file, by (at, seq), in order."""
    raw = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"), "value")


def _placed(chunks: DataFrame) -> DataFrame:
    """With offset: where in the file the magic before the chunk begins. The file's first, empty chunk has none and goes."""
    before = W.partitionBy("file").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, -1)
    placed = chunks.withColumn("offset", F.sum(F.col("size") + len(MAGIC)).over(before) - len(MAGIC))
    return placed.where(F.col("offset").isNotNull())


def _header(key: str) -> Column:
    return F.regexp_extract("head", rf"(?:^|\r\n){key}: ([^\r\n]*)\r\n", 1)


def _jump(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one file's candidates, those that pointers reach from offset 0, doubling the jump each time."""
    rows = rows.sort_values("offset", ignore_index=True)
    offset = rows["offset"].to_numpy(np.int64)
    goal = rows["successor"].to_numpy(np.int64)
    n = len(offset)
    to = np.searchsorted(offset, goal)
    to[(to < n) & (offset[np.minimum(to, n - 1)] != goal)] = n  # points to no candidate
    to = np.append(to, n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and offset[0] == 0
    for _ in range(n.bit_length() + 1):
        reached[to[reached]] = True
        to = to[to]
    return rows[reached[:n]]


def read(spark: SparkSession, path: str, scratch: Scratch, name: str = "records") -> DataFrame:
    """One row a record: page_id, record_type, refers_to, payload_bytes, payload_digest (of the full payload; a revisit's is its response's)."""
    chunks = _chunks(spark, [path])
    split = F.instr("value", END)
    body = F.substr("value", split + len(END))
    info = chunks.select(
        "file", "at", "seq", F.octet_length("value").cast("long").alias("size"),
        F.when(split > 0, F.substr("value", F.lit(1), split + 1)).alias("head"),
        body.alias("body"),
    )
    length = F.regexp_extract("head", r"(?:^|\r\n)Content-Length: (\d{1,15})\r\n", 1)
    info = info.withColumn("length", F.when(length != "", length.cast("long"))).withColumn("head_size", F.octet_length("head") + 2)
    whole = F.col("size") == F.col("head_size") + F.col("length") + len(END)
    payload = F.substr("body", F.lit(1), F.length("body") - len(END))
    info = info.select(
        "file", "at", "seq", "size", "head_size", "length", whole.alias("whole"),
        F.when(whole, F.sha1(payload)).alias("sha1"),
        _header("WARC-Type").alias("type"), _header("WARC-Record-ID").alias("id"), _header("WARC-Refers-To").alias("refers"), _header("WARC-Payload-Digest").alias("said"),
    )
    links = _placed(info).where(F.col("length").isNotNull() & (F.col("type") != ""))
    links = links.withColumn("successor", F.col("offset") + len(MAGIC) + F.col("head_size") + F.col("length") + len(END))
    kept = links.groupBy("file").applyInPandas(_jump, links.schema)
    kept = scratch.save(kept, f"{name}-reached")

    torn = [r.file for r in kept.where("NOT whole").select("file").distinct().collect()]  # names of files that hold the magic in a payload
    if torn:
        again = _placed(_chunks(spark, torn).withColumn("size", F.octet_length("value").cast("long")))
        starts = kept.where("NOT whole").select("file", F.col("offset").alias("start"), "successor", "head_size", "length")
        parts = again.join(kept.select("file", "offset", F.col("offset").alias("own")), ["file", "offset"], "left")
        of = F.last("own", ignorenulls=True).over(W.partitionBy("file").orderBy("offset"))
        parts = parts.withColumn("start", of).join(starts, ["file", "start"])
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC)
        joined = parts.groupBy("file", "start", "head_size", "length").agg(text.alias("text"))
        cut = F.substr(F.col("text").cast("binary"), F.col("head_size") + 1, F.col("length").cast("int")).cast("string")
        joined = joined.select("file", F.col("start").alias("offset"), F.sha1(cut).alias("joined"))
        kept = kept.join(joined, ["file", "offset"], "left").withColumn("sha1", F.coalesce("sha1", "joined"))

    number = lambda c: F.when(F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1) != "", F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long"))
    revisit = F.col("type") == "revisit"
    rows = kept.select(
        number("id").alias("page_id"), F.col("type").alias("record_type"), F.when(revisit, number("refers")).alias("refers_to"),
        F.when(~revisit, F.col("length")).alias("own_bytes"), F.when(revisit, F.substring("said", 6, 32)).otherwise(base32(F.col("sha1"))).alias("payload_digest"),
    )
    full = rows.where("own_bytes IS NOT NULL").join(rows.where("record_type = 'revisit'").select("payload_digest").distinct(), "payload_digest", "left_semi")
    full = full.groupBy("payload_digest").agg(F.max("own_bytes").alias("full_bytes"))
    return rows.join(full, "payload_digest", "left").select("page_id", F.coalesce("own_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
