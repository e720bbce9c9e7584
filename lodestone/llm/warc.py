"""WARC archives: a writer, and a reader that trusts no magic by itself.

Writing: one record per row through Spark's own text writer, whose line end is the end of
a WARC record; any file system that Spark writes to will do. Records of equal payloads
are written once as ``response`` and else as ``revisit``.

Reading, by verification of boundary chains: the files are read in splits, cut at every
occurrence of the magic. Each occurrence that a record header follows is a candidate with
a successor, the offset at which the next record must begin. Within a block, candidates
are chained to the first offset beyond the block; pointer jumping over those jumps finds,
from the start of each file, the entries into every block, and only candidates on a chain
from such an entry are records. A magic inside a payload is on no such chain, and pieces
of such a payload are put together again.

Null payloads count as empty; null urls are left out; a null id is read back as null.
Broken files: records are those up to the first offset where no record begins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST_PAYLOAD = 0
BUCKETS = 1 << 18
PART = 1 << 16  #: bytes of a file; a record whose payload holds the magic is listed once for each part that it reaches into
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _CONV, _BASE32)


def _header(*lines: Column) -> Column:
    return F.concat(F.lit(MAGIC), *[F.concat(x, F.lit("\r\n")) for x in lines], F.lit("\r\n"))


def archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_payload: int = LEAST_PAYLOAD) -> None:
    """Write a WARC record for every row to files under ``path``.

    Of rows whose payloads are equal and have ``least_payload`` bytes at least, that with the
    largest id is the response (rows that repeat it too) and the others refer to it.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    keyed = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload"))
    shared = (
        keyed.where(F.col("bytes") >= least_payload)
        .groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b"))
        .agg(F.max("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    shared = Scratch(spark, "shared").settle(shared, "payloads")
    # payloads whose digests fall on no bucket of a shared one stay where they are; there are BUCKETS buckets at most
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    buckets = F.broadcast(shared.select(bucket("d").alias("bucket")).distinct())
    keyed = keyed.withColumn("bucket", bucket("digest"))
    single = keyed.join(buckets, "bucket", "left_anti").withColumn("first", F.lit(None).cast("long"))
    several = keyed.join(buckets, "bucket", "left_semi").join(shared.select("d", "b", "first"), (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    shown = single.select("id", "url", "payload", "digest", "bytes", "first").unionByName(several.select("id", "url", "payload", "digest", "bytes", "first"))
    revisit = F.col("id") < F.col("first")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    common = [
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("urn:none"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
    ]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.col("payload"))
    response = F.concat(_header(F.lit("WARC-Type: response"), *common, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), block)
    again = _header(
        F.lit("WARC-Type: revisit"),
        F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first"))),
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        *common,
        F.lit("Content-Length: 0"),
    )
    shown.select(F.when(F.coalesce(revisit, F.lit(False)), again).otherwise(response).alias("value")).write.mode("overwrite").option("lineSep", END).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def pieces(spark: SparkSession, path: str, every_raw: bool = False) -> DataFrame:
    """Every stretch between magics: file (a hash of its path), block, seq (order in the block), size, header fields, payload or raw bytes.

    ``alone`` stretches hold a whole record; their payload is digested on the spot, so that
    its bytes need not travel with it: only the others keep ``raw``.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    out = raw.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("raw"),
        F.substring_index("value", END, 1).alias("head"),
        F.octet_length("value").alias("size"),
    )  # a byte of ``size`` is a byte of the file
    out = out.withColumn("head_size", F.octet_length("head") + 4)
    length = F.when(F.col("head_size") <= F.col("size"), F.expr("try_cast(nullif(regexp_extract(head, '(?i)(?:^|\\\\r\\\\n)Content-Length:[ \\\\t]*([0-9]+)', 1), '') AS bigint)"))
    out = out.withColumn("length", F.when(_field("WARC-Type") != "", length))
    out = out.withColumn("alone", F.coalesce(F.col("head_size") + F.col("length") + 4 == F.col("size"), F.lit(False)))
    return out.select(
        "file",
        "block",
        "seq",
        "size",
        "head_size",
        "length",
        "alone",
        _field("WARC-Type").alias("type"),
        F.regexp_extract(_field("WARC-Record-ID"), "<urn:page:(.*)>", 1).alias("id"),
        F.regexp_extract(_field("WARC-Refers-To"), "<urn:page:(.*)>", 1).alias("refers"),
        _field("WARC-Target-URI").alias("uri"),
        F.col("raw") if every_raw else F.when(~F.col("alone"), F.col("raw")).alias("raw"),
        F.when(F.col("alone"), F.expr("substring(raw, head_size + 1, length)")).alias("content"),
    )


def _digested(df: DataFrame) -> DataFrame:
    """Replace ``content`` (a record's block, binary) by the size and digest of its payload."""
    head = F.octet_length(F.substring_index(F.col("content").cast("string"), END, 1)) + 4
    body = F.when(head <= F.octet_length("content"), F.expr("substring(content, _at + 1)")).otherwise(F.expr("content"))
    return (
        df.withColumn("_at", head)
        .withColumn("payload", F.when(F.col("type") == "response", body))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("payload_digest", base32_sha1(F.col("payload")))
        .drop("_at", "content", "payload")
    )


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    """For every candidate of a block, the first offset beyond the block on its chain."""
    exit_of: dict[int, int] = {}
    for at, successor in zip(group["at"].to_numpy()[::-1], group["successor"].to_numpy()[::-1], strict=True):
        exit_of[int(at)] = exit_of.get(int(successor), int(successor))
    return pd.DataFrame({"file": group["file"], "block": group["block"], "at": group["at"], "jump": [exit_of[int(a)] for a in group["at"]]})


def _chains(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that a chain from its entry reaches."""
    successor = dict(zip(group["at"].tolist(), group["successor"].tolist(), strict=True))
    kept, at = [], int(group["entry"].iloc[0])
    while at in successor:
        kept.append((at, successor[at]))
        at = successor[at]
    return pd.DataFrame({"file": [group["file"].iloc[0]] * len(kept), "block": [group["block"].iloc[0]] * len(kept), "at": [k for k, _ in kept], "successor": [s for _, s in kept]})


def boundaries(scratch: Scratch, found: DataFrame) -> DataFrame:
    """file, block, at, successor of the records among candidate stretches."""
    successor = F.col("at") + len(MAGIC) + F.col("head_size") + F.col("length") + 4
    candidates = found.where("length IS NOT NULL").select("file", "block", "at", successor.alias("successor"))
    exits = candidates.groupBy("file", "block").applyInPandas(
        lambda g: _exits(g.sort_values("at")), "file long, block long, at long, jump long"
    )
    exits = scratch.settle(exits, "exits")
    # an entry is an offset at which a chain from the start of the file enters a block
    entries = scratch.settle(exits.where("at = 0").select("file", "at"), "entries_0")
    jumps, turn, reached = exits.select("file", "at", "jump"), 0, -1
    while (now := entries.count()) != reached:
        reached, turn = now, turn + 1
        step = entries.join(jumps, ["file", "at"]).select("file", F.col("jump").alias("at"))
        entries = scratch.settle(entries.union(step).distinct(), f"entries_{turn}")
        onward = jumps.select("file", F.col("at").alias("jump"), F.col("jump").alias("then"))
        jumps = scratch.settle(jumps.join(onward, ["file", "jump"]).select("file", "at", F.col("then").alias("jump")), f"jumps_{turn}")
    entered = entries.join(exits.select("file", "block", "at"), ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    return (
        candidates.join(entered, ["file", "block"])
        .groupBy("file", "block")
        .applyInPandas(lambda g: _chains(g.sort_values("at")), "file long, block long, at long, successor long")
    )


def with_offsets(found: DataFrame) -> DataFrame:
    """Add ``at``, the offset of the magic in front of a stretch: what stands before it in its block and in earlier blocks."""
    totals = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("span"))
    totals = totals.selectExpr("file", "block", "sum(span) OVER (PARTITION BY file ORDER BY block) - span AS before")
    return found.join(totals, ["file", "block"]).selectExpr(
        "*", f"before + sum(size + {len(MAGIC)}) OVER (PARTITION BY file, block ORDER BY seq) - size - {2 * len(MAGIC)} AS at"
    ).drop("before")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """id, type, refers, uri, payload_bytes, payload_digest, file, offset of every record under ``path``."""
    scratch = Scratch(spark, "warc")
    found = scratch.settle(_digested(pieces(spark, path)), "pieces")
    placed = scratch.settle(with_offsets(found.drop("raw")), "placed")
    records = scratch.settle(boundaries(scratch, placed), "records")
    known = placed.join(records, ["file", "block", "at"])
    told = ["type", "id", "refers", "uri"]
    whole = known.where("alone").select("file", F.col("at").alias("offset"), *told, "payload_bytes", "payload_digest")
    # a payload that holds the magic: the stretches from a record's start up to its successor
    broken = known.where("NOT alone").select("file", F.col("at").alias("start"), "successor", "head_size", "length", *told)
    # a stretch and the record around it meet in the part of the file that the stretch begins in
    part = lambda c: F.floor(F.col(c) / PART)
    spans = broken.select("file", "start", "successor", F.explode(F.sequence(part("start"), F.floor((F.col("successor") - 1) / PART))).alias("part"))
    inside = placed.select("file", "block", "seq", "at", "alone", part("at").alias("part")).join(spans, ["file", "part"]).where("at >= start AND at < successor").drop("part")
    inside = scratch.settle(inside, "inside")
    raw = found.where("raw IS NOT NULL").select("file", "block", "seq", "raw").join(inside, ["file", "block", "seq"]).select("file", "start", "at", "raw")
    if not inside.where("alone").isEmpty():
        # whole records inside of payloads: the files concerned are read again, by their own offsets
        wanted = inside.where("alone").select("file", "start", "at")
        again = pieces(spark, path, every_raw=True).join(F.broadcast(wanted.select("file").distinct()) if wanted.count() < BUCKETS else wanted.select("file").distinct(), "file", "left_semi")
        raw = raw.unionByName(with_offsets(again.select("file", "block", "seq", "size", "raw")).join(wanted, ["file", "at"]).select("file", "start", "at", "raw"))
    joined = (
        raw.groupBy("file", "start")
        .agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("s"))
        .select("file", "start", F.array_join(F.transform("s", lambda x: x["raw"].cast("string")), MAGIC).cast("binary").alias("raw"))
        .join(broken, ["file", "start"])
        .withColumn("content", F.expr("substring(raw, head_size + 1, length)"))
    )
    rejoined = _digested(joined).select("file", F.col("start").alias("offset"), *told, "payload_bytes", "payload_digest")
    return whole.unionByName(rejoined)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of ``pages``, read back from archives."""
    path = Scratch(spark, "archives").path("warc")
    archive(table(spark, sf_dir, "pages"), path)
    records = read_archive(spark, path).select(
        F.expr("try_cast(nullif(id, '') AS bigint)").alias("page_id"), "type", F.expr("try_cast(nullif(refers, '') AS bigint)").alias("refers_to"), "payload_bytes", "payload_digest"
    )
    full = records.where("type = 'response'").groupBy(F.col("page_id").alias("to")).agg(F.first("payload_bytes").alias("b"), F.first("payload_digest").alias("d"))
    full = Scratch(spark, "responses").settle(full, "responses")  # else its grouping keeps a hot response's revisits together
    return records.join(full, F.col("refers_to") == F.col("to"), "left").select(
        "page_id",
        F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("payload_digest", "d").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, b, max(page_id) AS top FROM p GROUP BY h, b),
c AS (SELECT page_id, b, top, list_transform(range(0, 8), lambda k: CAST('0x' || h[5 * k + 1:5 * k + 5] AS INTEGER)) AS q FROM p JOIN g USING (h, b))
SELECT page_id, b AS payload_bytes,
  array_to_string(list_transform(q, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), '')), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM c"""
