"""WARC archives of pages: written as plain record streams, read back through a verified chain of record boundaries.

Writing: each task streams its records into an uncompressed archive.  A record is the version line, header fields, an empty
line, the block (HTTP head and payload) and two line ends; Spark's text writer ends each value with the last of them.
Of records with equal payloads that with the smallest page_id is the response, the others are revisits, whose block
is the HTTP head alone.

Reading: the text reader splits archives at the version line, wherever it stands, so every piece is a candidate record
- also one that a payload only quotes.  Tasks emit each candidate's offset and the offset of its successor, which its
Content-Length names.  Pointer jumping from offset 0 of each file then keeps the candidates that the chain reaches; pieces
between them belong to the payload of the record before.

Edge cases: null html is an empty payload; null page_ids come after all others; rows with one payload and one smallest page_id
are all responses; an empty table gives no records; a chain that leaves the known candidates (a cut or damaged file) ends
there; urls keep no line ends; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.session import materialize, release

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"


def base32_sha1(payload: Column | str) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records_of(pages: DataFrame) -> DataFrame:
    """page_id, type, digest and the whole record (without its last line end) per page.

    The first page of each payload that several pages share is found by a partial aggregate of digests and stored.  Spark
    broadcasts that table while it is small and else joins by digest, where a payload that many pages share is split.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("about:blank")), "[\\r\\n]", "").alias("url"),
                        html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"))
    first = (rows.groupBy(F.unhex(F.sha1(F.col("html").cast("binary"))).alias("_sha1")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    joined = rows.join(materialize(first, "firsts"), F.unhex(F.sha1(F.col("html").cast("binary"))) == F.col("_sha1"), "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first_id"), F.col("page_id").isNull() & F.col("first_id").isNotNull())
    kind = F.when(revisit, "revisit").otherwise("response")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("html").cast("string"), F.lit(END))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    record = F.concat(F.lit(VERSION), F.lit("WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _name(F.col("page_id")),
                      F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
                      F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                                               _name(F.col("first_id")))).otherwise(F.lit("")),
                      F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
                      F.lit(END), block, F.lit("\r\n\r"))
    return joined.select("page_id", kind.alias("record_type"), "digest", record.alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives below `path`; each task writes the records of its pages into one archive."""
    records_of(pages).select("record").write.option("lineSep", "\n").text(path)


def _field(head: str, name: str) -> Column:
    return F.regexp_extract(head, f"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines, in reading order within each split of a file."""
    return (spark.read.option("lineSep", VERSION).text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("seq")))


def _parse(pieces: DataFrame) -> DataFrame:
    """Header fields, payload and completeness of pieces, by the header's own lengths."""
    payload = F.expr("substring(cast(value as binary), octet_length(head) + octet_length(http) + 9, length - octet_length(http) - 4)")
    parsed = pieces.withColumn("head", F.substring_index("value", END, 1))
    parsed = parsed.withColumn("length", _field("head", "Content-Length").try_cast("long"))
    parsed = parsed.withColumn("http", F.substring_index(F.expr("substring(value, char_length(head) + 5)"), END, 1))
    parsed = parsed.withColumn("payload", payload)
    return parsed.select(
        *[c for c in pieces.columns if c != "value"], "length", "payload",
        (F.octet_length("head") + 4).cast("long").alias("block_at"),
        (F.octet_length("value") >= F.octet_length("head") + 4 + F.col("length")).alias("complete"),
        _field("head", "WARC-Type").alias("record_type"),
        F.regexp_extract(_field("head", "WARC-Record-ID"), "<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract(_field("head", "WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract(_field("head", "WARC-Payload-Digest"), "sha1:(.*)", 1).alias("stated"),
        _field("http", "Content-Length").try_cast("long").alias("stated_bytes"),
        (F.octet_length("http") + 4).cast("long").alias("http_bytes"))


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """One small row per piece with a readable header: its offset in the file, its successor's offset, its fields.

    Offsets are sums of piece sizes: within a split of a file in reading order, then over the splits before it.
    """
    pieces = _pieces(spark, path).withColumn("step", (F.octet_length("value") + len(VERSION)).cast("long"))
    seen = materialize(_parse(pieces).withColumn("digest", base32_sha1("payload")).drop("payload"), "pieces")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = (seen.groupBy("file", "split").agg(F.sum("step").alias("n"))
             .select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    before = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # A piece stands behind its version line; the one at 0 stands before the first and is no record.
    offset = F.col("base") + F.coalesce(F.sum("step").over(before), F.lit(0)) - len(VERSION)
    found = seen.join(bases, ["file", "split"]).withColumn("offset", offset).where("offset >= 0")
    successor = F.col("offset") + len(VERSION) + F.col("block_at") + F.col("length") + len(END)
    table = materialize(found.withColumn("successor", successor).drop("base", "step", "block_at"), "candidates")
    release(seen)
    return table


def chained(candidates: DataFrame) -> DataFrame:
    """(file, offset) of those candidates (file, offset, successor) that the chain from offset 0 reaches.

    Pointer jumping: each round doubles both the reach and the length of the jumps, so n records take log2(n) rounds.
    Successors lie behind their records, so there are no cycles.
    """
    known = candidates.select("file", F.col("offset").alias("to"))
    jumps = materialize(candidates.select("file", "offset", F.col("successor").alias("to")).join(known, ["file", "to"], "left_semi")
                        .select("file", "offset", "to"), "jumps")
    reached = materialize(candidates.where("offset = 0").select("file", "offset"), "reached")
    while not jumps.isEmpty():
        more = reached.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        wider = materialize(reached.unionByName(more), "reached")
        far = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
        longer = materialize(jumps.join(far, ["file", "to"]).select("file", "offset", F.col("further").alias("to")), "jumps")
        release(jumps, reached)
        jumps, reached = longer, wider
    release(jumps)
    return reached


def _result(rows: DataFrame) -> DataFrame:
    own = F.col("record_type") == "response"
    return rows.select("page_id", F.when(own, F.col("length") - F.col("http_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
                       F.when(own, F.col("digest")).otherwise(F.col("stated")).alias("payload_digest"), "record_type", "refers_to")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every verified record below `path`.

    Digests of responses are computed from what was read.  Payloads that quote a version line come in several pieces; those
    records alone are put together again.
    """
    candidates = _candidates(spark, path)
    reached = chained(candidates)
    mark = reached.withColumn("reached", F.lit(True))
    records = candidates.join(reached, ["file", "offset"])
    whole = _result(records.where("complete"))
    torn = materialize(records.where("not complete").select("file", F.col("offset").alias("owner")), "torn")
    if torn.isEmpty():
        return whole
    along = Window.partitionBy("file").orderBy("offset")
    owned = (candidates.select("file", "split", "seq", "offset").join(mark, ["file", "offset"], "left")
             .withColumn("owner", F.last(F.when(F.col("reached"), F.col("offset")), ignorenulls=True).over(along))
             .join(torn, ["file", "owner"], "left_semi"))
    values = owned.join(_pieces(spark, path), ["file", "split", "seq"])
    joined = (values.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
              .select("file", "owner", F.array_join("parts.value", VERSION).alias("value")))
    return whole.unionByName(_result(_parse(joined).where("complete").withColumn("digest", base32_sha1("payload"))))
