"""WARC archives: written as text records, read back by verifying the chain of record boundaries.

A reader cannot trust the magic ``WARC/1.`` after a blank line, since a payload may contain it. Every
task lists the places that look like a record start, each with the place where its successor must
begin (header length + ``Content-Length``). Candidates that follow each other directly form runs; the
runs of a file form a functional graph (a run's only exit is the successor of its last record), and
pointer jumping from the file's start finds the runs, and with them the records, that are reachable.
The rest is payload.

Everything is DataFrame work over Spark's text source with the record boundary as line separator, so
any store that Spark reads will do, and uncompressed archives are split.

Defined results: null html is an empty payload; line breaks in a header value become spaces; a record
cut off by the end of its file has ``truncated`` true and the payload that is there; a file that does
not begin with a record has no records; an empty table writes no records and reads back none. Rows
repeated with the same ``page_id`` and payload are records of their own. Among equal payloads whose
ids are all null, all are responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardgrid.llm.common import bounded_broadcast, settle
from hazardgrid.operators.common import salted_join
from hazardgrid.session import cut_lineage

END = "\r\n\r\n"
START = "WARC/1."
BOUNDARY = END + START
#: Payloads shorter than this many bytes are never stored as revisits.
REVISIT_BYTES = 1000


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    clean = F.regexp_replace(value.cast("string"), "[\\r\\n]+", " ")
    return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), clean)).otherwise("")


def assign_revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``payload, payload_bytes, payload_digest, refers_to`` (null for responses)."""
    payload = F.coalesce("html", F.lit(""))
    named = pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    large = named.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
    lead = large.agg(F.max("page_id").alias("lead"), F.count("*").alias("n")).filter("n > 1 AND lead IS NOT NULL")
    lead = cut_lineage(lead.drop("n"))
    small = bounded_broadcast(lead)
    if small is lead:
        out = salted_join(named, lead, "payload_digest", ["page_id", "url"], "left")
    else:
        out = named.join(small, "payload_digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("lead"))
    return out.withColumn("refers_to", F.when(~own, F.col("lead"))).drop("lead")


def write_archives(records: DataFrame, path: str, compression: str = "none", date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of ``assign_revisits``; a revisit holds no payload."""
    again = F.col("refers_to").isNotNull()
    body = F.when(again, "").otherwise(F.col("payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.0"),
        _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise("response")),
        _header("WARC-Record-ID", urn("page_id")),
        _header("WARC-Refers-To", urn("refers_to")),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("X-Payload-Length", F.col("payload_bytes")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(body)),
        F.lit(END),
        body,
    )
    out = records.select(record.alias("value")).write.mode("overwrite").option("lineSep", END)
    out.option("compression", compression).text(path)


def _field(head: str, name: str) -> Column:
    got = F.regexp_extract(head, f"(?i)\\r\\n{name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(got != "", got)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between boundaries; ``pos`` rises along each split of a file."""
    raw = spark.read.option("lineSep", BOUNDARY).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value",
    )


def _with_head(pieces: DataFrame) -> DataFrame:
    """Header text after the magic; only the first piece of a file still has the magic in front."""
    lead = F.col("value").startswith(START)
    body = F.when(lead, F.substring("value", len(START) + 1, 2**31 - 1)).otherwise(F.col("value"))
    return pieces.withColumn("lead", lead).withColumn("body", body).withColumn("head", F.substring_index("body", END, 1))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece with its place ``at`` in the file, and for record starts the successor's ``next``.

    ``at`` counts to the first byte after the magic. ``run`` numbers stretches of candidates in one
    split that follow each other directly.
    """
    slim = _with_head(_pieces(spark, path)).select(
        "file", "block", "pos", "lead", F.octet_length("value").cast("long").alias("n"),
        F.octet_length("head").cast("long").alias("head_n"),
        (F.contains("body", F.lit(END)) & F.col("head").rlike("^[0-9]\\r\\n")).alias("whole_head"),
        F.expr(f"try_cast({_SQL_LENGTH} AS BIGINT)").alias("length"),
    )
    split = Window.partitionBy("file", "block").orderBy("pos")
    before = F.coalesce(F.sum(F.col("n") + len(BOUNDARY)).over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = (F.col("block") == 0) & (F.row_number().over(split) == 1)
    slim = slim.withColumn("before", before).withColumn("first", first)
    slim = slim.withColumn("at", F.col("before") + F.when(F.col("first") & F.col("lead"), len(START)).otherwise(0))
    ok = F.col("whole_head") & F.col("length").isNotNull() & (F.col("lead") == F.col("first"))
    need = F.col("head_n") + len(END) + F.col("length")
    slim = slim.withColumn("need", F.when(ok, need)).withColumn("next", F.col("at") + F.col("need") + len(BOUNDARY))
    follows = F.lag("next").over(split).eqNullSafe(F.col("at")) & F.col("next").isNotNull()
    slim = slim.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(split))
    slim = cut_lineage(slim)
    sizes = slim.groupBy("file", "block").agg(F.max(F.col("before") + F.col("n") + len(BOUNDARY)).alias("size"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    return slim.join(base, ["file", "block"]).select(
        "file", "block", "pos", "n", "lead", "need", "run", "first",
        (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("next")).alias("next"),
    )


_SQL_LENGTH = "nullif(regexp_extract(head, '(?i)\\\\r\\\\nContent-Length:[ \\\\t]*([0-9]+)', 1), '')"


def reachable(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``reach``: whether the piece starts a record on the chain from the file's start."""
    pieces = cut_lineage(pieces)
    starts = pieces.filter("next IS NOT NULL")
    runs = starts.groupBy("file", "block", "run").agg(F.min("at").alias("head"), F.max("next").alias("exit"))
    heads = starts.join(runs.select("file", "block", "run", "head"), ["file", "block", "run"])
    hop = runs.join(heads.select("file", F.col("at").alias("exit"), F.col("head").alias("to")), ["file", "exit"])
    hop = settle(hop.select("file", "head", "to", F.col("exit").alias("entry")))
    root = starts.filter("first").select("file", F.col("at").alias("head"), F.col("at").alias("entry"))
    seen, jump = settle(root.select("file", "head")), hop.select("file", "head", "to")
    while not jump.isEmpty():
        more = seen.join(jump, ["file", "head"]).select("file", F.col("to").alias("head"))
        seen = settle(seen.unionByName(more).distinct())
        twice = jump.select("file", F.col("head").alias("from"), F.col("to").alias("head")).join(jump, ["file", "head"])
        jump = settle(twice.select("file", F.col("from").alias("head"), "to"))
    entry = hop.join(seen, ["file", "head"]).select("file", F.col("to").alias("head"), "entry").unionByName(root)
    entry = entry.join(runs.select("file", "head", "block", "run"), ["file", "head"]).select("file", "block", "run", "entry")
    out = pieces.join(entry, ["file", "block", "run"], "left")
    reach = F.col("next").isNotNull() & F.coalesce(F.col("at") >= F.col("entry"), F.lit(False))
    return cut_lineage(out.withColumn("reach", reach).drop("entry"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records with ``record_type, record_id, refers_to, target_uri, content_digest, stated_length,
    payload, truncated``.

    Records whose bytes lie in one piece are taken from the scan as it is. The others (their payload
    contains the boundary) are put together from their pieces; ``collect_list`` there holds one record.
    """
    flagged = reachable(candidates(spark, path))
    body_n = F.col("n") - F.when(F.col("lead") & F.col("first"), len(START)).otherwise(0)
    flagged = flagged.withColumn("whole", F.col("reach") & (F.col("need") <= body_n))
    odd = cut_lineage(flagged.filter("NOT whole"))
    raw = _pieces(spark, path)
    place = ["file", "block", "pos"]
    direct = raw.join(bounded_broadcast(odd.select(*place)), place, "left_anti").select("value")

    split = Window.partitionBy("file", "block").orderBy("pos")
    latest = F.last(F.when(F.col("reach"), F.col("at")), ignorenulls=True)
    last_of = flagged.groupBy("file", "block").agg(F.max(F.when(F.col("reach"), F.col("at"))).alias("held"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of.select("file", "block", F.max("held").over(earlier).alias("carried"))
    owned = flagged.withColumn("own", latest.over(split)).join(carried, ["file", "block"])
    owned = owned.withColumn("owner", F.coalesce("own", "carried"))
    open_ = odd.filter("reach").select("file", F.col("at").alias("owner"))
    parts = cut_lineage(owned.join(open_, ["file", "owner"], "left_semi").select(*place, "owner", "at"))
    bytes_of = raw.join(bounded_broadcast(parts), place)
    joined = bytes_of.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("p"))
    joined = joined.select(F.array_join(F.col("p.value"), BOUNDARY).alias("value"))

    rec = _with_head(direct.unionByName(joined))
    length = F.expr(f"try_cast({_SQL_LENGTH} AS INT)")
    data = F.substring(F.col("body").cast("binary"), F.octet_length("head") + len(END) + 1, length)
    return rec.select(
        F.lower(_field("head", "WARC-Type")).alias("record_type"), _field("head", "WARC-Record-ID").alias("record_id"),
        _field("head", "WARC-Refers-To").alias("refers_to"), _field("head", "WARC-Target-URI").alias("target_uri"),
        _field("head", "WARC-Payload-Digest").alias("content_digest"),
        F.expr("try_cast(" + "regexp_extract(head, '(?i)\\\\r\\\\nX-Payload-Length:[ \\\\t]*([0-9]+)', 1) AS BIGINT)").alias("stated_length"),
        data.alias("payload"), (F.octet_length(data) < length).alias("truncated"),
    )
