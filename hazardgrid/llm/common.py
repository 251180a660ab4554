"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardgrid.session import ship_package, work_path

#: Largest number of slim rows that a broadcast may hold; beyond it the join shuffles.
BROADCAST_ROWS = 50_000

#: Word separators of the contracts, as a regular-expression class and as characters.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
BLANKS_RE = "[\\x20\\x09-\\x0D]+"


def python_ready(spark: SparkSession) -> None:
    """Executors get the package, and Arrow batches stay small enough for long texts."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged.

    Give it a written table of slim rows: the count is an action.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words(text: Column) -> Column:
    """The words of the contracts; none for null and for texts of separators alone."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANKS_RE))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that their names cannot clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_print() -> Column:
    """Hash of the text, which tells documents apart that share an id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder, for the rounds of iterative joins.

    A checkpoint would keep what the optimizer knew of partitioning and order, and over rounds of
    self-joins that knowledge doubles; a table that is read again carries none.
    """
    at = work_path(df.sparkSession, "round")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def components(edges: DataFrame) -> DataFrame:
    """Least node of each connected component: ``(node, label)`` for every node of an edge ``(u, v)``.

    Each round hooks every node to its least neighbour, follows the hooks to their roots by doubling,
    and contracts the edges to the roots. A root is less than all its neighbours, so at most half of the nodes
    are roots, and the edge table shrinks until it is empty. Rounds are written to the shared folder.
    """
    edges = settle(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    )
    held = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("head"))
        up = _roots(settle(up))
        if held is None:
            held = up.withColumnRenamed("head", "label")
        else:
            moved = up.select(F.col("node").alias("label"), "head")
            held = held.join(moved, "label", "left").select("node", F.coalesce("head", "label").alias("label"))
            held = settle(held)
        edges = (
            edges.join(up.select(F.col("node").alias("u"), F.col("head").alias("hu")), "u")
            .join(up.select(F.col("node").alias("v"), F.col("head").alias("hv")), "v")
            .select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
            .filter("u < v")
            .distinct()
        )
        edges = settle(edges)
    if held is None:
        held = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return held


def _roots(up: DataFrame) -> DataFrame:
    """``(node, head)`` with every hook followed to its end; two doublings per written round."""
    while True:
        far = up
        for _ in range(2):
            over = far.select(F.col("node").alias("head"), F.col("head").alias("next"))
            far = far.join(over, "head").select("node", F.col("next").alias("head"))
        far = settle(far)
        same = up.select("node", F.col("head").alias("was")).join(far, "node").filter("was <> head").isEmpty()
        up = far
        if same:
            return up

