"""As-of join: for each request the latest row at or before its instant.

The join is written in two levels so that one key may hold a third of all rows. Time is cut into
buckets; within a (key, bucket) a running ``last`` finds the row, and only the last row of each
bucket is carried across buckets. Rows never meet in pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardgrid.operators.common import as_list


def asof_join(
    requests: DataFrame,
    rows: DataFrame,
    keys,
    request_t: str,
    row_t: str,
    payload: Sequence[str],
    bucket,
    tie: Sequence[str] = (),
    prefer: str = "last",
) -> DataFrame:
    """Requests with ``payload`` of the matching row (NULL when there is none).

    ``bucket`` maps a time column to a bucket column. Among rows of equal time the greatest ``tie``
    wins. ``prefer='first'`` finds the earliest row at or after the instant instead.
    """
    keys = as_list(keys)
    forward = prefer == "first"
    hit = F.struct(*[F.col(c) for c in payload])
    order = F.struct(F.col(row_t), *[F.col(c) for c in tie])
    pick = (F.min_by if forward else F.max_by)(hit, order)

    ver = rows.select(
        *keys, F.col(row_t).alias("_t"), F.struct(*[F.col(c) for c in tie] or [F.lit(0)]).alias("_tie"),
        hit.alias("_hit"), bucket(F.col(row_t)).alias("_b"),
    )
    req = requests.withColumn("_b", bucket(F.col(request_t)))

    edge = rows.groupBy(*keys, bucket(F.col(row_t)).alias("_b")).agg(pick.alias("_edge"))
    slots = req.select(*keys, "_b").distinct()
    across = Window.partitionBy(*keys).orderBy(F.col("_b").desc() if forward else F.col("_b"))
    carry = (
        slots.join(edge, [*keys, "_b"], "full")
        .withColumn(
            "_carry",
            F.last("_edge", ignorenulls=True).over(
                across.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(*keys, "_b", "_carry")
    )

    null_tie = ver.schema["_tie"].dataType
    mixed = ver.withColumn("_req", F.lit(None).cast(req.schema.simpleString())).unionByName(
        req.select(
            *keys, F.col(request_t).alias("_t"), F.lit(None).cast(null_tie).alias("_tie"),
            F.lit(None).cast(ver.schema["_hit"].dataType).alias("_hit"), "_b",
            F.struct(*[F.col(c) for c in req.columns]).alias("_req"),
        )
    )
    is_req = F.col("_req").isNotNull()
    if forward:
        inside = Window.partitionBy(*keys, "_b").orderBy(
            F.col("_t").desc(), is_req, F.col("_tie").desc()
        )
    else:
        inside = Window.partitionBy(*keys, "_b").orderBy(F.col("_t"), is_req, F.col("_tie"))
    found = (
        mixed.withColumn(
            "_near",
            F.last("_hit", ignorenulls=True).over(
                inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .filter(is_req)
        .select("_req.*", "_near")
    )
    got = F.coalesce(F.col("_near"), F.col("_carry"))
    out = found.join(carry, [*keys, "_b"], "left").withColumn("_got", got)
    keep = [F.col(c) for c in requests.columns]
    return out.select(*keep, *[F.col(f"_got.{c}").alias(c) for c in payload])


def quantile_bucket_of(rows: DataFrame, column: str, buckets: int = 64):
    """Buckets that each hold about as many of ``rows``, wherever their values pile up."""
    cuts = sorted(set(rows.approxQuantile(column, [k / buckets for k in range(1, buckets)], 0.001)))
    if not cuts:
        return lambda t: F.lit(0)
    edges = F.array(*[F.lit(float(c)) for c in cuts])
    return lambda t: F.size(F.filter(edges, lambda c: c <= t))


def width_bucket_of(width: float):
    return lambda t: F.floor(t / F.lit(float(width)))
