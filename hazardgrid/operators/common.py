"""Join and grouping shapes shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of group statistics that may be broadcast.
STATS_ROWS = 50_000


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Round, and turn a negative zero into zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, digits) + F.lit(0.0)


def as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def literal_array(values: Iterable, cast: str | None = None) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return arr.cast(f"array<{cast}>") if cast else arr


def attach_group_stats(df: DataFrame, keys, **aggs: Column) -> DataFrame:
    """Per-group statistics joined back to the rows.

    Used in place of a window over the whole group: the aggregate combines before its shuffle and
    the side joined back has one row per group, so a group with a third of all rows stays spread. That
    side is broadcast if it has at most ``STATS_ROWS`` rows, so the rows themselves are not shuffled;
    beyond that the join shuffles, and adaptive execution splits skewed partitions.
    """
    from hazardgrid.session import cut_lineage

    keys = as_list(keys)
    stats = cut_lineage(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]))
    small = stats.limit(STATS_ROWS + 1).count() <= STATS_ROWS
    return df.join(F.broadcast(stats) if small else stats, keys, "inner")


def salted_join(
    big: DataFrame, small: DataFrame, keys, spread: Sequence[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Equi-join whose key has few distinct values on the big side.

    The big side gets a salt from ``spread`` columns and the small side is repeated once per salt,
    so that one hot key is handled by ``salts`` tasks: unless given, an eighth of the shuffle
    partitions, 4 to 256. ``how`` may be inner or left (big side kept).
    """
    keys = as_list(keys)
    if salts is None:
        salts = max(4, min(256, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def dealt_evenly(df: DataFrame, keys) -> DataFrame:
    """Rows dealt by ``keys`` over all shuffle partitions, before work whose cost lies in CPU time: adaptive execution
    would merge partitions of few bytes into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in as_list(keys)])


def first_rows(df: DataFrame, keys, order: Sequence[Column], n: int = 1, rank: str | None = None):
    """First ``n`` rows per group. The rank limit runs before the shuffle as well as after it."""
    from pyspark.sql import Window

    w = Window.partitionBy(*as_list(keys)).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def number_rows(df: DataFrame, order: Sequence[Column], keys=(), name: str = "rank") -> DataFrame:
    """Rows numbered 1, 2, ... in ``order``, within each group of ``keys`` or over all rows.

    Rows are dealt by range of (keys, order), so a large group is many tasks; each task numbers its own
    rows and adds the count of the ranges before. The ranges are written first, so that both uses see the
    same ones.
    """
    from pyspark.sql import Window

    from hazardgrid.session import cut_lineage

    keys = as_list(keys)
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = ranged.withColumn("_inside", inside).join(sizes, same)
    return out.withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)


def conditional_sums(prefix: str, values: Sequence[float], cond, amount: Column) -> list[Column]:
    """One sum per value, so that a list of thresholds needs no row multiplication."""
    return [
        F.sum(F.when(cond(F.lit(v)), amount)).alias(f"{prefix}{k}") for k, v in enumerate(values)
    ]


def unpivot_values(prefix: str, values: Sequence, name: str, out: str) -> Column:
    """The columns of ``conditional_sums`` as ``array<struct<name, out>>``, for ``inline``."""
    return F.array(
        *[
            F.struct(F.lit(v).alias(name), F.col(f"{prefix}{k}").alias(out))
            for k, v in enumerate(values)
        ]
    )

