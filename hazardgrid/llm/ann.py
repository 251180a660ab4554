"""Approximate nearest neighbours by cosine: stable projections, kd-trees and a chi-square stop.

Unit vectors are projected by ``DIMS`` Gaussian directions. For a pair at distance d the squared
projected distance over d^2 is chi-square with ``DIMS`` degrees of freedom, so once the next
projected distance is so large that a closer point would have shown up earlier with probability
``CONFIDENCE``, the search stops. A kd-tree over the projections, fitted to a bounded sample, deals
all vectors to cells; each cell holds a kd-tree of its own. A query first searches its home cell, then
every other cell whose box the stopping test still admits, points in order of projected distance, each
verified on the original vectors in double precision.

Equal vectors share one row with their ``k + 1`` smallest ids, which is all that a result of ``k`` can
need, so a hot vector costs one row. Vectors that are null, empty, zero, hold a null or non-finite
component, differ in length from the most common length, or have no id take no part. Repeated ids
count once. With fewer than ``k`` candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import python_ready
from hazardgrid.operators.common import first_rows
from hazardgrid.session import cut_lineage

DIMS = 8
CONFIDENCE = 0.98
#: Vectors that shape the cells (a documented bound; every vector is indexed).
TREE_SAMPLE = 20_000
CELL_ROWS = 4_096
MAX_CELLS = 4_096
LEAF = 32


def chi_square_bound(confidence: float, dims: int) -> float:
    """x with P(chi-square of ``dims`` (even) degrees <= x) = ``confidence``."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        lo, hi = (x, hi) if 1 - tail < confidence else (lo, x)
    return hi


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def kd_split(points: np.ndarray, depth: int):
    """Nested ``(axis, value, low, high)`` of medians along the widest axis; a leaf is None."""
    if depth == 0 or len(points) < 2:
        return None
    axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
    value = float(np.median(points[:, axis]))
    left = points[:, axis] < value
    if not left.any() or left.all():
        return None
    return axis, value, kd_split(points[left], depth - 1), kd_split(points[~left], depth - 1)


def cell_of(tree, points: np.ndarray) -> np.ndarray:
    out = np.ones(len(points), np.int64)

    def walk(node, rows, at):
        if node is None:
            out[rows] = at
            return
        axis, value, low, high = node
        left = points[rows, axis] < value
        walk(low, rows[left], 2 * at)
        walk(high, rows[~left], 2 * at + 1)

    walk(tree, np.arange(len(points)), 1)
    return out


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a cell's kd-tree."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        own = points[rows]
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return done


def box_gap(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared projected distance from one point to boxes."""
    gap = np.maximum(np.maximum(lo - q, q - hi), 0.0)
    return np.einsum("ij,ij->i", gap, gap)


def search_cell(base: np.ndarray, proj: np.ndarray, qs: np.ndarray, qproj: np.ndarray, bound: np.ndarray, k: int, stop: float):
    """Per query the rows and cosines of its ``k`` best found in the cell.

    ``bound``: squared distance of the k-th best known so far. Leaves come in order of projected
    distance until the chi-square test holds against the k-th best squared distance.
    """
    parts = leaves(proj)
    lo = np.array([proj[r].min(axis=0) for r in parts])
    hi = np.array([proj[r].max(axis=0) for r in parts])
    for i in range(len(qs)):
        gaps = box_gap(qproj[i], lo, hi)
        order, worst = np.argsort(gaps), bound[i]
        best_rows, best = np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(order), 8):
            if gaps[order[at]] > stop * worst:
                break
            rows = np.concatenate([parts[j] for j in order[at : at + 8]])
            cos = base[rows] @ qs[i]
            best_rows, best = np.concatenate((best_rows, rows)), np.concatenate((best, cos))
            if len(best) > k:
                keep = np.argpartition(-best, k - 1)[:k]
                best_rows, best = best_rows[keep], best[keep]
            if len(best) == k:
                worst = min(worst, max(0.0, 2 - 2 * best.min()))
        yield i, best_rows, best


def usable(vec: str, dims: int | None = None) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    out = F.coalesce((F.size(vec) > 0) & ok & some, F.lit(False))
    return out if dims is None else out & (F.size(vec) == dims)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row where ``is_query``."""
    spark = vectors.sparkSession
    python_ready(spark)
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & usable("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], empty)
    dims = common.d
    rows = rows.filter(F.size("v") == dims)
    first = first_rows(rows.select("id", "v").distinct(), "v", [F.col("id")], k + 1)
    distinct = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = cut_lineage(distinct.withColumn("name", F.concat_ws(":", F.col("ids")[0], F.xxhash64("v"))))
    total = distinct.count()

    axes = np.random.default_rng(11).standard_normal((dims, DIMS))
    stop = chi_square_bound(CONFIDENCE, DIMS)
    sample = distinct.orderBy(F.xxhash64("name"), "name").limit(TREE_SAMPLE).select("v").collect()
    depth = max(0, math.ceil(math.log2(max(1, min(MAX_CELLS, total / CELL_ROWS)))))
    tree = kd_split(unit(np.array([r.v for r in sample], float)) @ axes, depth)

    @F.pandas_udf("cell long, p array<double>")
    def place(vs: pd.Series) -> pd.DataFrame:
        p = unit(np.array(vs.tolist(), float)) @ axes if len(vs) else np.empty((0, DIMS))
        return pd.DataFrame({"cell": cell_of(tree, p), "p": list(p)})

    placed = distinct.withColumn("at", place("v")).select("name", "v", "ids", "at.cell", "at.p")
    index = cut_lineage(placed)
    edge = [f(F.col("p")[i]).alias(f"{n}{i}") for i in range(DIMS) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = index.groupBy("cell").agg(*edge).orderBy("cell").collect()  # at most 2 * MAX_CELLS rows
    cells = np.array([b.cell for b in boxes])
    lo = np.array([[b[f"lo{i}"] for i in range(DIMS)] for b in boxes])
    hi = np.array([[b[f"hi{i}"] for i in range(DIMS)] for b in boxes])

    asked = rows.filter("q").select("id", "v").distinct()
    named = asked.join(index.select("name", "v", "cell", "p"), "v")
    named = cut_lineage(named)
    queries = named.select("name", "v", "cell", "p").dropDuplicates(["name"]).withColumn("bound", F.lit(4.0))
    found = "name string, ids array<long>, score double"

    def look(base: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(want):
            return pd.DataFrame({"name": [], "ids": [], "score": []}, dtype=object)
        b, q = unit(np.array(base.v.tolist(), float)), unit(np.array(want.v.tolist(), float))
        bp, qp = np.array(base.p.tolist()), np.array(want.p.tolist())
        names, ids, score = [], [], []
        for i, at, cos in search_cell(b, bp, q, qp, want.bound.to_numpy(float), k + 1, stop):
            names += [want.name.iloc[i]] * len(at)
            ids += [base.ids.iloc[j] for j in at]
            score += cos.tolist()
        return pd.DataFrame({"name": names, "ids": ids, "score": score}, dtype=object)

    def meet(q: DataFrame) -> DataFrame:
        slim = index.select("cell", "v", "p", "ids")
        return slim.groupBy("cell").cogroup(q.groupBy("cell")).applyInPandas(look, found)

    home = cut_lineage(meet(queries))
    reached = home.groupBy("name").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    bound = F.when(F.col("n") > k, F.greatest(2 - 2 * F.col("worst"), F.lit(0.0))).otherwise(4.0)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            take, at = [], []
            for i, (p, own, most) in enumerate(zip(batch.p, batch.cell, batch.bound)):
                hit = cells[(box_gap(np.asarray(p), lo, hi) <= stop * most) & (cells != own)]
                take += [i] * len(hit)
                at += hit.tolist()
            yield batch.iloc[take].assign(cell=np.array(at, np.int64))

    away = queries.drop("bound").join(reached.select("name", bound.alias("bound")), "name")
    away = away.select("name", "v", "cell", "p", "bound")
    both = home.unionByName(meet(away.mapInPandas(spread, away.schema)))
    best = first_rows(both, "name", [F.desc("score"), F.col("ids")[0]], k + 1)
    pairs = named.select(F.col("id").alias("query_id"), "name").join(best, "name")
    pairs = pairs.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = first_rows(pairs, "query_id", [F.desc("score"), F.col("vec_id")], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
