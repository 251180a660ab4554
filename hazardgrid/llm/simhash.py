"""Near copies by 64-bit fingerprints, found with vantage-point trees over the Hamming distance.

Fingerprints within ``RADIUS`` bits have a block of 16 bits that differs in at most one bit. Each of
the four blocks gets a vantage-point tree over the distance of that block; where a block cannot tell
fingerprints apart (many share it), the tree goes on with the distance of all 64 bits. The triangle
bound sends a fingerprint to every leaf that its ball meets, and each leaf compares what lies in it
with what visits it. A leaf returns a spanning forest of its links, never the pairs themselves.

Copies collapse to one fingerprint before the search, so a group of copies costs one row. Null and
empty texts have fingerprint zero and link like any other. Rows with a null ``doc_id`` keep their
row and count for nobody's ``component_id`` (null if a component has no other). Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import components, python_ready
from hazardgrid.session import cut_lineage

RADIUS = 4
BLOCKS = 4
#: Fingerprints that shape the trees (a documented bound; every fingerprint is searched).
TREE_SAMPLE = 20_000
LEAF_ROWS = 2_000
ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """Signed 64-bit fingerprint: bit set if set in over half of the shingle hashes."""
    parts = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, ASCII blanks only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(parts))
    first, last = starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(first)
    for at in range(0, n, 50_000):
        some = [digest(joined[a:b], 42) for a, b in zip(first[at : at + 50_000], last[at : at + 50_000])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row."""
    python_ready(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return docs.select("doc_id", of("text").alias("fp"))


def grow_tree(sample: np.ndarray, block: int, rows_per_sample: float, rng: np.random.Generator):
    """Nested ``(mask, radius, vantage, cut, inner, outer)``; a leaf is None."""
    narrow = np.uint64(0xFFFF << (16 * block))
    if len(sample) * rows_per_sample <= LEAF_ROWS or len(sample) < 8:
        return None
    best = None
    for mask, radius in ((narrow, RADIUS // BLOCKS), (ALL_BITS, RADIUS)):
        for vantage in rng.choice(sample, size=min(8, len(sample)), replace=False):
            d = np.bitwise_count((sample ^ vantage) & mask).astype(np.int64)
            cut = int(np.median(d))
            cut = cut - 1 if (d <= cut).mean() > 0.75 else cut
            inner, outer = (d - radius <= cut).mean(), (d + radius > cut).mean()
            if best is None or max(inner, outer) < best[0]:
                best = (max(inner, outer), mask, radius, vantage, cut, d)
        if best[0] < 0.9:
            break
    if best[0] > 0.97:
        return None
    _, mask, radius, vantage, cut, d = best
    return (
        mask, radius, vantage, cut,
        grow_tree(sample[d <= cut], block, rows_per_sample, rng),
        grow_tree(sample[d > cut], block, rows_per_sample, rng),
    )


def route(tree, fps: np.ndarray, home: np.ndarray, at: str, rows: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Leaf name, row numbers and whether the leaf is their home, for every leaf that a ball meets."""
    if not len(rows):
        return
    if tree is None:
        yield at, rows, home
        return
    mask, radius, vantage, cut, inner, outer = tree
    d = np.bitwise_count((fps[rows] ^ vantage) & mask).astype(np.int64)
    near, far = d - radius <= cut, d + radius > cut
    yield from route(inner, fps, (home & (d <= cut))[near], at + "0", rows[near])
    yield from route(outer, fps, (home & (d > cut))[far], at + "1", rows[far])


def gathered(batches: Iterator[np.ndarray], rows: int = 50_000) -> Iterator[np.ndarray]:
    """Larger batches, since the walk down a tree costs the same for a few rows as for many."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def leaf_forest(fps: np.ndarray, home: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(fp, root)`` of a spanning forest of the links between rows and home rows."""
    label = np.arange(len(fps))
    spots = np.flatnonzero(home)
    for k in range(0, len(fps), step):
        i, j = np.nonzero(np.bitwise_count(fps[k : k + step, None] ^ fps[spots][None, :]) <= RADIUS)
        a, b = label[i + k], label[spots[j]]
        while True:
            open_ = a != b
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
            a, b = label[a], label[b]
    linked = label != np.arange(len(fps))
    return fps[linked], fps[label[linked]]


def links(distinct_fps: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the fingerprints within ``RADIUS`` bits."""
    spark = distinct_fps.sparkSession
    python_ready(spark)
    total = distinct_fps.count()
    sample = distinct_fps.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()
    sample = np.array([r.fp for r in sample], "<i8").view("<u8")
    rng = np.random.default_rng(5)
    trees = [grow_tree(sample, b, total / max(1, len(sample)), rng) for b in range(BLOCKS)]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fps in gathered(b.fp.to_numpy("<i8").view("<u8") for b in batches):
            for b, tree in enumerate(trees):
                for at, rows, home in route(tree, fps, np.ones(len(fps), bool), f"{b}:", np.arange(len(fps))):
                    yield pd.DataFrame({"leaf": at, "fp": fps[rows].view("<i8"), "home": home})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        fps = group.fp.to_numpy("<i8").view("<u8")
        u, v = leaf_forest(fps, group.home.to_numpy(bool))
        return pd.DataFrame({"u": u.view("<i8"), "v": v.view("<i8")})

    # The rows are few bytes each but fan out: deal them to all tasks, whatever their size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = distinct_fps.select("fp").repartition(parts, "fp").mapInPandas(send, "leaf string, fp long, home boolean")
    return sent.groupBy("leaf").applyInPandas(meet, "u long, v long")


def near_copies(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; components by links of ``RADIUS`` bits or fewer."""
    prints = cut_lineage(fingerprints(docs, shingle_words))
    per = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(per))
    named = per.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = named.join(ids, "label").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents that lead their component; of its repeated rows one stays; rows without a ``doc_id`` stay."""
    lead = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(lead, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))
