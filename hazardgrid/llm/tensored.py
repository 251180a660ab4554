"""Near copies by MinHash with tensored banding, verified on whole shingle sets.

Two small collections of ``SIDE`` minhash groups are computed for every set, not one large one: a table's
key is a pair of a group of the first collection and a group of the second, so ``SIDE ** 2`` tables of
``2 * WIDTH`` minhashes each come from ``2 * SIDE * WIDTH`` minhashes, about the square root of what
independent tables would need. A pair of similarity s shares a table unless one collection fails it
altogether, which has probability ``2 * (1 - s ** WIDTH) ** SIDE`` at most: 2e-5 at the threshold, 4e-7 at
0.9. A group that only one set has cannot be part of a shared key, so pairs are formed only of groups
that occur twice.

Sets that share a table are candidates, but a table never pairs its members. First each table compares
all of them with one leader, the one with the largest tables in all (in a group of near copies mostly their
origin). All members that one leader met form its group; a group that hangs together is done. In an open
group members of different components are compared, block by block: a task holds two blocks of at most
about ``ENTRIES`` shingles each and returns merges, never pairs, so a large group is many tasks and no
row is made per pair. Every link is confirmed on the whole sets.

A document's set holds its different three-word shingles (A-Z in lower case, ASCII blanks); a shorter
text is one shingle. Null, empty and blank texts have an empty set and link with nothing. Equal sets are one
row in the search, so copies cost nothing and always link. Rows with a null ``doc_id`` keep their row,
count for nobody's ``component_id`` (null if a component has no other) and are not kept. Repeated rows stay,
and so do ties: the smallest ``doc_id`` names a component. Shingles and sets are told apart by 64 and 128
hash bits. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import bounded_broadcast, components, python_ready, settle
from hazardgrid.llm.lines import name_of

WORDS = 3
#: Smallest similarity of linked sets, in percent.
PERCENT = 85
#: Groups in each of the two collections, and minhashes in a group.
SIDE, WIDTH = 12, 3
#: Shingles of the members of a block, about, and members of a block.
ENTRIES, MEMBERS = 400_000, 512
#: Words whose hashes a worker remembers; a full memory is emptied, which changes no result.
MEMORY = 500_000

_DRAWS = np.random.default_rng(11).integers(0, 2**64, (2, 2 * SIDE * WIDTH, 1), dtype=np.uint64)
_ODD = [np.uint64(c | 1) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


_HELD = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Different shingles of a text as ascending 64-bit hashes."""
    parts = (text or b"").lower().split()  # bytes: A-Z only, ASCII blanks only
    if not parts:
        return np.array([], np.uint64)
    if len(_HELD) > MEMORY:
        _HELD.clear()
    each = np.fromiter(map(_HELD.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = _mixed(out + each[j : j + n]) * _ODD[1]
    return np.unique(out)


def set_key(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def groups(found: np.ndarray) -> np.ndarray:
    """Keys of the minhash groups, a row for each of the two collections."""
    least = np.full(_DRAWS.shape[1], np.uint64(2**64 - 1))
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[at : at + 4096] * (_DRAWS[0] | np.uint64(1)) + _DRAWS[1]).min(axis=1))
    least = least.reshape(2 * SIDE, WIDTH)
    key = np.arange(2 * SIDE, dtype=np.uint64)
    for j in range(WIDTH):
        key = _mixed(key + least[:, j]) * _ODD[2]
    return key.view("<i8").reshape(2, SIDE)


def alike(shared: Column, n_a: Column, n_b: Column) -> Column:
    """Whether two sets of these sizes are linked, in whole numbers."""
    return 100 * shared >= PERCENT * (n_a + n_b - shared)


def outlines(docs: DataFrame) -> DataFrame:
    """``doc_id, row, key, n, a, b`` of every row: hash of the text, of its set, set size, group keys."""
    none = [None, 0, None, None]

    @F.pandas_udf("key binary, n int, a array<long>, b array<long>")
    def outline(texts: pd.Series) -> pd.DataFrame:
        sets = map(shingle_set, texts)
        rows = [[set_key(x), len(x), *groups(x)] if len(x) else none for x in sets]
        return pd.DataFrame(rows, columns=["key", "n", "a", "b"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", name_of(text).alias("row"), outline(text.cast("binary")).alias("o")).select("doc_id", "row", "o.*")


def tables(sets: DataFrame) -> DataFrame:
    """``key, id`` for every table that two sets share; ``sets`` has ``id, a, b``."""

    def shared(side: str) -> DataFrame:
        rows = sets.select("id", F.explode(side).alias(side))
        return rows.join(rows.groupBy(side).agg(F.count("*").alias("m")).filter("m > 1").select(side), side)

    rows = settle(shared("a").join(shared("b"), "id").select(F.xxhash64("a", "b").alias("key"), "id"))
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key")


def whole_sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, s`` with the whole set of every asked ``(row, id)``, made again from the text."""

    @F.pandas_udf("array<long>")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).view("<i8") for t in texts], dtype=object)

    text = F.coalesce("text", F.lit(""))
    met = docs.select(name_of(text).alias("row"), text.alias("text")).join(bounded_broadcast(asked), "row")
    return met.dropDuplicates(["id"]).select("id", whole(F.col("text").cast("binary")).alias("s"))


def confirmed(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The linked ones of ``(u, v, n_u, n_v)``; sizes alone rule most others out."""
    fit = (100 * F.col("n_u") >= PERCENT * F.col("n_v")) & (100 * F.col("n_v") >= PERCENT * F.col("n_u"))
    side = lambda c: whole.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))
    seen = pairs.filter((F.col("u") != F.col("v")) & fit).distinct().join(side("u"), "u").join(side("v"), "v")
    return seen.filter(alike(F.size(F.array_intersect("s_u", "s_v")), F.col("n_u"), F.col("n_v"))).select("u", "v")


def merges(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between positions in ``left`` and in ``right`` that join different labels, each join once."""
    if not len(left) or not len(right) or (label == label[0]).all():
        return []
    label, n = label.copy(), np.array([len(x) for x in sets])
    held = np.concatenate([sets[j] for j in right])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(len(right)), n[right])[order]
    out = []
    for i in left.tolist():
        lo, hi = np.searchsorted(held, sets[i]), np.searchsorted(held, sets[i], "right")
        many = hi - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(owner[at], minlength=len(right))
        near = (100 * shared >= PERCENT * (n[i] + n[right] - shared)) & (label[right] != label[i])
        for other in np.unique(label[right[near]]):
            out.append((i, int(right[near & (label[right] == other)][0])))
            label[label == other] = label[i]
    return out


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Merges among the rows of two blocks, or of one; small groups lie several in a task."""
    out = []
    for _, g in rows.groupby("lead", sort=False):
        sets, block = [np.asarray(x) for x in g.s], g.block.to_numpy()
        left, right = np.flatnonzero(block == g.i.iat[0]), np.flatnonzero(block == g.j.iat[0])
        ids = g.id.to_numpy()
        out += [(ids[a], ids[b]) for a, b in merges(sets, g.label.to_numpy(), left, right)]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def links(rows: DataFrame, sets: DataFrame, whole: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that connect what the links among the members of the tables connect.

    ``rows`` has ``key, id, m`` of shared tables, ``sets`` the size ``n`` of each ``id``.
    """
    weight = rows.groupBy("id").agg(F.sum("m").alias("weight"))
    lead = rows.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", -F.col("id"), "id")).alias("lead"))
    group = rows.join(lead.select("key", F.col("lead.id").alias("lead")), "key").filter("id <> lead")
    size = sets.select("id", "n")
    group = settle(group.select("lead", "id").distinct().join(size, "id"))
    star = group.join(size.select(F.col("id").alias("lead"), F.col("n").alias("n_u")), "lead")
    star = star.select(F.col("lead").alias("u"), F.col("id").alias("v"), "n_u", F.col("n").alias("n_v"))
    edges = settle(confirmed(star, whole))

    label = components(edges).withColumnRenamed("node", "id")
    group = settle(group.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
    count = group.groupBy("lead").agg(
        F.count("*").alias("m"), F.sum("n").alias("entries"), (F.min("label") < F.max("label")).alias("open")
    )
    blocks = F.greatest(F.ceil(F.col("entries") / ENTRIES), F.ceil(F.col("m") / MEMBERS)).cast("int")
    count = settle(count.filter("open").select("lead", "entries", blocks.alias("blocks")))
    bins = 1 + (count.filter("blocks = 1").agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]) // ENTRIES
    rest = group.join(count, "lead").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A large group is named by its leader, several small ones by the number of their bin, which is negative.
    rest = rest.withColumn("bin", F.when(F.col("blocks") > 1, F.col("lead")).otherwise(-1 - F.pmod(F.xxhash64("lead"), F.lit(bins))))
    rest = rest.select("lead", "id", "label", "bin", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rest = rest.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    found = rest.join(whole, "id").groupBy("bin", "i", "j").applyInPandas(_compared, "u long, v long")
    return edges.unionByName(settle(found))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    python_ready(docs.sparkSession)
    prints = settle(outlines(docs))
    sets = prints.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")
    )
    sets = settle(sets.withColumn("id", F.monotonically_increasing_id()))  # written at once, so ids stay
    rows = settle(tables(sets))
    asked = settle(sets.join(rows.select("id").distinct(), "id").select("row", "id"))
    whole = settle(whole_sets(docs, asked))
    label = components(links(rows, sets, whole)).withColumnRenamed("node", "id")
    named = sets.select("id", "key", "least").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = named.join(ids, "label").select("key", "component_id")
    out = prints.select("doc_id", "key", "n").join(ids, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"),
    )
