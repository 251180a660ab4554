"""Near-equal lines by a segment-partition edit join, and their removal from documents.

Lines link if one edit (a code point inserted, deleted or replaced) turns one into the other. With
threshold 1 a line has two segments, and of two linked lines one segment is equal in both: the left
one counted from the start or the right one counted from the end. Lines are indexed by (length,
segment, its text); probes go to their own length and to the next shorter one. What an index hit
leaves is one block that may differ, between an equal head and an equal tail. Candidates are verified
by a banded bit-parallel automaton: the five (2 * edits + 3) diagonals of a state are bits of a number.

A key that more than ``HOT`` lines share is not paired: its lines are indexed anew with the block that
may differ cut in half, again and again. Once it is a single code point, equal keys are the link itself:
such a group of mutually linked lines is held as (group, line), never as pairs, and a longer line is
looked up without the code points it may have too many. So no step emits the pairs of a group, and
no link is lost.

All steps are DataFrame expressions. Defined results: null text has no lines; blank lines (separators
only) take no part and stay; lines shorter than ``MIN_CHARS`` link only if equal. Repeated rows with the
same ``doc_id`` and text count as one document. A line's class is named by the least MD5 in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import BLANK, bounded_broadcast, components, settle, text_print, whole_row
from hazardgrid.session import cut_lineage

EDITS = 1
#: Shorter lines have to be equal.
MIN_CHARS = 20
#: Length for the rest of a string.
REST = 2**31 - 1
#: Lines that may share an index key before the key is refined.
HOT = 24


def split_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, print, line`` of every line with a word; ``pos`` counts all lines from 0.

    ``print`` hashes the text and so tells documents apart that share an id.
    """
    out = docs.select("doc_id", text_print().alias("print"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return out.filter(F.btrim("line", F.lit(BLANK)) != "")


def name_of(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _bounds(n: Column, level: Column, block: Column) -> tuple[Column, Column]:
    """Start and end of a block when ``n`` code points are cut into ``2 ** level`` blocks."""
    parts = F.shiftleft(F.lit(1), level) if isinstance(level, int) else F.expr("shiftleft(1, level)")
    return F.floor(n * block / parts).cast("int"), F.floor(n * (block + 1) / parts).cast("int")


def _key(line: Column, n: Column, level, block: Column, extra: int) -> Column:
    """Hash of all but one block, for a line of ``n + extra`` code points seen as one of ``n``.

    The head counts from the start and the tail from the end, so a longer line has its additional
    code point inside the block.
    """
    lo, hi = _bounds(n, level, block)
    head = F.substring(line, F.lit(1), lo)
    tail = F.substring(line, hi + 1 + extra, F.lit(REST))
    return F.xxhash64(n, block, head, tail)


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per different line: name, length, occurrences, first place and the four first keys."""
    n = F.length("line")
    keys = [
        F.when(n - e >= MIN_CHARS, _key(F.col("line"), n - e, 1, F.lit(b), e)).alias(f"k{e}{b}") for e in (0, 1) for b in (0, 1)
    ]
    own = lines.select(name_of(F.col("line")).alias("name"), n.alias("n"), F.struct("doc_id", "pos", "print").alias("place"), *keys)
    return own.groupBy("name").agg(
        F.first("n").alias("n"), F.count("*").alias("n_rows"), F.min("place").alias("first"),
        *[F.first(f"k{e}{b}").alias(f"k{e}{b}") for e in (0, 1) for b in (0, 1)],
    )


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two strings are within ``EDITS`` edits, by a banded bit-parallel automaton.

    Bit i of state k: the first ``j - w + i`` code points of ``a`` turn into the first ``j`` of ``b``
    with at most k edits, where w is half of the band. A step shifts whole states: a match keeps the
    diagonal, a replacement takes it from the state with one edit less, an insertion comes from the bit
    above, a deletion from the bit below in the new state.
    """
    w = EDITS + 1
    full = (1 << (2 * w + 1)) - 1
    x, y = F.split(a, ""), F.split(b, "")
    nx, ny = F.length(a), F.length(b)

    def step(s: Column, j: Column) -> Column:
        here = F.get(y, j)
        same = F.lit(0)
        for i in range(2 * w + 1):
            at = j - w + i
            same = same + F.when((at >= 0) & (at < nx) & (F.get(x, at) == here), 1 << i).otherwise(0)
        out, below = [], None
        for k in range(EDITS + 1):
            r = s[f"r{k}"].bitwiseAND(same)
            if k:
                less = s[f"r{k - 1}"]
                r = r.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(below, 1)).bitwiseAND(F.lit(full))
            out.append(r.alias(f"r{k}"))
            below = r
        return F.struct(*out)

    start = F.struct(*[F.lit(sum(1 << (w + p) for p in range(k + 1))).alias(f"r{k}") for k in range(EDITS + 1)])
    walk = F.when(ny > 0, F.sequence(F.lit(0), ny - 1)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(walk, start, step)[f"r{EDITS}"]
    gap = nx - ny
    bit = F.pow(F.lit(2), gap + w).cast("int")
    return (F.abs(gap) <= EDITS) & (last.bitwiseAND(bit) != 0)


def _around(start: Column, end: Column) -> Column:
    """Whether ``line_a`` and ``line_b`` agree before ``start`` and, counted from their ends, after ``end``."""
    a, b, e = F.col("line_a"), F.col("line_b"), F.col("extra")
    head = F.substring(a, F.lit(1), start) == F.substring(b, F.lit(1), start)
    return head & (F.substring(a, end + 1, F.lit(REST)) == F.substring(b, end + 1 + e, F.lit(REST)))


def _equal_half() -> Column:
    """Two segments again: of a block with one edit, one half is equal."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    return _around(F.col("lo"), mid) | _around(mid, F.col("hi"))


def narrowest(lo: Column, hi: Column, cells: int = 16) -> Column:
    """The first of ``cells`` parts of the block outside of which the lines agree, as ``(s, e)``, or null."""
    part = lambda k: F.floor(lo + (hi - lo) * k / cells).cast("int")
    found = F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: _around(part(k), part(k + 1)))
    k = F.get(found, 0)
    return F.when(k.isNotNull(), F.struct(part(k).alias("s"), part(k + 1).alias("e")))


def _explode_keys(rows: DataFrame) -> DataFrame:
    """``key, name, extra, n, level, block`` of the first level; ``n`` is the indexed length."""
    pairs = F.array(
        *[F.struct(F.col(f"k{e}{b}").alias("key"), F.lit(e).alias("extra"), F.lit(b).alias("block")) for e in (0, 1) for b in (0, 1)]
    )
    out = rows.select("name", "n", F.inline(pairs)).filter("key IS NOT NULL")
    return out.select("key", "name", "extra", (F.col("n") - F.col("extra")).alias("n"), F.lit(1).alias("level"), "block")


def _met(rows: DataFrame) -> DataFrame:
    """Rows whose key has an indexed line and another line, with the key's row count."""
    count = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum(1 - F.col("extra")).alias("own"))
    return rows.join(count.filter("m >= 2 AND own >= 1").select("key", "m"), "key")


def _pairs(cold: DataFrame) -> DataFrame:
    """Indexed line with every other line of its key; at most ``HOT`` partners each."""
    a = cold.filter("extra = 0").select("key", F.col("name").alias("a"), "n", "level", "block")
    b = cold.select("key", F.col("name").alias("b"), "extra")
    return a.join(b, "key").filter("extra = 1 OR a < b").drop("key")


def find_links(docs_lines: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified pairs ``(a, b)`` and groups of mutual links ``(key, name)``."""
    met = cut_lineage(_met(_explode_keys(distinct.filter(F.col("n") >= MIN_CHARS))))
    wanted = bounded_broadcast(cut_lineage(met.select("name").distinct()))
    texts = docs_lines.select(name_of(F.col("line")).alias("name"), "line").join(wanted, "name", "left_semi")
    texts = cut_lineage(texts.groupBy("name").agg(F.first("line").alias("line")))

    pairs, groups, looked = [_pairs(met.filter(F.col("m") <= HOT))], [], []
    hot = met.filter(F.col("m") > HOT).drop("m", "key")
    while not hot.isEmpty():
        lo, hi = _bounds(F.col("n"), F.col("level"), F.col("block"))
        single = (hi - lo) <= 1
        final = hot.filter(single & (hi > lo) & (F.col("extra") == 0)).join(texts, "name")
        rest = F.concat(F.substring("line", F.lit(1), lo), F.lit("\n"), F.substring(F.col("line"), hi + 1, F.lit(REST)))
        final = final.withColumn("key", name_of(rest))
        groups.append(final.select(F.struct("n", lo.alias("at"), "key").alias("key"), "name"))
        over = hot.filter(single & (F.col("extra") == 1)).join(texts, "name")
        for skip in (0, 1):  # the longer line without one of the code points of the block
            at = F.least(lo + skip, hi)
            less = F.concat(F.substring("line", F.lit(1), at), F.substring(F.col("line"), at + 2, F.lit(REST)))
            looked.append(over.select(name_of(less).alias("a"), F.col("name").alias("b")))
        left = hot.filter(~single).join(texts, "name").withColumn("block", F.explode(F.array(2 * F.col("block"), 2 * F.col("block") + 1)))
        left = left.withColumn("level", F.col("level") + 1)
        keys = [_key(F.col("line"), F.col("n"), F.col("level"), F.col("block"), e) for e in (0, 1)]
        left = left.withColumn("key", F.when(F.col("extra") == 0, keys[0]).otherwise(keys[1])).drop("line")
        left = settle(_met(left.select("key", "name", "extra", "n", "level", "block")))
        pairs.append(_pairs(left.filter(F.col("m") <= HOT)))
        hot = left.filter(F.col("m") > HOT).drop("m", "key")

    every = pairs[0]
    for p in pairs[1:]:
        every = every.unionByName(p)
    lo, hi = _bounds(F.col("n"), F.col("level"), F.col("block"))
    side = lambda c: texts.select(F.col("name").alias(c), F.col("line").alias(f"line_{c}"))
    seen = every.join(side("a"), "a").join(side("b"), "b")
    seen = seen.select("a", "b", "line_a", "line_b", "extra", lo.alias("lo"), hi.alias("hi"))
    cell = narrowest(lo=F.col("lo"), hi=F.col("hi"))
    seen = seen.filter(_equal_half()).select("a", "b", "line_a", "line_b", "extra", cell.alias("cell"))
    seen = cut_lineage(
        seen.filter("cell IS NOT NULL").select(
            "a", "b", F.substring(F.col("line_a"), F.col("cell.s") + 1, F.col("cell.e") - F.col("cell.s")).alias("x"),
            F.substring(F.col("line_b"), F.col("cell.s") + 1, F.col("cell.e") - F.col("cell.s") + F.col("extra")).alias("y"),
        )
    )
    seen = seen.filter(within_one_edit(F.col("x"), F.col("y")))
    linked = seen.select("a", "b")
    for look in looked:
        linked = linked.unionByName(look.join(texts.select(F.col("name").alias("a")), "a", "left_semi").select("a", "b"))
    mutual = None
    for g in groups:
        mutual = g if mutual is None else mutual.unionByName(g)
    if mutual is None:
        mutual = distinct.limit(0).select(F.struct("n", F.col("n").alias("at"), F.col("name").alias("key")).alias("key"), "name")
    return settle(linked.distinct()), settle(mutual.distinct())


def line_classes(docs: DataFrame) -> DataFrame:
    """``name, n, n_rows, first, class, n_links`` of every different line that holds a word."""
    lines = split_lines(docs)
    distinct = cut_lineage(distinct_lines(lines))
    linked, mutual = find_links(lines, distinct)
    lead = mutual.groupBy("key").agg(F.min("name").alias("u"), F.count("*").alias("m"))
    star = mutual.join(lead, "key").select("u", F.col("name").alias("v"), "m")
    edges = linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select("u", "v"))
    label = components(edges)
    ends = linked.select(F.explode(F.array("a", "b")).alias("name"), F.lit(1).cast("long").alias("k"))
    ends = ends.unionByName(star.select(F.col("v").alias("name"), (F.col("m") - 1).alias("k")))
    count = ends.groupBy("name").agg(F.sum("k").alias("n_links"))
    out = distinct.select("name", "n", "n_rows", "first")
    side = label.withColumnRenamed("node", "name").join(count, "name", "left")
    out = out.join(side, "name", "left")
    return out.select(
        "name", "n", "n_rows", "first", F.coalesce("label", "name").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` where of each line class only the line at the least (doc_id, position) is left.

    Blank lines stay. Documents that lose all their lines with words go; documents that had none
    stay as they are. ``n_chars``, if there, is counted anew. Other columns are kept. A document
    without an id counts as smaller than any other.
    """
    classes = cut_lineage(line_classes(docs).select("name", "class", "first", "n_rows"))
    keep = classes.groupBy("class").agg(F.min("first").alias("kept"), F.sum("n_rows").alias("m")).filter("m > 1")
    named = classes.join(keep, "class").select("name", "kept")
    lines = split_lines(docs).select("doc_id", "pos", "print", name_of(F.col("line")).alias("name"))
    gone = lines.join(bounded_broadcast(cut_lineage(named)), "name").filter(~F.struct("doc_id", "pos", "print").eqNullSafe(F.col("kept")))
    gone = gone.groupBy("doc_id", "print").agg(F.collect_set("pos").alias("_gone"))  # one document's lines
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "_gone")
    base = docs.select(whole_row(docs).alias("row"), "doc_id", "text")  # other columns may have any name
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_print() == F.col("_print"))
    out = base.join(gone, same, "left")
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = out.withColumn("text", text).filter((F.col("_gone").isNull()) | (F.btrim("text", F.lit(BLANK)) != ""))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast("long"))
    return out.select(row.alias("row")).select("row.*")
