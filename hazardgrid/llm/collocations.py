"""Phrases of two to four words by dynamic itemset counting.

The documents are dealt into ``SHARDS`` shards that are scanned again and again in a cycle. A phrase becomes
active when both its subphrases, without its last and without its first word, have reached the threshold;
from the next shard on it is counted, for exactly one cycle. So phrases of all lengths are counted
side by side in the same scans, and long ones start long before the short ones are complete.

The scans count by slots: each length has a table of fixed size, a phrase's hash names its slot, and a slot
that has reached the threshold counts as reached for all its phrases. A slot holds at least what each of
its phrases occurs, so nothing is missed; phrases that share a slot can only let others start for nothing.
Shards are written once as slot numbers of words, and a scan's tables are added up part by part. When every
slot has had its cycle, one pass over the texts counts exactly the phrases of reached slots, as strings.
The driver gets one bit a slot. Larger tables cost memory, smaller ones time; results are the same.

Defined results: null text counts as empty, null ``lang`` as ``und``. Only A-Z are lowered. Repeated rows count
as often as they occur. Ties of the rank are broken by the contract's order, so it is total. No documents
or no candidates give no rows. Texts are read whole; only ``doc_id, text, lang`` are read.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import python_ready, settle
from hazardgrid.operators.common import number_rows
from hazardgrid.session import work_path

LONGEST = 4
#: Occurrences that make a phrase a candidate.
THRESHOLD = 30
SHARDS = 4
#: Bits of a slot number: a length takes 16 MB of starts and 32 MB of counts in a worker.
SLOT_BITS = 24
#: Bits of a slot number within a part of a table.
PART_BITS = 18
#: Words that are counted at once in a task.
STRETCH = 300_000
#: A longer phrase with at least this percentage of a phrase's count covers it.
COVERED = 80
TOP = 2_000
NEVER = 255

#: Tables of starts that a worker has unpacked, the newest of each length.
_TABLES: dict[int, tuple[str, np.ndarray]] = {}

_MARK = b"\xff"  # between pieces; no byte of UTF-8
_BYTES = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + 10 * _MARK))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words whose slots a worker remembers; the others are hashed again.
MEMORY = 500_000
#: Where the count of a slot stops.
FULL = np.iinfo(np.uint16).max


def cut_words(texts: list[bytes]) -> list[bytes]:
    """The words of some texts with a mark between pieces."""
    return _MARK.join(texts).translate(_BYTES).replace(_MARK, b" \xff ").split()


class _WordSlots(dict):
    """Slots of a language's words, from 1; the mark between pieces is 0."""

    def __init__(self, lang: str, bits: int):
        self.seed, self.shift = xxhash.xxh64_intdigest(lang) >> 1, 64 - bits
        self[_MARK] = 0

    def __missing__(self, word: bytes) -> int:
        slot = max(1, xxhash.xxh64_intdigest(word, self.seed) >> self.shift)
        if len(self) < MEMORY:
            self[word] = slot
        return slot


def word_slots(words: list[bytes], held: _WordSlots) -> np.ndarray:
    return np.fromiter(map(held.__getitem__, words), np.int32, len(words))


def phrase_slots(first: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(k, slot, inside)`` at each place; ``inside`` says that the k words lie in one piece."""
    h, inside = first.astype(np.uint64), first > 0
    yield 1, first, inside
    for k in range(2, LONGEST + 1):
        if len(h) < 2:
            return
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _ODD + first[k - 1 :].astype(np.uint64) + np.uint64(1)
        inside = inside[:-1] & (first[k - 1 :] > 0)
        yield k, (((h ^ (h >> np.uint64(31))) * _ODD) >> np.uint64(64 - bits)).astype(np.int32), inside


def active_slots(first: np.ndarray, reached: list[np.ndarray], scan: int, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(k, slots)``, a slot for each occurrence of a phrase that is active in this scan."""
    before = None
    for k, slot, inside in phrase_slots(first, len(reached[0]).bit_length() - 1):
        if k == 1:
            start = np.zeros(len(slot), np.int32)
        else:
            allowed = reached[k - 2][before].astype(np.int32)
            start = np.maximum(allowed[:-1], allowed[1:])
        yield k, slot[inside & (start <= scan) & (scan < start + shards)]
        before = slot


def _packed(spark, table: np.ndarray):
    """A table of starts for the tasks; packed, since few slots are set."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))


def _unpacked(sent: list) -> list[np.ndarray]:
    for i, (name, packed) in enumerate(sent):
        if i not in _TABLES or _TABLES[i][0] != name:
            _TABLES[i] = name, np.frombuffer(zlib.decompress(packed.value), np.uint8)
    return [_TABLES[i][1] for i in range(len(sent))]


def _written_shards(docs: DataFrame, shards: int, bits: int) -> DataFrame:
    """``words, shard``: every text as slots of its words."""

    @F.pandas_udf("array<int>")
    def slots(langs: pd.Series, texts: pd.Series) -> pd.Series:
        held = {lang: _WordSlots(lang, bits) for lang in langs.unique()}
        return pd.Series([word_slots(cut_words([t]), held[lang]) for lang, t in zip(langs, texts)], dtype=object)

    place = work_path(docs.sparkSession, "shards")
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard")
    docs.select(slots("lang", "text").alias("words"), shard).write.partitionBy("shard").parquet(place)
    return docs.sparkSession.read.schema("words array<int>, shard int").parquet(place)


def _scanned(shard: DataFrame, sent: list, scan: int, shards: int) -> DataFrame:
    """``k, part, counts`` of the slots of active phrases, summed in each task; counts stop at ``FULL``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached, total, held, size = _unpacked(sent), {}, [], 0

        def add() -> None:
            for k, slots in active_slots(np.concatenate(held), reached, scan, shards):
                if len(slots):
                    at, many = np.unique(slots, return_counts=True)
                    if k not in total:
                        total[k] = np.zeros(len(reached[0]), np.uint16)
                    total[k][at] = np.minimum(total[k][at] + many, FULL)

        for batch in batches:
            for words in batch.words:
                held += [words, np.zeros(1, np.int32)]
                size += len(words) + 1
                if size > STRETCH:
                    add()
                    held, size = [], 0
        if held:
            add()
        for k, counts in total.items():
            width = min(len(counts), 1 << PART_BITS)
            parts = counts.reshape(-1, width)
            rows = [(k, p, zlib.compress(parts[p].tobytes(), 1)) for p in np.flatnonzero(parts.any(axis=1)).tolist()]
            yield pd.DataFrame(rows, columns=["k", "part", "counts"])

    return shard.select("words").mapInPandas(count, "k int, part int, counts binary")


def _summed(rows: DataFrame, threshold: int) -> DataFrame:
    """One row for each part of a table, with a bit for each slot that has reached the threshold."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(0, np.int64)
        for packed in group.counts:
            counts = np.frombuffer(zlib.decompress(packed), np.uint16)
            out = np.minimum(out + counts, FULL) if len(out) else counts.astype(np.int64)
        bits = zlib.compress(np.packbits(out >= threshold).tobytes(), 1)
        return pd.DataFrame([(group.k.iat[0], group.part.iat[0], zlib.compress(out.astype(np.uint16).tobytes(), 1), bits)])

    return rows.groupBy("k", "part").applyInPandas(add, "k int, part int, counts binary, bits binary")


def reached_slots(shards_table: DataFrame, threshold: int, shards: int, bits: int) -> list[np.ndarray]:
    """For each length, the first scan after a slot has reached the threshold, or ``NEVER``."""
    spark = shards_table.sparkSession
    if LONGEST * shards >= NEVER or threshold > FULL:
        raise ValueError("too many shards, or too high a threshold, for the tables")
    reached = [np.full(1 << bits, NEVER, np.uint8) for _ in range(LONGEST)]
    sent, changed, state, scan = [None] * LONGEST, set(range(LONGEST)), None, 0
    while True:
        for i in changed:
            if sent[i] is not None:
                sent[i][1].destroy()  # what needed it is written
            sent[i] = _packed(spark, reached[i])
        rows = _scanned(shards_table.filter(F.col("shard") == scan % shards), sent, scan, shards)
        state = settle(_summed(rows if state is None else rows.unionByName(state.drop("bits")), threshold))
        changed = set()
        for row in state.select("k", "part", "bits").toLocalIterator():  # 32 KB a part before packing
            new = np.unpackbits(np.frombuffer(zlib.decompress(row.bits), np.uint8)).astype(bool)
            part = reached[row.k - 1].reshape(-1, min(1 << bits, 1 << PART_BITS))[row.part]
            new = new[: len(part)] & (part == NEVER)
            part[new] = scan + 1
            if new.any():
                changed.add(row.k - 1)
        scan += 1
        last = max([0, *(int(r[r != NEVER].max(initial=0)) for r in reached[:-1])])
        if scan >= last + shards:  # the phrases that started last have had their cycle
            for _, packed in sent:
                packed.destroy()
            return reached


def phrase_counts(lang: str, texts: list[bytes], reached: list[np.ndarray]) -> Iterator[tuple[int, list[str], list[int]]]:
    """``(k, phrases, counts)`` of the phrases whose slots, and those of their subphrases, are reached."""
    words = cut_words(texts)
    bits = len(reached[0]).bit_length() - 1
    number = defaultdict(itertools.count().__next__)
    number[_MARK]
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    first = word_slots(list(number), _WordSlots(lang, bits))[ids]
    yield 0, [""], [int((ids > 0).sum())]
    v, before = np.int64(len(number)), None
    for k, slot, inside in phrase_slots(first, bits):
        known = inside & (reached[k - 1][slot] != NEVER)
        at = np.flatnonzero(known if before is None else known & before[:-1] & before[1:])
        code = ids[at]
        if k > 1:
            code = code * v + ids[at + 1]
        if k == 3:
            code = code * v + ids[at + 2]
        elif k == 4:  # numbers of the pairs, so that four words fit in 63 bits
            code = (np.unique(code, return_inverse=True)[1] * v + ids[at + 2]) * v + ids[at + 3]
        _, one, many = np.unique(code, return_index=True, return_counts=True)
        yield k, [b" ".join(words[i : i + k]).decode("utf-8", "replace") for i in at[one].tolist()], many.tolist()
        before = known


def count_phrases(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """``lang, k, phrase, c``: phrases of 1 to 4 words that occur ``threshold`` times, and all words at ``k`` 0."""
    spark = docs.sparkSession
    python_ready(spark)
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    docs = docs.select("doc_id", text, F.coalesce("lang", F.lit("und")).alias("lang"))
    reached = reached_slots(_written_shards(docs, shards, slot_bits), threshold, shards, slot_bits)
    sent = [_packed(spark, r) for r in reached]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, tables = defaultdict(list), defaultdict(int), _unpacked(sent)

        def rows(lang: str) -> Iterator[pd.DataFrame]:
            size[lang] = 0
            for k, phrases, counts in phrase_counts(lang, held.pop(lang), tables):
                out = pd.DataFrame({"phrase": pd.Series(phrases, dtype=object), "c": pd.Series(counts, dtype="int64")})
                out["lang"], out["k"] = pd.Series([lang] * len(out), dtype=object), k
                yield out[["lang", "k", "phrase", "c"]]

        for batch in batches:
            for lang, text in zip(batch.lang, batch.text):
                held[lang].append(text)
                size[lang] += len(text)
                if size[lang] > 6 * STRETCH:  # about so many bytes
                    yield from rows(lang)
        for lang in list(held):
            yield from rows(lang)

    found = docs.select("lang", "text").mapInPandas(count, "lang string, k int, phrase string, c long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c")).filter((F.col("c") >= threshold) | (F.col("k") == 0))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, covered: int = COVERED) -> DataFrame:
    """``lang, phrase, k, a, l, r, n, score`` of every candidate that no longer one covers."""
    counts = settle(count_phrases(docs, threshold))
    found = counts.filter("k > 1").select("lang", "phrase", "k", F.col("c").alias("a"), F.split("phrase", " ").alias("w"))
    part = counts.filter("k > 0").select("lang", "phrase", "c")
    piece = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("head", piece(F.lit(1), F.col("cut"))).withColumn("rest", piece(F.col("cut") + 1, F.col("k") - F.col("cut")))
    left = part.select("lang", F.col("phrase").alias("head"), F.col("c").alias("l"))
    right = part.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r"))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    score = F.expr(f"CAST({wide('a')} * 2000000 DIV ({wide('l')} + {wide('r')}) AS BIGINT)")
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    size, at = F.col("piece.size"), F.col("piece.at")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.struct(at.alias("at"), size.alias("size")))))
    inner = found.filter("k > 2").withColumn("piece", F.explode(spans))
    inner = inner.select("lang", F.array_join(F.slice("w", at, size), " ").alias("phrase"), "a")
    over = inner.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    free = best.join(over, ["lang", "phrase"], "left")
    free = free.filter(F.col("over").isNull() | F.expr(f"100 * {wide('over')} < {covered} * {wide('a')}"))
    words = counts.filter("k = 0").select("lang", F.col("c").alias("n"))
    return free.join(words, "lang").select("lang", "phrase", "k", "a", "best.l", "best.r", "n", "best.score")


def top_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each lang's first ``top`` candidates by score, count and phrase, with their ``rank`` from 1."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return number_rows(collocations(docs), order, "lang").filter(F.col("rank") <= top)
