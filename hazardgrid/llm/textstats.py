"""Per-document counts that the quality operators share, as column expressions over whole texts.

Words are runs outside space and U+0009 to U+000D. Null and empty texts count zero everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import BLANK, words

#: Character classes that are counted.
SYMBOLS = "[#*$%&|<>]"
BANGS = "[!?]"
DIGITS = "[0-9]"
#: A-Z and the Latin-1 capitals.
CAPITALS = "[A-Z\u00c0-\u00d6\u00d8-\u00de]"


def held(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are in a class; several times faster than ``translate``."""
    return F.regexp_count(text, F.lit(letters)).cast("long")


def with_counts(docs: DataFrame, repeats: bool) -> DataFrame:
    """``docs`` without ``text``, plus the counts; give it only the columns that are needed; ``repeats`` adds ``n_repeat_words``.

    Three-word windows are compared by a 64-bit hash. Sorting them with their places puts equal
    windows side by side, so a text of n words costs n log n, and only texts whose windows are not
    all different are sorted.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_t", text).withColumn("_w", words(F.col("text")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    out = out.withColumn("_l", lines)
    counts = {
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.concat_ws("", "_w")).cast("long"),
        "n_symbols": held(F.col("_t"), SYMBOLS),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct("_w")).cast("long"),
        "n_capitals": held(F.col("_t"), CAPITALS),
        "n_bangs": held(F.col("_t"), BANGS),
        "n_digits": held(F.col("_t"), DIGITS),
    }
    out = out.withColumns(counts)
    if repeats:
        window = F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
        )
        out = out.withColumn("_g", F.when(F.col("n_words") >= 3, window).otherwise(F.array().cast("array<bigint>")))
        some = F.size(F.array_distinct("_g")) < F.size("_g")
        placed = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        out = out.withColumn("_p", F.when(some, placed).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
        twin = F.filter(
            "_p",
            lambda x, k: F.coalesce(F.get("_p", k - 1)["g"] == x["g"], F.lit(False))
            | F.coalesce(F.get("_p", k + 1)["g"] == x["g"], F.lit(False)),
        )
        out = out.withColumn("_d", twin)
        covered = F.flatten(F.transform("_d", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        out = out.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long"))
    return out.drop("text", "_t", "_w", "_l", "_g", "_p", "_d")


def share(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))




def features() -> dict[str, Column]:
    return {
        "mean_word_chars": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "bangs_per_word": share("n_bangs", "n_words"),
        "digit_share": share("n_digits", "word_chars"),
        "capital_share": share("n_capitals", "word_chars"),
        "distinct_word_share": share("n_distinct_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "words_per_line": share("n_words", "n_lines"),
        "n_words": F.col("n_words").cast("double"),
    }
