"""Fill-in-middle transformation by in-place block rotation.

A text is cut into lines and two cuts, drawn from a hash of the document's id, give prefix, middle and
suffix. The text lies in one bytearray; the sentinels are inserted at the cuts, and segments change
places by rotation: two neighbours are exchanged by reversing each of them and then both together.
``restore`` reads the sentinels, inverts the same rotations and takes the sentinels out again, so it
needs no cut positions. A reversal swaps fixed-size chunks from both ends, so next to the bytearray it
holds two chunks, however long the text.

All work is on UTF-8 bytes, where lines and sentinels look the same as in code points. Defined results:
null text counts as empty; an empty text, and one that contains a sentinel, stays ``plain``. A null
``doc_id`` draws from the seed and the colon alone. Repeated rows give repeated results; no columns of
the input but these two are read, so names cannot clash. Text of any length is taken whole; a line
without an end is a unit like the others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import python_ready

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
#: Percent of the texts that are transformed, and percent of those that put the suffix first.
RATE, SPM_RATE = 100, 50
#: Bytes that a reversal holds from either end.
CHUNK = 1 << 16


def reverse(buf: np.ndarray, start: int, end: int) -> None:
    """Reverse ``buf[start:end]`` in place."""
    while end - start > 1:
        step = min(CHUNK, (end - start) // 2)
        left = buf[start : start + step].copy()
        buf[start : start + step] = buf[end - step : end][::-1]
        buf[end - step : end] = left[::-1]
        start, end = start + step, end - step


def exchange(buf: np.ndarray, start: int, mid: int, end: int) -> None:
    """Turn the neighbours ``[start:mid] [mid:end]`` into ``[mid:end] [start:mid]`` by three reversals."""
    reverse(buf, start, mid)
    reverse(buf, mid, end)
    reverse(buf, start, end)


def code_points(buf: np.ndarray) -> int:
    return int(np.count_nonzero((buf & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def line_ends(buf: np.ndarray) -> np.ndarray:
    """Byte positions behind every line; the last line may lack its end."""
    ends = np.flatnonzero(buf == 10) + 1
    if len(buf) and (not len(ends) or ends[-1] != len(buf)):
        ends = np.append(ends, len(buf))
    return ends


def transform(text: bytes | None, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE):
    """``(n, form, output, prefix_chars, middle_chars)`` of one text; the last two None if it stays plain."""
    text = text or b""
    ends = line_ends(np.frombuffer(text, np.uint8))
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", text, None, None
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (lo, hi))
    held = bytearray(text)
    held[b:b] = SUFFIX
    held[a:a] = MIDDLE
    held[0:0] = PREFIX
    buf = np.frombuffer(held, np.uint8)
    a, b, end = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE), len(buf)  # starts of the middle and of the suffix
    prefix, middle = code_points(buf[len(PREFIX) : a]), code_points(buf[a + len(MIDDLE) : b])
    exchange(buf, a, b, end)
    form = "psm"
    if h4 % 100 < spm_rate:
        form = "spm"
        exchange(buf, 0, a, a + end - b)  # the suffix goes before the prefix
    return n, form, bytes(held), prefix, middle


def restore(output: bytes | None, form: str | None) -> bytes:
    """The text that ``transform`` was given, from its output and form alone."""
    output = output or b""
    if form in (None, "plain"):
        return output
    p, s, m = output.index(PREFIX), output.index(SUFFIX), output.index(MIDDLE)
    held = bytearray(output)
    buf = np.frombuffer(held, np.uint8)
    if form == "spm":
        exchange(buf, s, p, m)
        p, s = s, m - (p - s)
    exchange(buf, s, m, len(buf))
    b = s + len(buf) - m  # the middle lies at s again, the suffix behind it
    del buf  # a bytearray with a view cannot shrink
    del held[b : b + len(SUFFIX)]
    del held[s : s + len(MIDDLE)]
    del held[p : p + len(PREFIX)]
    return bytes(held)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, n, form, output, prefix_chars, middle_chars`` of every row."""
    python_ready(docs.sparkSession)

    @F.pandas_udf("n long, form string, output binary, prefix_chars long, middle_chars long")
    def turned(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        ids = (None if i is None else int(i) for i in ids)
        rows = [transform(t, i, seed, rate, spm_rate) for t, i in zip(texts, ids)]
        out = pd.DataFrame(rows, columns=["n", "form", "output", "prefix_chars", "middle_chars"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    # Ids travel as text: a null among whole numbers would make them floating point.
    made = docs.select("doc_id", turned(F.col("text").cast("binary"), F.col("doc_id").cast("string")).alias("made"))
    return made.select(
        "doc_id", "made.n", "made.form", F.col("made.output").cast("string").alias("output"), "made.prefix_chars", "made.middle_chars"
    )


def restored(output: Column, form: Column) -> Column:
    """The original text as a column, from a transformed text and its form."""

    @F.pandas_udf("binary")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return back(output.cast("binary"), form).cast("string")
