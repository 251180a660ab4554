"""Random draws that depend on row keys only, so results do not change with partitioning.

A draw is the first 13 hexadecimal digits of the MD5 of the keys, which any SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(2**52)


def hash_uniform(seed: int, *keys) -> Column:
    """Uniform in (0, 1) from a hash of the keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(int(seed))), *[c.cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_SPAN)


def uniform_sql(seed: int, *keys: str) -> str:
    """``hash_uniform`` as check SQL."""
    text = f"concat_ws('|', '{int(seed)}', {', '.join(f'CAST({k} AS STRING)' for k in keys)})"
    return f"((CAST(CAST(concat('0x', substring(md5({text}), 1, 13)) AS BIGINT) AS DOUBLE) + 0.5) / {_SPAN!r}::DOUBLE)"


def hash_normal(seed: int, *keys) -> Column:
    """Standard normal by Box-Muller from two independent hash uniforms."""
    u1 = hash_uniform(seed, *keys, F.lit("radius"))
    u2 = hash_uniform(seed, *keys, F.lit("angle"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)


def normal_sql(seed: int, *keys: str) -> str:
    """``hash_normal`` as check SQL."""
    u1, u2 = (uniform_sql(seed, *keys, f"'{x}'") for x in ("radius", "angle"))
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


def clip(x: Column, lo=None, hi=None) -> Column:
    if lo is not None:
        x = F.greatest(F.lit(float(lo)), x)
    if hi is not None:
        x = F.least(F.lit(float(hi)), x)
    return x
