"""Random numbers from counters: md5 of (seed, run, year, draw, keys), never rand().

A draw depends on its keys alone, so it is the same for any partitioning, after a retry, and in another SQL engine.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2 ** 52: thirteen hexadecimal digits.
SCALE = 4503599627370496


def counter(draw: str, *keys: Column, seed: int = 0, run: Column | int = 0, year: int = 0) -> Column:
    """The text whose md5 is the draw; more keys may follow, each after a bar."""
    run = F.lit(run) if isinstance(run, int) else run
    return F.concat_ws("|", F.lit(str(seed)), run.cast("string"), F.lit(str(year)), F.lit(draw), *[k.cast("string") for k in keys])


def uniform(draw: str, *keys: Column, seed: int = 0, run: Column | int = 0, year: int = 0) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(F.md5(counter(draw, *keys, seed=seed, run=run, year=year)), 1, 13), 16, 10).cast("bigint") / F.lit(float(SCALE))


def below(limit: float, start: bytes, keys: list[bytes]) -> list[bool]:
    """Whether the draw of each key is below a limit, for tasks that draw very many: `uniform` of the text start + key, whose md5 goes on from that of the start."""
    whole = math.ceil(limit * SCALE)  # exact, as SCALE is a power of two
    if not 0 < whole < SCALE:
        return [whole > 0] * len(keys)
    first, upto, out = hashlib.md5(start), bytes.fromhex(f"{whole:013x}0"), []
    for key in keys:
        d = first.copy()
        d.update(key)
        out.append(d.digest() < upto)
    return out


def uniform_sql(draw: str, *keys: str, seed: int = 0, run: str = "0", year: int = 0) -> str:
    """The same as DuckDB SQL."""
    text = ", ".join([f"'{seed}'", f"CAST({run} AS VARCHAR)", f"'{year}'", f"'{draw}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 13)) AS BIGINT) / {SCALE}.0::DOUBLE)"


def integer(u: Column, low, high) -> Column:
    """A whole number from low to high, both included."""
    low = F.lit(low) if not isinstance(low, Column) else low
    return (low + F.floor(u * (high - low + 1))).cast("int")


def poisson_table(mean: float) -> list[float]:
    """Cumulative chances of 0, 1, 2, ... up to far beyond the mean."""
    top = math.ceil(mean + 12 * math.sqrt(mean) + 20)
    out, total = [], 0.0
    for k in range(top + 1):
        # by logarithms: exp(-mean) alone is 0 from a mean of some 745 on
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
        out.append(total)
    return out


def weibull(u: Column, shape: float, scale: float) -> Column:
    return F.lit(scale) * F.pow(-F.ln(1 - u), F.lit(1 / shape))
