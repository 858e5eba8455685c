"""DuckDB SQL text for the expressions in ``exprs`` (used by oracle queries).

Each function returns a SQL fragment that computes exactly what its
namesake in ``catalog_engine.functions.exprs`` computes in Spark.
"""

from __future__ import annotations

from catalog_engine.functions.exprs import DRAW_DIGITS


def dbl(x: float) -> str:
    """A DOUBLE literal (a bare 0.5 is DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def hash_unit(key: str, seed: int) -> str:
    return (f"(CAST('0x' || left(md5(CAST({key} AS VARCHAR) || '|{seed}'), {DRAW_DIGITS}) AS BIGINT) "
            f"/ {dbl(16 ** DRAW_DIGITS)})")


def uniform_int(key: str, seed: int, lo: int, hi: int) -> str:
    return f"CAST({lo} + floor({hash_unit(key, seed)} * {dbl(hi - lo)}) AS INTEGER)"


def uniform_double(key: str, seed: int, lo: float, hi: float) -> str:
    return f"({dbl(lo)} + {hash_unit(key, seed)} * {dbl(hi - lo)})"


def is_test_row(key: str, test_share: float, seed: int) -> str:
    return f"({hash_unit(key, seed)} < {dbl(test_share)})"


def price_tier(price: str, lo: float, hi: float) -> str:
    return (f"CASE WHEN {price} <= {dbl(lo)} THEN 'Low' WHEN {price} <= {dbl(hi)} THEN 'Medium' "
            f"ELSE 'High' END")


def ratio(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), {dbl(0)})"


def pct(num: str, den: str, digits: int = 2) -> str:
    return f"round_even({dbl(100)} * {ratio(num, den)}, {digits})"


def equal_width_bin(x: str, lo: str, hi: str, n: int) -> str:
    return (f"CASE WHEN {hi} = {lo} THEN CAST(1 AS BIGINT) ELSE "
            f"least(CAST(floor(({x} - {lo}) / ({hi} - {lo}) * {dbl(n)}) AS BIGINT) + 1, "
            f"CAST({n} AS BIGINT)) END")


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
