"""Helpers that write oracle SQL fragments matching Spark's exact decimal rules.

DuckDB turns ``avg(decimal)`` and ``decimal / int`` into DOUBLE, while Spark
keeps an exact DECIMAL (scale + 4) and rounds HALF_UP. To agree on the
``x.xx5`` boundaries the oracle redoes the arithmetic in integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def avg_round(col: str, scale: int = 2, digits: int = 2) -> str:
    """SQL for Spark's ``round(avg(col), digits)`` on a non-negative DECIMAL(p, scale).

    Spark: avg -> DECIMAL(p+4, scale+4) rounded HALF_UP, then round HALF_UP to
    ``digits``. Here: integer units of 10^-scale, rounded twice the same way.
    """
    inter = scale + 4
    units = f"CAST(round({col} * {10 ** scale}) AS HUGEINT)"
    s = f"sum({units})"
    n = f"count({col})"
    q = f"((2 * {s} * {10 ** (inter - scale)} + {n}) // (2 * {n}))"
    step = 10 ** (inter - digits)
    r = f"((2 * {q} + {step}) // {2 * step})"
    return f"CAST({r} AS DOUBLE) / {10 ** digits}"


def as_double(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def ts_text(expr: str) -> str:
    """Timestamp rendered like :func:`larder.plans.registry.comparable`."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def doubles(sql: str, *cols: str) -> str:
    """Wrap an oracle so the named DECIMAL columns come out as DOUBLE, the
    type :func:`larder.plans.registry.comparable` gives the Spark side."""
    repl = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM ({sql.strip()}\n) AS q_"


def _crc32(word: str) -> str:
    """CRC-32 of a string's UTF-8 bytes: per byte one xor and eight shifts."""
    hexes = f"hex(encode({word}))"
    byte = f"CAST('0x' || substr({hexes}, 2 * i + 1, 2) AS BIGINT)"
    steps = f"flatten(list_transform(range(0, length({hexes}) // 2), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) "
            f"WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END), 4294967295)")


def embedding_ctes(docs: str, name: str, dim: int = 64) -> str:
    """CTEs ending in ``{name}(id, embedding)``: hashed bag of words of ``docs`` (id, text), unit length."""
    return f"""{name}_tok AS (SELECT id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM {docs}),
{name}_word AS (SELECT w, {_crc32("w")} % {dim} AS b FROM (SELECT DISTINCT w FROM {name}_tok)),
{name}_cnt AS (SELECT id, b, count(*) AS n FROM {name}_tok JOIN {name}_word USING (w) GROUP BY id, b),
{name}_norm AS (SELECT id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM {name}_cnt GROUP BY id),
{name} AS (SELECT g.id, list(coalesce(n / norm, 0.0) ORDER BY i) AS embedding FROM (SELECT id, unnest(range({dim})) AS i FROM {docs}) g
  LEFT JOIN {name}_cnt c ON c.id = g.id AND c.b = g.i LEFT JOIN {name}_norm m ON m.id = g.id GROUP BY g.id)"""


def micro(col: str = "embedding") -> str:
    """A vector as text, in whole millionths."""
    return f"array_to_string(list_transform({col}, lambda x: CAST(round(x * 1000000) AS BIGINT)), ',')"


def micro_text(col: str) -> Column:
    """Spark twin of :func:`micro`."""
    return F.array_join(F.transform(col, lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",").alias(col)
