"""Registry of named queries and the helpers that keep both engines' results comparable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as K
from ..sources.files import read_table, spread

TYPES = {
    "long": ("bigint", "BIGINT"), "str": ("string", "VARCHAR"), "dbl": ("double", "DOUBLE"), "dbl6": ("double", "DOUBLE"),
    "bool": ("boolean", "BOOLEAN"), "ts": ("timestamp_ntz", "TIMESTAMP"),
}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


HEAVY = {"documents", "pages", "conversations", "embeddings", "labels"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Texts and vectors get heavy per-row work, so a small file is spread over the cores."""
    df = read_table(spark, sf_dir, name)
    return spread(df) if name in HEAVY else df


def register(name: str, columns: str, sql: str | None = None):
    """Register a query with its result columns (``name type`` pairs) and its SQL check."""
    spec = [c.split() for c in columns.split(",")]

    def wrap(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df.select(*[_shown(F.col(c).cast(TYPES[t][0]), t).alias(c) for c, t in spec])

        QUERIES[name] = run
        if sql is not None:
            cast = lambda c, t: f"cast({c} as {TYPES[t][1]})"
            cols = ", ".join((f"round({cast(c, t)}, 6)" if t == "dbl6" else cast(c, t)) + f" as {c}" for c, t in spec)
            ORACLE[name] = f"select {cols} from ({sql}) as result"
        return build

    return wrap


def _shown(c, kind: str):
    """Scores are ranked at full precision and shown with six decimals."""
    return F.round(c, 6) if kind == "dbl6" else c


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_in(column: str, words) -> str:
    return f"{column} in ({', '.join(q(w) for w in words)})"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {q(K.WS_CHARS)})"


def sql_sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def sql_drop_space(expr: str) -> str:
    return sql_sub(expr, f"{K.S}+", "")


def sql_hash(expr: str) -> str:
    return f"md5({sql_strip(expr)})"
