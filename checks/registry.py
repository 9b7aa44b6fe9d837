"""Registered queries and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DECIMALS = 6


def register(name: str, sql: str | None = None):
    """Register a query; its output is put in the types that both engines share."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(build(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def comparable(df: DataFrame) -> DataFrame:
    """Integers as bigint, fractions rounded, arrays as text."""

    def shown(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            column = F.round(column.cast("double"), DECIMALS) + F.lit(0.0)
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        return column.alias(field.name)

    return df.select(*(shown(field) for field in df.schema.fields))


def r6(expression: str) -> str:
    """SQL for a fraction in the shared form."""
    return f"(round(({expression})::DOUBLE, {DECIMALS}) + 0.0::DOUBLE)"


def h(text: str) -> int:
    """The 28-bit number that stands for chance in the recipes."""
    return int(hashlib.md5(text.encode()).hexdigest()[:7], 16)


def h_col(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def h_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 7))::BIGINT"


def text_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fill_sql(template: str, **parts: str) -> str:
    """SQL that fills a ``{name}`` template with expressions."""
    for name, expression in parts.items():
        template = template.replace("{" + name + "}", f"\x00{expression}\x00")
    pieces = template.split("\x00")
    shown = [p if at % 2 else text_sql(p) for at, p in enumerate(pieces)]
    return "(" + " || ".join(shown) + ")"
