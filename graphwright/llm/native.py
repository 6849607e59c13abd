"""Column expressions shared by the native operators: words, sizes and joins with small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import settled

BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[ \t-\r]"
#: Rows up to which a table that was counted may be broadcast; over it, the other side is salted.
BROADCAST_ROWS = 20_000
SALTS = 64


def whole(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; an empty array if there are none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def join_small(left: DataFrame, small: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """left outer join with a table of distinct keys: broadcast if it was counted as small, else salted by `spread`, so that one key's rows go to many tasks."""
    small = settled(small)
    if small.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), on, "left")
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"], "left").drop("__salt")
