"""A bitmap of fixed size that tells which rows can't be looked for, so they need not be shuffled.

Its size is the same for any number of hashes; with very many it lets more
pass, never less, so joins behind it are right at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.columns import fresh
from samewise.plans.materialize import save


def sieve(hashes: DataFrame, bits: int) -> DataFrame:
    """One row, `sieve`: an array of longs in which the bit of each hash's (h) last `bits` bits is set."""
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    full = hashes.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("sieve"))


def _marked(df: DataFrame, h: Column, hashes: DataFrame, bits: int) -> tuple[DataFrame, Column, str]:
    """df beside the bitmap, whether h may be among hashes, and the bitmap's column; its one row goes to every executor."""
    name = fresh(df, "sieve")
    one = F.broadcast(save(sieve(hashes, bits), "sieve").withColumnRenamed("sieve", name))
    word = F.get(F.col(name), F.shiftright(h.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int"))
    bit = F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int"))
    return df.crossJoin(one), bit.bitwiseAND(F.lit(1)) == 1, name


def sifted(df: DataFrame, h: Column, hashes: DataFrame, bits: int) -> DataFrame:
    """The rows of df whose hash h may be among hashes (h)."""
    both, may, name = _marked(df, h, hashes, bits)
    return both.where(may).drop(name)


def parted(df: DataFrame, h: Column, hashes: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose hash h may be among hashes (h), and those whose can't; df is read for each."""
    both, may, name = _marked(df, h, hashes, bits)
    return both.where(may).drop(name), both.where(~may).drop(name)
