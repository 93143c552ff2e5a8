"""Waveforms: changes, edges, frames and replay. Waves are (signal, t, seq, value); seq orders changes of a time.

A few signals have most changes, so a signal isn't a task's unit: waves are dealt by ranges of (signal, time), windows stay within a
range, and a small table (a row for each signal of each range) carries values over from the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netframe.operators.components import dealt, dealt_by_range, written


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with the number of their range of (signal, *order), which has no ties; written, as the numbers must last."""
    return written(dealt_by_range(rows, "signal", *order).withColumn("_part", F.spark_partition_id()), "waves")


def _carried(ranged: DataFrame, order: list[str], value: str) -> DataFrame:
    """ranged with _carry: the value (a struct; null is none) of the last row that has any in its signal's earlier ranges."""
    ends = ranged.where(F.col(value).isNotNull()).groupBy("signal", "_part").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    parts = ranged.select("signal", "_part").distinct().join(ends, ["signal", "_part"], "left")
    earlier = Window.partitionBy("signal").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("signal", "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return dealt(ranged, "signal", "_part").join(dealt(carry, "signal", "_part"), ["signal", "_part"])


def _with_before(waves: DataFrame) -> DataFrame:
    """waves with _before: (value) of the signal's change before; null at its first."""
    ranged = _dealt(waves.withColumn("_v", F.struct("value")), ["t", "seq"])
    w = Window.partitionBy("_part", "signal").orderBy("t", "seq")
    return _carried(ranged, ["t", "seq"], "_v").withColumn("_before", F.coalesce(F.lag("_v").over(w), "_carry")).drop("_part", "_v", "_carry")


def changes(waves: DataFrame) -> DataFrame:
    """Only values that differ from the signal's one before; unknown is a value. A signal's first value is a change."""
    return _with_before(waves).where("_before is null or not (value <=> _before.value)").drop("_before").select(*waves.columns)


def edges(waves: DataFrame) -> DataFrame:
    """Rising edges: 0, then 1."""
    return _with_before(waves).where("_before.value = 0 and value = 1").drop("_before").select(*waves.columns)


def last_of_time(waves: DataFrame) -> DataFrame:
    """(signal, t, value): a time's last value of a signal."""
    return dealt(waves, "signal", "t").groupBy("signal", "t").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("signal", "t", "v.value")


def as_of(samples: DataFrame, waves: DataFrame, strictly_before: bool = False) -> DataFrame:
    """samples (signal, t) with the value that their signal has at t, or had before it.

    One range-dealt sort of both by (signal, t) instead of a range join: the last known value fills forward."""
    last = last_of_time(waves).select("signal", "t", F.lit(1 if strictly_before else 0).alias("k"), F.struct("value").alias("v"))
    asked = dealt(samples.select("signal", "t"), "signal", "t").distinct().select("signal", "t", F.lit(0 if strictly_before else 1).alias("k"), F.lit(None).cast(last.schema["v"].dataType).alias("v"), F.lit(True).alias("asked"))
    ranged = _dealt(last.withColumn("asked", F.lit(False)).unionByName(asked), ["t", "k"])
    w = Window.partitionBy("_part", "signal").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)
    held = _carried(ranged, ["t", "k"], "v").withColumn("held", F.coalesce(F.last("v", ignorenulls=True).over(w), "_carry"))
    return held.where("asked").select("signal", "t", F.col("held.value").alias("value"))


def mismatches(recorded: DataFrame, simulated: DataFrame) -> DataFrame:
    """(n, n_mismatched) over samples (signal, t, value) of both; unknown equals unknown."""
    side = lambda df, name: dealt(df.select("signal", "t", F.col("value").alias(name)), "signal", "t")
    joined = side(recorded, "a").join(side(simulated, "b"), ["signal", "t"])
    return joined.agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_mismatched"))


def run_text(codes: DataFrame, key: str, order: str, code: str) -> DataFrame:
    """(key, text): printable characters in order, repeats of the one before left out."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = codes.withColumn("_before", F.lag(code).over(w)).where(f"{code} between 32 and 126 and not ({code} <=> _before)")
    return fresh.groupBy(key).agg(F.expr(f"listagg(chr({code}), '') within group (order by {order})").alias("text"))


def counters(bits: DataFrame, modulus: int = 11, most: int = 3, taps: tuple[int, ...] = (1, 10, 11, 12)) -> DataFrame:
    """bits (user_id, event_id, bit) with a modulo counter of rows, a saturating count of ones, a sticky flag and the bits some rows back."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    tap: list[Column] = [F.lag("bit", k).over(w).alias(f"tap_{k}") for k in taps]
    return bits.select("user_id", "event_id", "bit", F.pmod(F.row_number().over(w) - 1, F.lit(modulus)).alias("modulo"), F.least(F.sum("bit").over(run), F.lit(most).cast("long")).alias("saturating"), F.max("bit").over(run).alias("sticky"), *tap)
