"""points joined to the intervals they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, lo: str, hi: str, width: int = 86_400) -> DataFrame:
    """Points and intervals with equal ``on`` and ``lo <= at < hi``; a null ``hi`` is an open end, other nulls never meet.

    Time is cut into buckets, and both sides meet by (on, level, bucket) and are checked once. An interval goes to the level
    whose buckets (``width`` seconds, doubled from level to level) are no shorter than itself, so it lies in two of them at
    most; a point lies in one bucket of each level that occurs. No side gives more rows than that, however long the
    intervals and however few the keys are.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    last = points.agg(F.max(micros(at))).first()[0]
    stop = F.coalesce(micros(hi), F.lit((last or 0) + 1))
    spans = intervals.where(F.col(lo).isNotNull()).withColumns({"_lo": micros(lo), "_hi": stop}).where("_lo < _hi")
    unit = width * 1_000_000
    spans = spans.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2((F.col("_hi") - F.col("_lo")) / unit))).cast("int"))
    levels = [r[0] for r in spans.select("_level").distinct().collect()]  # of doubled widths: a few dozen at most

    def bucket(us: Column) -> Column:
        return F.floor(us / (F.pow(F.lit(2.0), F.col("_level")) * unit)).cast("long")

    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi") - 1)))).drop("_lo", "_hi")
    dealt = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bucket", bucket(micros(at)))
    met = dealt.join(spans, [*on, "_level", "_bucket"])
    return met.where((F.col(lo) <= F.col(at)) & (F.col(hi).isNull() | (F.col(at) < F.col(hi)))).drop("_level", "_bucket")
