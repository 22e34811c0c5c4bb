"""How good normalization and retrieval are, and whether that is good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import folded

#: The least ratio of round trips, of coverage against the manual pack, and of Recall@5.
GATES = {"roundtrip": 1.0, "relative_coverage": 0.90, "recall_at_5": 0.85}


def unit_counts(items: DataFrame) -> DataFrame:
    """Unit, n: observed units, the most frequent first."""
    return items.where("unit IS NOT NULL").groupBy("unit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit")


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def normalization(draft: DataFrame, golden: DataFrame) -> DataFrame:
    """One row: precision, recall, matches, draft_resolved, golden_resolved.

    draft, golden: doc, nth, item, resolved. A match is a mention that both resolve, to the same item after case folding.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where("resolved").select("doc", "nth", folded(F.col("item")).alias(name))

    met = side(draft, "a").join(side(golden, "b"), ["doc", "nth"], "full")
    counts = met.agg(F.count("a").alias("draft_resolved"), F.count("b").alias("golden_resolved"), F.count_if(F.col("a") == F.col("b")).alias("matches"))
    precision, recall = (F.round(_ratio(F.col("matches"), F.col(c), 1.0), 4) for c in ("draft_resolved", "golden_resolved"))
    return counts.select(precision.alias("precision"), recall.alias("recall"), "matches", "draft_resolved", "golden_resolved")


def coverage(rows: DataFrame, resolved: Column, right: Column) -> DataFrame:
    """One row: resolved, total, coverage (null without rows), precision_ (1 if nothing is resolved)."""
    n, total, good = F.count_if(resolved), F.count("*"), F.count_if(resolved & right)
    return rows.agg(n.alias("resolved"), total.alias("total"), F.round(F.try_divide(n, total), 9).alias("coverage"), F.round(_ratio(good, n, 1.0), 9).alias("precision_"))


def recall_at(golden: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """One row: recall, n: the share of golden (query_id, target_id) whose target is among a query's first k ranks."""
    hits = ranked.where(F.col("rank") <= k).select("query_id", "target_id", F.lit(1).alias("hit")).distinct()
    met = golden.join(hits, ["query_id", "target_id"], "left")
    return met.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"), F.count("*").alias("n"))


def gates(metrics: DataFrame) -> DataFrame:
    """Metric, value, passed for every gate, from one row of metrics; a metric that is missing fails."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) if m in metrics.columns else F.lit(None)).cast("double").alias("value"), F.lit(least).alias("least")) for m, least in GATES.items()])
    return metrics.select(F.inline(parts)).select("metric", "value", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)).alias("passed"))
