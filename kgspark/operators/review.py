"""Approving conflicts and invalidating sources, with their reports and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators import conflicts, facts, truth
from kgspark.sources.shared import stored


def detected(facts_: DataFrame, sources: DataFrame, known: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """New conflicts of all entities, or of those (entity_id) that an ingestion has just touched.

    In a stream this is what ``foreachBatch`` appends after each micro-batch.
    """
    rows = facts_ if touched is None else facts_.join(touched.select("entity_id").distinct(), "entity_id", "left_semi")
    return conflicts.unreported(conflicts.pairs(conflicts.candidates(rows, sources)), known)


def _audit(rows: DataFrame, user: Column, action: str, key: Column, kind: str, old: Column, new: Column, now: Column) -> DataFrame:
    return rows.select(user.alias("user_id"), F.lit(action).alias("action"), key.cast("string").alias("entity_id"), F.lit(kind).alias("entity_type"), old.alias("old_value"), new.alias("new_value"), now.alias("ts"))


def approved(facts_: DataFrame, queue: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The next facts and queue, the audit rows, and the decisions refused (id, reason).

    queue: id, entity_id, property, value_a, value_b, source_id_a, source_id_b, status, resolved_by, resolved_at;
    decisions: id, choice, user_id. The losing fact is the open one (under review or not) that was made last; without one,
    or with two decisions on one id, nothing of the decision happens.
    """
    d = decisions.groupBy("id").agg(F.first("choice").alias("choice"), F.first("user_id").alias("_by"), (F.count("*") > 1).alias("_twice"))
    met = d.join(queue, "id", "left")
    a = F.col("choice") == "a"
    win, lose = F.when(a, F.col("value_a")).otherwise(F.col("value_b")), F.when(a, F.col("value_b")).otherwise(F.col("value_a"))
    met = met.withColumns({"_win": win, "value": lose, "source_id": F.when(a, F.col("source_id_b")).otherwise(F.col("source_id_a"))})
    sides = ["entity_id", "property", "value", "source_id"]
    open_ = facts_.where("valid_to IS NULL").groupBy(*sides).agg(F.max_by("logical_id", F.struct("valid_from", "id")).alias("_logical"))
    reason = (
        F.when(F.col("_twice"), "DECIDED_TWICE").when(~F.coalesce(F.col("choice").isin("a", "b"), F.lit(False)), "INVALID_CHOICE").when(F.col("status").isNull(), "NOT_FOUND")
        .when(F.col("status") != "pending", "ALREADY_RESOLVED").when(F.col("_logical").isNull(), "LOSING_FACT_NOT_FOUND")
    )
    judged = stored(met.join(open_, sides, "left").withColumn("reason", reason))
    good = judged.where("reason IS NULL")
    after = facts.invalidate(facts_, good.select(F.col("_logical").alias("logical_id")), now)
    hit = queue.join(good.select("id", "_by"), "id", "left")
    done = F.col("_by").isNotNull()
    next_ = hit.withColumns({"status": F.when(done, "approved").otherwise(F.col("status")), "resolved_by": F.when(done, F.col("_by")).otherwise(F.col("resolved_by")), "resolved_at": F.when(done, now).otherwise(F.col("resolved_at"))})
    new = F.to_json(F.struct(F.lit("approved").alias("status"), "choice", F.col("_win").alias("winning_value"), F.col("value").alias("losing_value")))
    audit = _audit(good, F.col("_by"), "RESOLVE", F.col("id"), "Conflict", F.lit('{"status":"pending"}'), new, now)
    return after, next_.select(queue.columns), audit, judged.where("reason IS NOT NULL").select("id", "reason")


def dependents(facts_: DataFrame, edges: DataFrame, parents: DataFrame) -> DataFrame:
    """logical_id of the open INFERRED facts that hang on ``parents`` (logical_id): over an explicit edge (child, parent),
    or as facts of the same entity.

    The second kind goes over the distinct entities of the parents, so an entity of n facts gives n rows and not n * n.
    """
    inferred = facts_.where("valid_to IS NULL AND confidence = 'INFERRED'").select("logical_id", "entity_id").distinct()
    homes = facts_.join(parents.select("logical_id"), "logical_id", "left_semi").select("entity_id").distinct()
    children = edges.join(parents.select(F.col("logical_id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("logical_id"))
    own = inferred.join(children, "logical_id", "left_semi").union(inferred.join(homes, "entity_id", "left_semi").select(inferred.columns))
    return own.select("logical_id").distinct()


def reached(facts_: DataFrame, edges: DataFrame, direct: DataFrame, depth: int) -> DataFrame:
    """logical_id, depth of what hangs on ``direct`` in at most ``depth`` steps; a fact that is not INFERRED ends a path.

    One written table for each level; the smallest depth counts, so cycles end.
    """
    seen = direct.select("logical_id").distinct().withColumn("depth", F.lit(0))
    level = seen
    for n in range(1, depth + 1):
        level = stored(dependents(facts_, edges, level).join(seen, "logical_id", "left_anti").withColumn("depth", F.lit(n)))
        seen = seen.union(level)
    return seen.where("depth > 0")


def invalidated(facts_: DataFrame, sources: DataFrame, source_id, edges: DataFrame, reason: str, user: str, now: Column, depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The next facts and sources, a report (kind, fact_id) of what was invalidated and put under review, an audit row.

    edges: child, parent between facts. What is under review gets a new version with that status. Sources get (or keep)
    status, invalidation_reason, invalidated_by and invalidated_at. A blank reason and an unknown source are errors.
    """
    if not reason or not reason.strip():
        raise ValueError("reason must not be empty")
    if not 0 <= depth <= truth.MAX_DEPTH:
        raise ValueError(f"depth must be 0 to {truth.MAX_DEPTH}")
    if sources.where(F.col("id") == F.lit(source_id)).isEmpty():
        raise LookupError(f"source {source_id!r} not found")
    direct = stored(truth.derived_from(facts_, source_id).select("logical_id").distinct())
    review = reached(facts_, edges, direct, depth).select("logical_id")
    closed = facts.invalidate(facts_, direct, now)
    hit = closed.join(review.withColumn("_hit", F.lit(True)), "logical_id", "left")
    again = F.coalesce("_hit", F.lit(False)) & F.col("valid_to").isNull() & (F.col("confidence") == "INFERRED")
    marked = stored(hit.withColumn("_again", again).select(*facts_.columns, "_again"))
    old = marked.withColumns({"valid_to": F.when(F.col("_again"), now).otherwise(F.col("valid_to")), "status": F.when(F.col("_again"), "obsolete").otherwise(F.col("status"))})
    none = F.lit(None).cast(facts_.schema["valid_to"].dataType)
    new = marked.where("_again").withColumns({"id": F.concat("id", F.lit("+")), "valid_from": now, "valid_to": none, "status": F.lit("under_review")})
    next_ = old.select(facts_.columns).unionByName(new.select(facts_.columns))
    report = direct.select(F.lit("invalidated").alias("kind"), F.col("logical_id").alias("fact_id")).union(review.select(F.lit("under_review"), "logical_id"))
    source = _invalidated_source(sources, source_id, reason, user, now)
    counts = report.groupBy().pivot("kind", ["invalidated", "under_review"]).count().na.fill(0)
    detail = F.to_json(F.struct(F.lit(reason).alias("reason"), "invalidated", "under_review", F.lit(depth).alias("max_depth")))
    audit = _audit(counts, F.lit(user), "INVALIDATE_SOURCE", F.lit(source_id), "Source", F.lit(None).cast("string"), detail, now)
    return next_, source, report, audit


def _invalidated_source(sources: DataFrame, source_id, reason: str, user: str, now: Column) -> DataFrame:
    """``sources`` with one of them marked; what others say of themselves stays."""
    marks = {"status": F.lit("invalidated"), "invalidation_reason": F.lit(reason), "invalidated_by": F.lit(user), "invalidated_at": now}
    hit = F.col("id") == F.lit(source_id)
    return sources.withColumns({name: F.when(hit, mark).otherwise(F.col(name)) if name in sources.columns else F.when(hit, mark) for name, mark in marks.items()})


def snapshot(links: DataFrame, facts_: DataFrame, document_id) -> DataFrame:
    """logical_id, value of the current facts of a document's entities; ``facts.reconcile`` goes back to it.

    links: document_id, entity_id.
    """
    own = links.where(F.col("document_id") == F.lit(document_id)).select("entity_id").distinct()
    return facts.current(facts_).join(own, "entity_id", "left_semi").select("logical_id", "value")


def logical_id(facts_: DataFrame, key) -> DataFrame:
    """The logical id that a version's id or a logical id stands for."""
    return facts_.where((F.col("id") == F.lit(key)) | (F.col("logical_id") == F.lit(key))).select("logical_id").distinct()
