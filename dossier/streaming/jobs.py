"""The job table as plans over one snapshot: claim, beat, requeue, cancel, finish, sweep. Times are milliseconds, passed in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Attempts, staleness and how long finished jobs stay.
ATTEMPTS, STALE_MS, KEPT_MS = 5, 90_000, 24 * 3600 * 1000
ENDED = ("done", "failed", "cancelled")


def enqueue(jobs: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """new: id, type, inputIds, meta."""
    fresh = new.withColumns({"state": F.lit("queued"), "progress": F.lit(0.0), "attempts": F.lit(0), "createdAt": F.lit(now), "updatedAt": F.lit(now)})
    return jobs.unionByName(fresh, allowMissingColumns=True)


def claim(jobs: DataFrame, owner: str, now: int) -> DataFrame:
    """All rows; the oldest queued job of each type is running for the owner. One writer commits the result."""
    oldest = jobs.where("state = 'queued'").groupBy("type").agg(F.min(F.struct("createdAt", "id")).alias("o")).select(F.col("o.id").alias("id"), F.lit(True).alias("__first"))
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    # The flag comes first: the other columns look at the state as it was.
    rows = jobs.join(oldest, "id", "left").withColumn("__hit", F.col("__first").isNotNull() & (F.col("state") == "queued"))
    hit = F.col("__hit")
    return rows.withColumns({"state": put("state", F.lit("running")), "owner": put("owner", F.lit(owner)), "attempts": put("attempts", F.coalesce("attempts", F.lit(0)) + 1), "startedAt": put("startedAt", F.lit(now)), "heartbeat": put("heartbeat", F.lit(now)), "updatedAt": put("updatedAt", F.lit(now))}).drop("__first", "__hit")


def beat(jobs: DataFrame, owner: str, now: int) -> DataFrame:
    return jobs.withColumn("heartbeat", F.when((F.col("owner") == owner) & F.col("state").isin("running", "cancelling"), F.lit(now)).otherwise(F.col("heartbeat")))


def requeue_stale(jobs: DataFrame, now: int) -> DataFrame:
    """Running jobs without a beat for too long go back, or fail once their attempts are used up; cancelling ones end."""
    stale = F.col("state").isin("running", "cancelling") & (F.coalesce("heartbeat", "startedAt", F.lit(0)) < now - STALE_MS)
    state = F.when(~stale, F.col("state")).when(F.col("state") == "cancelling", "cancelled").when(F.col("attempts") >= ATTEMPTS, "failed").otherwise("queued")
    return jobs.withColumns({"state": state, "owner": F.when(~stale, F.col("owner"))})


def cancel(jobs: DataFrame, chosen: DataFrame) -> DataFrame:
    rows = jobs.join(chosen.select("id", F.lit(1).alias("__c")), "id", "left")
    state = F.when(F.col("__c").isNull(), F.col("state")).when(F.col("state") == "queued", "cancelled").when(F.col("state") == "running", "cancelling").otherwise(F.col("state"))
    return rows.withColumn("state", state).drop("__c")


def finish(jobs: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """outcomes: id, ok, result, error, retry. A failure is tried again while attempts are left, unless retry is false."""
    o = outcomes.select("id", "ok", F.col("result").alias("__result"), F.col("error").alias("__error"), "retry")
    rows = jobs.join(o, "id", "left")
    state = (
        F.when(F.col("ok").isNull(), F.col("state"))
        .when(F.col("state") == "cancelling", "cancelled")
        .when(F.col("ok"), "done")
        .when(F.coalesce("retry", F.lit(True)) & (F.col("attempts") < ATTEMPTS), "queued")
        .otherwise("failed")
    )
    rows = rows.withColumn("state", state)
    ended = F.col("ok").isNotNull() & F.col("state").isin(*ENDED)
    return rows.withColumns({"result": F.coalesce("__result", "result"), "error": F.coalesce("__error", "error"), "finishedAt": F.when(ended, F.lit(now)).otherwise(F.col("finishedAt")), "progress": F.when(F.col("state") == "done", F.lit(1.0)).otherwise(F.col("progress"))}).drop("ok", "retry", "__result", "__error")


def sweep(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.where(~(F.col("state").isin(*ENDED) & (F.coalesce("finishedAt", "updatedAt") < now - KEPT_MS)))
