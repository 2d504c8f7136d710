"""Budget-capped admission of provider items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Limits of a provider and run, what differs by provider, and queue sizes above which nothing new is admitted.
LIMITS = {"requests": 6, "pages": 2, "occurrences": 15, "new_candidates": 8}
BUDGETS = {"spotify": {"new_candidates": 8}, "ticketmaster": {"new_candidates": 7}}
HIGH_WATER = {"identity_pending": 50, "identity_discovery_pending": 25, "retry_wait": 25, "needs_review": 100}


def admit_with_budget(items: DataFrame, queue: DataFrame, limits: dict[str, int] = LIMITS, high_water: dict[str, int] = HIGH_WATER,
    budgets: dict[str, dict[str, int]] = BUDGETS) -> DataFrame:
    """items(provider, position, page, creates_candidate, target_state) with `admitted` and the provider's stop_reason.

    A page is a request. Items are admitted in order of position up to the first that a cap stops: requests, then
    pages, occurrences, new candidates, and the queue size of its state (queue(state, n) and what was admitted since).
    budgets has the limits in which a provider differs. Windows see a provider's first rows alone, one more than may be
    admitted; those are taken before the shuffle too.
    """

    def cap(name: str):
        out = F.lit(limits[name])
        for provider, own in budgets.items():
            if name in own:
                out = F.when(F.col("provider") == provider, own[name]).otherwise(out)
        return out

    w = Window.partitionBy("provider").orderBy("position")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # the row after the occurrence cap stops, whatever it is: a provider's first rows tell where it stops
    first_rows = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limits["occurrences"] + 1)
    first_rows = first_rows.withColumn("_occ", F.col("_n") - 1).drop("_n")
    fresh = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(True))
    df = first_rows.withColumn("_fresh", fresh.cast("long"))
    new = F.col("creates_candidate").cast("long")
    df = df.withColumn("_pages", F.coalesce(F.sum("_fresh").over(before), F.lit(0))).withColumn("_new",
        F.coalesce(F.sum(new).over(before), F.lit(0)))
    own = Window.partitionBy("provider", "target_state").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    marks = items.sparkSession.createDataFrame(list(high_water.items()), "target_state string, high_water long")
    df = df.withColumn("_queued", F.coalesce(F.sum(new).over(own), F.lit(0)))
    df = df.join(queue.select(F.col("state").alias("target_state"), "n"), "target_state", "left").join(F.broadcast(marks), "target_state", "left")
    page = F.col("_fresh") == 1
    stop = (
        F.when(page & (F.col("_pages") >= cap("requests")), "request_budget_reached").when(page & (F.col("_pages") >= cap("pages")), "page_budget_reached")
        .when(F.col("_occ") >= limits["occurrences"],
            "occurrence_budget_reached").when(F.col("creates_candidate") & (F.col("_new") >= cap("new_candidates")), "new_candidate_budget_reached")
        .when(F.col("creates_candidate") & (F.coalesce("n", F.lit(0)) + F.col("_queued") >= F.col("high_water")),
            F.concat(F.lit("queue_high_water_reached:"), F.col("target_state")))
    )
    df = df.withColumn("_stop", stop)
    first = df.where("_stop is not null").groupBy("provider").agg(F.min(F.struct("position", "_stop")).alias("_first"))
    df = items.join(first, "provider", "left")
    return df.select(*items.columns, (F.col("_first").isNull() | (F.col("position") < F.col("_first.position"))).alias("admitted"),
        F.col("_first._stop").alias("stop_reason"))
