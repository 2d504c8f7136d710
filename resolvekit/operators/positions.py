"""Where the reading of a provider's pages stands: what comes next, up to a bound, and the position after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STALE, AHEAD = "configuration_changed", "position_beyond_listing"


def acquire(items: DataFrame, checkpoints: DataFrame, configurations: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(taken, next, refused) for the checkpoint of each provider.

    items: provider, page, item_offset and what else they have; pages and offsets count from 0. checkpoints: checkpoint_id,
    provider, configuration_hash, revision, page, item_offset, exhausted: the next item to take, also in the middle of a
    page. configurations: provider, configuration_hash, as they are now.

    taken: the first `limit` items from the position on, with checkpoint_id. next: the checkpoint after them, one revision
    on: the place after the last one taken in its page, or the next page's start where the page ends there; exhausted
    where no item is left; where nothing was taken the position stays. refused: checkpoint_id, reason. A position of
    another configuration is stale (configuration_changed), and one beyond all items of its provider isn't trusted
    (position_beyond_listing) unless it is exhausted; from both nothing is taken and they get no next checkpoint.
    Of a provider's items those after the position are ranked up to the bound before they are shuffled.
    """
    place = F.struct("page", "item_offset")
    ends = items.groupBy("provider").agg(F.max(place).alias("_last"))
    now = configurations.select("provider", F.col("configuration_hash").alias("_now"))
    c = checkpoints.join(now, "provider", "left").join(ends, "provider", "left")
    stale = ~F.col("configuration_hash").eqNullSafe(F.col("_now"))
    ahead = ~F.col("exhausted") & (F.col("_last").isNull() | (place > F.col("_last")))
    why = F.when(stale, STALE).when(ahead, AHEAD)
    refused = c.where(why.isNotNull()).select("checkpoint_id", why.alias("reason"))
    good = c.where(why.isNull())
    at = good.select("checkpoint_id", "provider", place.alias("_at"), F.col("_last"))
    rest = items.join(at, "provider").where(place >= F.col("_at"))
    ranked = rest.withColumn("_n", F.row_number().over(Window.partitionBy("checkpoint_id").orderBy("page", "item_offset"))).where(F.col("_n") <= limit)
    taken = ranked.select("checkpoint_id", *items.columns)
    # the last one taken, and whether its page goes on
    stop = ranked.groupBy("checkpoint_id", "provider").agg(F.max(place).alias("_to"), F.first("_last").alias("_last"))
    pages = items.groupBy("provider", "page").agg(F.max("item_offset").alias("_end"))
    stop = stop.join(pages, (stop["provider"] == pages["provider"]) & (stop["_to.page"] == pages["page"])).select("checkpoint_id", "_to", "_last", "_end")
    within = F.col("_to.item_offset") < F.col("_end")
    moved = good.drop("_last").join(stop, "checkpoint_id", "left")
    page = F.when(F.col("_to").isNull(), F.col("page")).when(within, F.col("_to.page")).otherwise(F.col("_to.page") + 1)
    offset = F.when(F.col("_to").isNull(), F.col("item_offset")).when(within, F.col("_to.item_offset") + 1).otherwise(F.lit(0))
    done = F.when(F.col("_to").isNull(), F.lit(True)).otherwise(F.col("_to") == F.col("_last"))
    after = moved.select("checkpoint_id", "provider", "configuration_hash", (F.col("revision") + 1).alias("revision"), page.alias("page"), offset.alias("item_offset"), done.alias("exhausted"))
    return taken, after, refused
