"""Loads of a source page by page: what to fetch, what of the landed pages counts, and a ledger that goes on where a load broke off.

The ledger has a row a source: since which stamp it is synced, and how far a load under way has come. Pages count while they follow one another without a hole; the stamp
moves only when the last page of its window is in. A full load that broke off goes on at its next index, an incremental one begins again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.operators.shared import written
from scanloom.operators.state import Versioned, sync_window, upserted

from .scans import batch_tag, each_batch

#: synced_until: null before the first whole load. full, since, until: the load under way; next_index: where its next page begins.
LEDGER = "source string, synced_until timestamp, full boolean, since timestamp, until timestamp, next_index bigint"
PAGE = "source string, start_index bigint, size bigint, total bigint"


def begun(sources: DataFrame, ledger: DataFrame, now: Column, lag_hours: int = 4) -> DataFrame:
    """The ledger with a load under way for each source (column source): a full one from where it stands, or the window since the last stamp from its first page."""
    rows = sources.select("source").distinct().join(ledger, "source", "left")
    window = sync_window(F.col("synced_until"), now, lag_hours)
    full = F.col("synced_until").isNull()
    until = F.timestamp_seconds(F.unix_timestamp(now) - lag_hours * 3600)
    return rows.select(
        "source", "synced_until", full.alias("full"), F.when(~full, window["since"]).alias("since"), F.when(full, until).otherwise(window["until"]).alias("until"),
        F.when(full, F.coalesce("next_index", F.lit(0))).otherwise(0).cast("bigint").alias("next_index"),
    )


def following(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """The pages (PAGE) that go on from their source's next index without a hole, each once, in whatever order they landed. Of pages that begin alike the largest counts."""
    once = pages.groupBy("source", "start_index").agg(F.max("size").alias("size"), F.max("total").alias("total"))
    rows = once.join(ledger.select("source", "next_index"), "source").where("start_index >= next_index")
    order = W.partitionBy("source").orderBy("start_index")
    expected = F.col("next_index") + F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("fits", F.col("start_index") == expected)
    return rows.withColumn("fits", F.bool_and("fits").over(order.rowsBetween(W.unboundedPreceding, 0))).where("fits").drop("fits", "next_index")


def advanced(ledger: DataFrame, pages: DataFrame) -> DataFrame:
    """The ledger after the pages of following(): the next index, or, once it has reached the total, the new stamp and no load under way. A page without rows ends its load too."""
    come = pages.groupBy("source").agg(F.sum("size").alias("n"), F.max_by("total", "start_index").alias("total"))
    rows = ledger.join(come, "source", "left").withColumn("at", F.col("next_index") + F.coalesce("n", F.lit(0)))
    done = F.coalesce(F.col("at") >= F.col("total"), F.lit(False))
    return rows.select(
        "source", F.when(done, F.col("until")).otherwise(F.col("synced_until")).alias("synced_until"), *[F.when(~done, F.col(c)).alias(c) for c in ("full", "since", "until")],
        F.when(~done, F.col("at")).cast("bigint").alias("next_index"),
    )


def load_stream(pages: DataFrame, table: Versioned, keys: list[str], order: str, ledger: Versioned, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Landed pages (PAGE and records, an array of rows of the table) into the table by key, and the ledger on.

    Records of pages behind a hole are not taken; their pages must land again, as a load asks for them from its next index. The table is published before the ledger under the batch's
    name: a batch that broke off between them is done again, and its upsert gives the same rows. Of a key's rows the last in `order` wins.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        tag = batch_tag(checkpoint, epoch)
        if ledger.tag() == tag:
            return
        state, landed = ledger.read(), written(batch, "pages")
        taken = written(following(landed, state), "pages-taken")
        if table.tag() != tag:
            records = landed.join(taken.select("source", "start_index"), ["source", "start_index"], "left_semi").select(F.explode("records").alias("r")).select("r.*")
            table.write(upserted(table.read(), records, keys, order), tag)
        ledger.write(advanced(state, taken), tag)

    return each_batch(pages, checkpoint, work, once)
