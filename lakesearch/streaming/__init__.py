"""

A stream is an append-only log of events (kb, source_name, rel_path, ts).  Bursts on one path are put together with a
session window; when the window closes, the path is looked at again, whatever the events said, so late events only cause
another look.

Spark sends a batch again after a failure, with the same number.  What a batch makes is therefore stored under its number
(``Ledger``): a batch that comes again replaces what it made before, or, where its result is a segment of an index, finds
itself there and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import is_indexable
from ..operators.sync import KEY, key_of, manifest_diff, sync_paths

EVENTS = "kb string, source_name string, rel_path string, ts timestamp"
GAP, LATE = "2 seconds", "10 seconds"


class Ledger:
    """Tables below a folder, one part for each batch of a stream; a batch that is stored again takes the place of itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, stream: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{stream}/batch={batch_id}")

    def read(self, stream: str, schema: str) -> DataFrame:
        """All that ``stream`` has stored, with ``batch``."""
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{stream}")


def watch_source(spark: SparkSession, log: str, include: list[str] = (), exclude: list[str] = (), files_per_trigger: int = 1000) -> DataFrame:
    """A stream of events from a folder of JSON lines, of indexable paths only."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(log)
    return rows.filter(is_indexable(F.col("rel_path"), include, exclude))


def debounce_paths(events: DataFrame, gap: str = GAP, late: str | None = LATE) -> DataFrame:
    """One row for each burst on a path: number of events, last event and ``fires_at``, ``gap`` after it.

    On a stream rows appear once the watermark (``late`` behind the newest event) has passed ``fires_at``."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    bursts = rows.groupBy("kb", "source_name", "rel_path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_event"))
    return bursts.select("kb", "source_name", "rel_path", "n_events", "last_event", F.col("w.end").alias("fires_at"))


def watch_event_counts(events: DataFrame) -> DataFrame:
    """Accepted events by kb and source; complete or update mode on a stream."""
    return events.groupBy("kb", "source_name").agg(F.count("*").alias("n_events"))


def resync_on_fire(fired: DataFrame, listing: Callable[[], DataFrame], manifest: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """For each batch of fired paths, the actions against listing and manifest as they are now go to ``apply``, with the
    number of the batch, under which it stores them (see ``Ledger``)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        now = listing()
        apply(sync_paths(batch.select(*key_of(now)), now, manifest()), batch_id)

    return fired.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def poll_source(listings: DataFrame, manifest: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], pending: Ledger, checkpoint: str, failed: Callable[[Exception], None] = print, name: str = "polls", **trigger) -> StreamingQuery:
    """Whole listings of a source, told apart by ``listing`` (a growing number), that may come in any number of batches,
    are compared with the manifest as it is now, and the differences go to ``apply`` with the number of the listing.

    ``listings`` has the columns of a listing, ``listing`` and ``total``, the number of rows of that listing (a row with null keys
    tells of an empty one).  Rows wait in ``pending`` until all of a listing are there, so nothing is deleted because a batch
    doesn't hold it; of several complete listings the newest is compared, and each once, unless ``apply`` fails: an error is
    handed to ``failed``, and the next batch tries again."""
    done = f"{name}-done"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            pending.store(name, batch_id, batch)
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
            rows = pending.read(name, schema)
            last = pending.read(done, "listing long").agg(F.max("listing")).first()[0] if batch_id else None
            came = rows.groupBy("listing").agg(F.count_distinct(F.when(F.col("rel_path").isNotNull(), F.struct(*KEY))).alias("n"), F.max("total").alias("total"))
            newest = came.filter("n >= total").agg(F.max("listing")).first()[0]
            new = newest is not None and (last is None or newest > last)
            if new:
                whole = rows.filter((F.col("listing") == newest) & F.col("rel_path").isNotNull()).drop("listing", "total", "batch").dropDuplicates(KEY)
                apply(manifest_diff(whole, manifest()), newest)
            pending.store(done, batch_id, spark.createDataFrame([(newest,)] if new else [], "listing long"))
        except Exception as error:  # noqa: BLE001  a failed poll must not end the polling
            failed(error)

    return listings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def initial_then_live(sync: Callable[[], None], start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """A full sync first; live queries start only after it has succeeded."""
    sync()
    return start()


def managed_write_stream(writes: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch of writes goes through ``store`` with its number, under which it is stored (see ``Ledger``); what it has
    stored can be searched when the batch ends."""
    return writes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
