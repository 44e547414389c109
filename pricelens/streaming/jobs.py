"""Structured Streaming jobs.

* T1 live price-drop alerts: ``streaming.live_alerts``; the streams it
  reads are here.
* T2 ``daily_last_stream``: last price per product-day over a 1-day
  tumbling window with a watermark; late ticks correct their day until the
  watermark passes it.
* T3 ``ingest_stream``: landed price pages -> decoded observations ->
  Parquet sink; the file sink and the checkpoint make the append
  exactly-once across restarts and lost executors.

``run_to_table`` drives a stream with ``availableNow`` (process what is
there, then stop) into a table under the shared checkpoint folder and
returns that table as a batch DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas as S
from ..operators import alerts as AL
from ..session import scratch_path
from ..sources import price_pages as PP


def tick_stream(spark: SparkSession, events_dir: str, file_glob: str = "*.parquet",
                schema: StructType | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Price ticks ``(product_name, ts, price, seq)`` from files in the
    driver's ``events`` layout arriving in ``events_dir`` (those matching
    ``file_glob``); any stream with those four columns works as well."""
    r = spark.readStream.option("pathGlobFilter", file_glob)
    if schema is None:
        schema = spark.read.option("pathGlobFilter", file_glob).parquet(events_dir).schema
    r = r.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    e = r.parquet(events_dir)
    return e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("product_name"),
                    F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
                    F.col("event_id").alias("seq"))


def request_stream(spark: SparkSession, events_dir: str, file_glob: str = "*.parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Subscribe requests carried by sign-up events in the driver's
    ``events`` layout (valid ones only); see ``adapters.subscription_requests``."""
    r = spark.readStream.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(events_dir).schema
    e = r.schema(schema).parquet(events_dir).where(F.col("event_type") == "signup")
    uid = F.col("user_id").cast("string")
    email = F.when(F.pmod(F.col("event_id"), F.lit(7)) == 0, F.concat(F.lit("u"), uid, F.lit(".example.com"))) \
        .otherwise(F.concat(F.lit("u"), uid, F.lit("@example.com")))
    req = e.select(email.alias("email"), F.concat(F.lit("user_"), uid).alias("product_name"),
                   (F.col("value") - 5.0).alias("target_price"), F.col("ts").cast("timestamp").alias("sub_ts"),
                   F.col("event_id").alias("seq"))
    return AL.validate_subscriptions(req).where("valid").drop("valid", "reason")


def daily_last_stream(ticks: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Last price of each product-day, incrementally."""
    g = ticks.withWatermark("ts", watermark).groupBy("product_name", F.window("ts", "1 day").alias("w"))
    agg = g.agg(F.max_by("price", F.struct("ts", "seq", "price")).alias("y"))
    return agg.select("product_name", F.to_date(F.col("w.start")).alias("ds"), "y")


def upsert_partitions(keys: tuple[str, ...], part_col: str) -> Callable[[DataFrame, str], None]:
    """A ``foreachBatch`` sink for update-mode streams: the partitions
    (``part_col`` values) a micro-batch touches are rewritten with its rows
    replacing the stored rows of the same ``keys``; other partitions are
    untouched.  Replaying a batch writes the same result (idempotent)."""
    from ..session import materialize

    def sink(batch: DataFrame, out: str) -> None:
        spark = batch.sparkSession
        # The batch is read twice below; keep it for this call only, so the
        # micro-batch (a stateful stage) is not computed twice.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            parts = [r[0] for r in batch.select(part_col).distinct().collect()]   # this batch's partitions
            if not parts:
                return
            try:
                old = spark.read.parquet(out).where(F.col(part_col).isin(parts))
                merged = old.join(batch, list(keys), "left_anti").unionByName(batch.select(*old.columns))
                merged = materialize(merged)   # cut the read of ``out`` before overwriting it
            except Exception as e:  # noqa: BLE001 - first batch: no table yet
                if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                    raise
                merged = batch
            (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(part_col).parquet(out))
        finally:
            batch.unpersist()
    return sink


def upsert_by_day(keys: tuple[str, ...] = ("product_name", "ds")) -> Callable[[DataFrame, str], None]:
    """``upsert_partitions`` for daily aggregates (partitioned by ``ds``)."""
    return upsert_partitions(keys, "ds")


def ingest_stream(spark: SparkSession, pages_path: str) -> DataFrame:
    """Decoded price observations from landed page files."""
    pages = spark.readStream.schema(S.PAGES).parquet(pages_path)
    rows, _ = PP.decode_price_pages(pages)
    return rows


def quarantine_stream(spark: SparkSession, pages_path: str) -> DataFrame:
    """The landed pages that give no observations ``(page_id, url,
    status)``; run it beside ``ingest_stream`` into a table of its own."""
    _, rejected = PP.decode_price_pages(spark.readStream.schema(S.PAGES).parquet(pages_path))
    return rejected


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, output_mode: str = "append",
                 sink: Callable[[DataFrame, str], None] | None = None, root: str | None = None) -> DataFrame:
    """Run ``stream`` with ``availableNow`` into a Parquet table in the
    shared checkpoint folder; return the table.

    Append mode uses the exactly-once file sink.  Complete mode rewrites the
    table from each micro-batch's result in ``foreachBatch`` (idempotent: a
    replayed batch writes the same rows).  A batch of update mode holds only
    the rows that changed, so that mode needs a keyed ``sink``.
    """
    if output_mode == "update" and sink is None:
        raise ValueError("update mode needs a keyed sink, or earlier batches would be lost")
    root = root or scratch_path(spark, f"stream-{name}")
    out, ckpt = f"{root}/table", f"{root}/checkpoint"
    w = stream.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode).trigger(availableNow=True)
    if output_mode == "append" and sink is None:
        q = w.format("parquet").option("path", out).start()
    else:
        def write_batch(batch: DataFrame, batch_id: int) -> None:
            (sink or (lambda b, p: b.write.mode("overwrite").parquet(p)))(batch, out)
        q = w.foreachBatch(write_batch).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out)
