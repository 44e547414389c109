"""Live price alerts, exact by event time, as set-based micro-batches.

The state is a folder of append-only tables, one sub-folder per micro-batch:
accepted ``ticks`` and ``requests``, ``fires`` (the last row of an interval is
its current first fire, null when withdrawn), ``late`` (what was not used, and
why) and ``marks`` (the watermark).  A batch reads only what earlier batches
wrote and rewrites its own sub-folders, so a repeated batch gives the same
tables.

A batch asks for first fires twice, each one join of intervals with a time tree
of price minima (``operators.alerts.first_in``):

* subscriptions with a new request: all their open intervals, over the ticks
  newer than the watermark and the batch's own;
* all others of products with new ticks: over the batch's ticks.

An earlier fire replaces the stored one.  Nothing is held in a worker, and no
product is worked on as a whole: ticks meet intervals by (product, tree node).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as AL
from ..session import materialize, scratch_path

TABLES = {
    "ticks": "product_name string, ts timestamp, price double, seq long",
    "requests": "email string, product_name string, target_price double, sub_ts timestamp, seq long",
    "fires": "email string, product_name string, sub_ts timestamp, seq long, target_price double, fire_ts timestamp, fire_price double, fire_seq long",
    "late": "kind string, reason string, product_name string, ts timestamp, price double, seq long, email string, target_price double",
    "marks": "seen timestamp",
}
EVENT = "kind string, product_name string, ts timestamp, price double, seq long, email string, target_price double"


def events(ticks: DataFrame, requests: DataFrame) -> DataFrame:
    """Ticks (product_name, ts, price, seq) and requests (email, product_name,
    target_price, sub_ts, seq) as one stream."""
    t = ticks.select(F.lit("tick").alias("kind"), "product_name", "ts", "price", "seq", F.lit(None).cast("string").alias("email"),
                     F.lit(None).cast("double").alias("target_price"))
    r = requests.select(F.lit("request").alias("kind"), "product_name", F.col("sub_ts").alias("ts"), F.lit(None).cast("double").alias("price"),
                        "seq", "email", "target_price")
    return t.unionByName(r)


class AlertState:
    """The tables under ``root`` (a folder the cluster shares)."""

    def __init__(self, spark: SparkSession, root: str, lateness: str = "2 days"):
        self.spark, self.root, self.lateness = spark, root, lateness
        for name, schema in TABLES.items():  # so that every table can be read before its first batch
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}/batch=-1")

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        """A table's rows, those of batches up to ``upto`` if given."""
        rows = self.spark.read.schema(TABLES[name] + ", batch long").parquet(f"{self.root}/{name}")
        return rows if upto is None else rows.where(F.col("batch") <= upto)

    def _write(self, name: str, batch_id: int, rows: DataFrame) -> None:
        cols = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(*cols).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def fires(self, upto: int | None = None) -> DataFrame:
        """The current first fire of every interval that has one."""
        value = F.struct("target_price", "fire_ts", "fire_price", "fire_seq")
        last = self.table("fires", upto).groupBy(*AL.INTERVAL_KEY).agg(F.max_by(value, "batch").alias("f"))
        return last.select(*AL.INTERVAL_KEY, "f.*").where(F.col("fire_ts").isNotNull())

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        """Take the events of one micro-batch (columns of ``EVENT``).

        Events older than the watermark, and those without a time, price, key or
        target, go to ``late`` with the reason; repeated events count once.  The
        watermark is the latest tick time of earlier batches, none later than
        the clock, less the lateness: neither a request nor a tick from the
        future moves it."""
        mark = self.table("marks", batch_id - 1).agg(F.max("seen") - F.expr(f"INTERVAL {self.lateness}")).first()[0]
        behind = F.lit(False) if mark is None else F.col("ts") < F.lit(mark)
        tick = F.col("kind") == "tick"
        reason = (F.when(F.col("ts").isNull() | F.col("product_name").isNull(), "no time or product")
                  .when(tick & F.col("price").isNull(), "no price")
                  .when(~tick & (F.col("email").isNull() | F.col("target_price").isNull()), "no address or target")
                  .when(behind, "behind the watermark"))
        batch = batch.withColumn("reason", reason)
        # each branch below reads the batch; kept for this call only
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._write("late", batch_id, batch.where(F.col("reason").isNotNull()))
            good = batch.where(F.col("reason").isNull())
            self._write("ticks", batch_id, good.where(tick).dropDuplicates(["product_name", "ts", "seq", "price"]))
            known = self.table("requests", batch_id - 1).select(*AL.INTERVAL_KEY)
            fresh = good.where(~tick).withColumnRenamed("ts", "sub_ts").dropDuplicates(AL.INTERVAL_KEY)
            self._write("requests", batch_id, fresh.join(known, AL.INTERVAL_KEY, "left_anti"))
        finally:
            batch.unpersist()
        new_ticks = self.table("ticks", batch_id).where(F.col("batch") == batch_id)
        self._write("marks", batch_id, new_ticks.agg(F.max(F.least("ts", F.current_timestamp())).alias("seen")).where("seen IS NOT NULL"))
        self._write("fires", batch_id, self._changes(batch_id, new_ticks, mark))

    def _changes(self, batch_id: int, new_ticks: DataFrame, mark) -> DataFrame:
        requests = self.table("requests", batch_id)
        asked = requests.where(F.col("batch") == batch_id).select(*AL.SUB_KEY).distinct()
        ticked = new_ticks.select("product_name").distinct()
        requests = requests.drop("batch")
        # intervals of subscriptions with a new request; a later one ends the former
        own = materialize(AL.subscription_intervals(requests.join(asked, AL.SUB_KEY, "left_semi")))
        kept = self.table("ticks", batch_id)
        if mark is not None:
            kept = kept.where((F.col("ts") >= F.lit(mark)) | (F.col("batch") == batch_id))
        found = AL.first_in(own, kept.drop("batch"))
        stored = self.fires(batch_id - 1)
        if batch_id > 0:
            rest = AL.subscription_intervals(requests.join(ticked, "product_name", "left_semi").join(asked, AL.SUB_KEY, "left_anti"))
            if mark is not None:
                rest = rest.where(F.col("next_sub_ts").isNull() | (F.col("next_sub_ts") > F.lit(mark)))
            found = found.unionByName(AL.first_in(rest, new_ticks.drop("batch")))
            stored = materialize(stored.join(ticked, "product_name", "left_semi").unionByName(
                stored.join(ticked, "product_name", "left_anti").join(asked, AL.SUB_KEY, "left_semi")))
        # a stored fire that now lies behind the interval's end is withdrawn
        cut = own.select(*AL.INTERVAL_KEY, "next_sub_ts")
        held = stored.join(cut, AL.INTERVAL_KEY, "left").withColumn("out", F.coalesce(F.col("fire_ts") >= F.col("next_sub_ts"), F.lit(False)))
        fire = F.struct("fire_ts", "fire_seq", "fire_price")
        new = found.select(*AL.INTERVAL_KEY, F.col("target_price").alias("t1"), fire.alias("new"))
        old = held.select(*AL.INTERVAL_KEY, F.col("target_price").alias("t0"), fire.alias("old"), "out")
        both = old.join(new, AL.INTERVAL_KEY, "full")
        now = F.least(F.when(~F.col("out"), F.col("old")), F.col("new"))
        return both.withColumn("now", now).where(~F.col("now").eqNullSafe(F.col("old"))).select(
            *AL.INTERVAL_KEY, F.coalesce("t1", "t0").alias("target_price"), "now.*")


def run_alerts(spark: SparkSession, ticks: DataFrame, requests: DataFrame, lateness: str = "2 days",
               root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run both streams until they are read; ``(alerts, late)``: per interval
    that fires its first tick at or below the target, and the events that were
    not used, with the reason and the batch."""
    root = root or scratch_path(spark, "alerts")
    state = AlertState(spark, f"{root}/state", lateness)
    q = (events(ticks, requests).writeStream.option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).foreachBatch(state.advance).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return state.fires().drop("fire_seq"), state.table("late")
