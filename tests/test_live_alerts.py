"""Live alerts are exact by event time whatever the arrival order, and every
event is either used or recorded."""

import datetime as dt
import random

from conftest import rows
from naive import first_fire_naive
from pyspark.sql import functions as F

from pricelens.session import scratch_path
from pricelens.streaming import live_alerts as LA

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def tick(hours, price, seq, product="P"):
    return ("tick", product, None if hours is None else at(hours), price, seq, None, None)


def request(email, hours, target, seq, product="P"):
    return ("request", product, at(hours), None, seq, email, target)


def run(spark, batches, lateness="2 days"):
    state = LA.AlertState(spark, scratch_path(spark, "t-alerts"), lateness)
    for i, batch in enumerate(batches):
        state.advance(spark.createDataFrame(batch, LA.EVENT), i)
    return state


def fires(state):
    return rows(state.fires(), "email", "seq", "fire_ts", "fire_price")


REQS = [request("a", 0, 90.0, 1), request("a", 72, 85.0, 2), request("c", 0, 95.0, 4)]
TICKS = [tick(24, 95.0, 10), tick(48, 88.0, 11), tick(71, 80.0, 12), tick(120, 80.0, 13)]
WANT = [("a", 1, at(48), 88.0), ("a", 2, at(120), 80.0), ("c", 4, at(24), 95.0)]


def test_arrival_orders(spark):
    """Subscribe 90, tick 95 (no), 88 (fires), 80 (silent), subscribe 85, tick 80
    (fires); an equal price fires."""
    assert fires(run(spark, [REQS + TICKS])) == WANT
    for order in (TICKS + REQS, [TICKS[3], REQS[0], TICKS[2], REQS[2], TICKS[1], REQS[1], TICKS[0]]):
        assert fires(run(spark, [order[:3], order[3:5], order[5:]], "300 days")) == WANT


def test_random_streams_equal_the_whole_and_a_repeated_batch_changes_nothing(spark):
    for seed in (5, 8):
        rng = random.Random(seed)
        ev = [request(rng.choice("xyz"), rng.randrange(50), float(rng.randrange(1, 20)), i, rng.choice("PQ")) for i in range(8)]
        ev += [tick(rng.randrange(60), float(rng.randrange(1, 30)), 100 + i, rng.choice("PQ")) for i in range(60)]
        rng.shuffle(ev)
        batches = [ev[:20], ev[20:45], ev[45:] + ev[:5]]
        state = run(spark, batches, "300 days")
        reqs = spark.createDataFrame([(e, p, g, t, s) for k, p, t, _, s, e, g in ev if k == "request"],
                                     "email string, product_name string, target_price double, sub_ts timestamp, seq long")
        ticks = spark.createDataFrame([(p, t, x, s) for k, p, t, x, s, _, _ in ev if k == "tick"], "product_name string, ts timestamp, price double, seq long")
        want = rows(first_fire_naive(reqs, ticks), "email", "seq", "fire_ts", "fire_price")
        assert fires(state) == want and want
        state.advance(spark.createDataFrame(batches[2], LA.EVENT), 2)  # a batch that is run again
        assert fires(state) == want and state.table("late").count() == 0


def test_late_and_broken_events_are_recorded(spark):
    """Events in = used + recorded; neither a request nor a tick from the future
    moves the watermark past the clock."""
    far = 24 * 365 * 200
    first = [tick(100, 50.0, 1), tick(far, 1.0, 2), request("z", far, 10.0, 3), request("a", 90, 49.0, 4), tick(None, 3.0, 5), tick(5, None, 6),
             request(None, 5, 3.0, 7), request("b", 5, None, 8)]
    state = run(spark, [first])
    assert [r[0] for r in rows(state.table("marks"), "seen")][0] <= dt.datetime.now() + dt.timedelta(days=1)
    state = run(spark, [[tick(100, 50.0, 1), request("a", 90, 49.0, 4), request("z", far, 10.0, 3)] + first[4:],
                        [tick(51, 48.0, 9), tick(53, 30.0, 10), tick(101, 49.0, 11), request("q", 10, 99.0, 12), request("q", 60, 99.0, 13)]])
    late = rows(state.table("late"), "kind", "reason", "seq", "batch")
    assert late == sorted([("tick", "no time or product", 5, 0), ("tick", "no price", 6, 0), ("request", "no address or target", 7, 0),
                           ("request", "no address or target", 8, 0), ("tick", "behind the watermark", 9, 1), ("request", "behind the watermark", 12, 1)])
    used = state.table("ticks").count() + state.table("requests").count()
    assert used + len(late) == 3 + 4 + 5
    assert fires(state) == [("a", 4, at(101), 49.0), ("q", 13, at(100), 50.0)]


def test_a_product_with_a_third_of_all_ticks(spark):
    n = 6000
    base = spark.range(n).select(
        F.lit("tick").alias("kind"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("product_name"),
        (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"),
        (F.lit(100.0) - F.pmod(F.xxhash64("id"), F.lit(9000)) / 100.0).alias("price"), F.col("id").alias("seq"))
    reqs = spark.range(400).select(F.concat(F.lit("u"), "id").alias("email"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("p"), F.col("id") % 50)).alias("product_name"), (F.lit(10.0) + F.col("id") % 20).alias("target_price"),
        (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 10).cast("int"))).alias("sub_ts"), F.col("id").alias("seq"))
    ev = LA.events(base, reqs)
    state = LA.AlertState(spark, scratch_path(spark, "t-alerts"), "300 days")
    for i in range(3):
        state.advance(ev.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == i), i)
    want = first_fire_naive(reqs, base.drop("kind"))
    assert rows(state.fires().drop("fire_seq")) == rows(want) and want.where("product_name = 'hot'").count() > 50
