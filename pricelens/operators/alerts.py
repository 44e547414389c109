"""Target-price subscriptions and alerts.

Subscriptions are an append-only log of subscribe requests
``(email, product_name, target_price, sub_ts, seq)``; the current state is
derived from it (latest request per key), never rewritten in place.

J7 (first fire per subscription interval) is a range join of ticks against
subscription validity intervals.  It is evaluated without pairing every
tick of a product with every subscription of that product:

1. ticks are pre-aggregated to price minima per product and node of a tree
   over time: hours, and 32, 1,024 and 32,768 hours;
2. an interval is covered by whole nodes, as large as they fit, and the two
   hours it cuts: some 60 pieces a level, so their number grows with the
   logarithm of its length.  A piece can fire only if its minimum is at or
   below the target; the first whole node of that kind certainly fires, so
   nothing after it matters (at most three pieces stay);
3. a node that stays is narrowed to the first of its 32 children that fires,
   level by level, down to an hour;
4. only the hours that remain (at most three) are compared tick by tick.

All joins are on (product, node), where the tree has one row, so the pieces of
a product with very many subscriptions are a side that Spark splits.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SUB_KEY = ["email", "product_name"]
INTERVAL_KEY = ["email", "product_name", "sub_ts", "seq"]

# Fixed message texts of a deal alert.
ALERT_SUBJECT = "🚨 Price Drop Alert: %s is a Good Buy!"
ALERT_BODY = ("Hello,\n\nGood news! The product '%s' that you are tracking is currently in a great "
              "position to buy.\n\nCurrent Stats:\n- Price: %s\n- AI Decision Insight: %s\n\n"
              "Visit the dashboard to see more details and purchase link: %s\n\nHappy shopping!\n"
              "- %s")
ALERT_SENDER = "Price alerts"


STATE_FILE_SCHEMA = "email string, product_name string, target_price double, active boolean"


def read_subscription_file(spark, path: str) -> DataFrame:
    """A subscription store kept as one JSON array of
    ``{email, product_name, target_price, active}``; a missing or unreadable
    file reads as no subscriptions (corrupt records are dropped)."""
    try:
        df = (spark.read.schema(STATE_FILE_SCHEMA).option("multiLine", "true").option("mode", "DROPMALFORMED")
              .json(path))
        df.schema  # resolve now: a missing path raises here
        return df.select("email", "product_name", "target_price",
                         F.coalesce(F.col("active"), F.lit(False)).alias("active"))
    except Exception as e:  # noqa: BLE001 - any unreadable store is empty, as in the original
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], STATE_FILE_SCHEMA)
        raise


def write_subscription_store(state: DataFrame, path: str) -> None:
    """Replace a subscription store by the state's rows, one JSON record a
    line, so that tasks write and read it in parallel."""
    state.select("email", "product_name", "target_price", "active").write.mode("overwrite").json(path)


def read_subscription_store(spark, path: str) -> DataFrame:
    """A store as ``write_subscription_store`` leaves it; a line that is no
    record is left out, a missing store has no subscriptions, a record without
    ``active`` is inactive."""
    bad = "_bad"
    try:
        df = spark.read.schema(f"{STATE_FILE_SCHEMA}, {bad} string").option("columnNameOfCorruptRecord", bad).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STATE_FILE_SCHEMA)
    return df.where(F.col(bad).isNull()).drop(bad).withColumn("active", F.coalesce("active", F.lit(False)))


def validate_subscriptions(requests: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason`` (first failed rule, in the order
    e-mail, target price, product)."""
    email, target, product = F.col("email"), F.col("target_price"), F.col("product_name")
    reason = (F.when(email.isNull() | (email == "") | ~F.contains(email, F.lit("@")), F.lit("invalid_email"))
              .when(target.isNull() | F.isnan(target) | (target <= 0), F.lit("invalid_target"))
              .when(product.isNull() | (product == ""), F.lit("missing_product")))
    return requests.withColumns({"reason": reason, "valid": reason.isNull()})


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good requests and the quarantine (with its reason)."""
    v = validate_subscriptions(requests)
    return v.where("valid").drop("valid", "reason"), v.where(~F.col("valid")).drop("valid")


def upsert_state(requests: DataFrame) -> DataFrame:
    """State per (email, product): the latest request's target, active.
    ``max_by`` aggregates partially before the shuffle, so a key with very
    many requests costs one row per map task."""
    last = F.max_by(F.struct("target_price", "sub_ts", "seq"), F.struct("sub_ts", "seq"))
    agg = requests.groupBy(*SUB_KEY).agg(last.alias("l"), F.count(F.lit(1)).alias("n_requests"),
                                         F.min("sub_ts").alias("first_sub_ts"))
    return agg.select(*SUB_KEY, F.col("l.target_price").alias("target_price"),
                      F.col("l.sub_ts").alias("sub_ts"), "first_sub_ts", "n_requests",
                      F.lit(True).alias("active"))


def apply_fired(state: DataFrame, fired: DataFrame) -> DataFrame:
    """A subscription is inactive once an alert was sent at or after its
    latest request; a later request makes it active again.  ``fired`` is the
    log of sent alerts ``(email, product_name, fired_ts)``, in any order."""
    last = fired.groupBy(*SUB_KEY).agg(F.max("fired_ts").alias("_fired"))
    j = state.join(last, list(SUB_KEY), "left")
    open_ = F.col("_fired").isNull() | (F.col("_fired") < F.col("sub_ts"))
    return j.withColumn("active", F.col("active") & open_).select(*state.columns)


def active_subscribers(state: DataFrame) -> DataFrame:
    """(product, email) of active subscriptions, tidy rows."""
    return state.where(F.col("active")).select("product_name", "email")


def alert_message(product: Column, price: Column, decision_text: Column,
                  dashboard_url: str = "http://localhost:8000",
                  sender: str = ALERT_SENDER) -> tuple[Column, Column]:
    """subject and body of a deal alert."""
    subject = F.format_string(ALERT_SUBJECT, product)
    body = F.format_string(ALERT_BODY, product, price.cast("string"), F.coalesce(decision_text, F.lit("")),
                           F.lit(dashboard_url), F.lit(sender))
    return subject, body


def alerts_due(current: DataFrame, state: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Active subscriptions whose target the current price meets.

    ``current``: (product_name, current_price); a price of 0 or NULL checks
    nothing.  ``reasons``: optional (product_name, reason) decision texts.
    """
    cur = current.where(F.col("current_price").isNotNull() & (F.col("current_price") != 0))
    if reasons is not None:
        cur = cur.join(reasons.select("product_name", "reason"), "product_name", "left")
    else:
        cur = cur.withColumn("reason", F.lit(None).cast("string"))
    subs = state.where(F.col("active") & F.col("target_price").isNotNull())
    j = cur.join(subs, (cur.product_name == subs.product_name) & (cur.current_price <= subs.target_price))
    subject, body = alert_message(cur.product_name, cur.current_price, F.col("reason"))
    return j.select("email", cur.product_name, "current_price", "target_price",
                    subject.alias("subject"), body.alias("body"))


def subscription_intervals(requests: DataFrame) -> DataFrame:
    """Each request is valid from its time until the same key's next
    request (re-subscribing replaces the target and re-arms the alert)."""
    w = Window.partitionBy(*SUB_KEY).orderBy("sub_ts", "seq")
    return requests.withColumn("next_sub_ts", F.lead("sub_ts").over(w))


#: Hours of a node at each level of the time tree.
FAN_BITS, LEVELS = 5, 3
_HOUR_US = 3_600_000_000


def _hour(us: Column) -> Column:
    return ((us - F.pmod(us, F.lit(_HOUR_US))) / _HOUR_US).cast("long")


def _cover() -> Column:
    """The pieces ``(level, node, whole, at)`` of the interval [lo, hi) given
    in microseconds: whole nodes and the hours at its ends that it cuts."""
    lo, hi = F.col("lo"), F.col("hi")
    first, last = _hour(lo), _hour(hi)          # hours that hold the bounds
    begin = F.when(F.pmod(lo, F.lit(_HOUR_US)) == 0, first).otherwise(first + 1)   # whole hours: begin..last-1

    def piece(level: int, node: Column, whole: bool) -> Column:
        return F.struct(F.lit(level).alias("level"), node.alias("node"), F.lit(whole).alias("whole"),
                        F.shiftleft(node, FAN_BITS * level).alias("at"))

    def up(x: Column, level: int) -> Column:     # first node of the level that starts at hour x or later
        return F.shiftright(x + F.lit((1 << FAN_BITS * level) - 1), FAN_BITS * level)

    def run(level: int, a: Column, b: Column) -> Column:
        return F.when(a < b, F.transform(F.sequence(a, b - 1), lambda n: piece(level, n, True))).otherwise(F.array().cast(kind))

    kind = "array<struct<level:int,node:bigint,whole:boolean,at:bigint>>"
    parts = [F.when((lo < hi) & (begin > first), F.array(piece(0, first, False))).otherwise(F.array().cast(kind)),
             F.when((lo < hi) & (F.pmod(hi, F.lit(_HOUR_US)) > 0) & (last >= begin), F.array(piece(0, last, False))).otherwise(F.array().cast(kind))]
    for level in range(LEVELS + 1):
        a, b = up(begin, level), F.shiftright(last, FAN_BITS * level)
        if level == LEVELS:
            parts.append(run(level, a, b))
            continue
        above, below = F.shiftleft(up(begin, level + 1), FAN_BITS), F.shiftleft(F.shiftright(last, FAN_BITS * (level + 1)), FAN_BITS)
        parts += [run(level, a, F.least(above, b)), run(level, F.greatest(below, F.least(above, b)), b)]
    return F.concat(*parts)


def price_tree(ticks: DataFrame, materialize: str = "checkpoint") -> tuple[DataFrame, DataFrame]:
    """``(tree, last)`` of ``ticks(product_name, us, price)``: price minima per
    product and node of the time tree, and each product's last tick time."""
    from ..session import materialize as mat
    hourly = ticks.groupBy("product_name", _hour(F.col("us")).alias("hour")).agg(F.min("price").alias("umin"), F.max("us").alias("last_us"))
    nodes = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("hour", FAN_BITS * k).alias("node")) for k in range(LEVELS + 1)])
    tree = mat(hourly.select("product_name", "umin", "last_us", F.inline(nodes)).groupBy("product_name", "level", "node").agg(
        F.min("umin").alias("umin"), F.max("last_us").alias("last_us")), materialize)
    last = tree.where(F.col("level") == LEVELS).groupBy("product_name").agg(F.max("last_us").alias("last_us"))
    return tree.drop("last_us"), last


def first_in(intervals: DataFrame, ticks: DataFrame, materialize: str = "checkpoint") -> DataFrame:
    """The first tick at or below the target in each of ``intervals`` (interval
    key, target_price, sub_ts up to next_sub_ts, null: without end).

    Output: interval key, target, ``fire_ts``, ``fire_price``, ``fire_seq``;
    intervals that do not fire have no row.  Null times and prices match
    nothing; an empty interval never fires."""
    from ..session import materialize as mat
    t = ticks.where(F.col("ts").isNotNull() & F.col("price").isNotNull()).select(
        "product_name", "ts", "price", F.col("seq").alias("tick_seq"), F.unix_micros("ts").alias("us"))
    tree, last = price_tree(t, materialize)
    key = [*INTERVAL_KEY, "target_price", "lo", "hi"]
    iv = intervals.where(F.col("target_price").isNotNull()).join(last, "product_name").select(
        *INTERVAL_KEY, "target_price", F.unix_micros("sub_ts").alias("lo"),
        F.coalesce(F.unix_micros("next_sub_ts"), F.col("last_us") + 1).alias("hi"))
    met = iv.select(*key, F.inline(_cover())).join(tree, ["product_name", "level", "node"]).where(F.col("umin") <= F.col("target_price"))
    spot = F.struct("at", "level", "node")
    kept = met.groupBy(*key).agg(F.min(F.when(F.col("whole"), spot)).alias("sure"), F.collect_list(F.when(~F.col("whole"), spot)).alias("cut"))
    kept = kept.withColumn("piece", F.explode(F.concat(
        F.filter("cut", lambda c: F.col("sure").isNull() | (c["at"] < F.col("sure.at"))), F.array_compact(F.array("sure")))))
    found = mat(kept.select(*key, "piece.level", "piece.node"), materialize)
    top = found.agg(F.max("level")).first()[0] or 0   # no interval is longer: nothing to narrow above
    rows = found.where(F.col("level") == top)
    for level in range(top, 0, -1):
        child = F.explode(F.transform(F.sequence(F.lit(0), F.lit((1 << FAN_BITS) - 1)), lambda i: F.shiftleft("node", FAN_BITS) + i))
        inner = rows.select(*key, child.alias("node")).join(tree.where(F.col("level") == level - 1).drop("level"), ["product_name", "node"])
        inner = inner.where(F.col("umin") <= F.col("target_price")).groupBy(*key, F.lit(level - 1).alias("level")).agg(F.min("node").alias("node"))
        # one node of each interval goes on; its cut hours wait at the lowest level
        rows = inner.select(*key, "level", "node").unionByName(found.where(F.col("level") == level - 1))
    hits = rows.withColumnRenamed("node", "hour").join(t.withColumn("hour", _hour(F.col("us"))), ["product_name", "hour"]).where(
        (F.col("us") >= F.col("lo")) & (F.col("us") < F.col("hi")) & (F.col("price") <= F.col("target_price")))
    first = hits.groupBy(*INTERVAL_KEY, "target_price").agg(F.min(F.struct("us", "tick_seq", "price", "ts")).alias("f"))
    return first.select(*INTERVAL_KEY, "target_price", F.col("f.ts").alias("fire_ts"), F.col("f.price").alias("fire_price"),
                        F.col("f.tick_seq").alias("fire_seq"))


def first_fire(requests: DataFrame, ticks: DataFrame, materialize: str = "checkpoint") -> DataFrame:
    """J7/T1 (batch): per subscription interval the first tick with
    ``price <= target`` inside the interval, if any.

    ``requests``: valid requests (email, product_name, target_price, sub_ts,
    seq).  ``ticks``: (product_name, ts, price, seq).
    Output: interval key, target, ``fire_ts``, ``fire_price``.
    """
    return first_in(subscription_intervals(requests), ticks, materialize).drop("fire_seq")
