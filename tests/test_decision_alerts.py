import datetime as dt


from conftest import rows
from pyspark.sql import functions as F

from naive import first_fire_naive
from pricelens import schemas as S
from pricelens.operators import alerts as AL
from pricelens.operators import decision as dec
from pricelens.session import scratch_path


def test_decision_fixture(spark):
    price = spark.createDataFrame(
        [("good_pos", 9.0, 10.0, "Good"), ("high_pos", 12.0, 10.0, "High"), ("good_neg", 9.0, 10.0, "Good"),
         ("high_neg", 12.0, 10.0, "High"), ("few", 9.0, 10.0, "Good")],
        "product_name string, current_price double, median_price double, price_status string")
    sent = spark.createDataFrame(
        [("good_pos", 3, 2, 0, 5), ("high_pos", 3, 2, 0, 5), ("good_neg", 2, 3, 0, 5), ("high_neg", 2, 2, 1, 5),
         ("few", 4, 0, 0, 4), ("no_prices", 5, 0, 0, 5)],
        "product_name string, positive long, neutral long, negative long, total long")
    got = {r.product_name: (r.decision, r.reason, r.current_price) for r in dec.decide(price, sent).collect()}
    assert got["good_pos"] == ("Buy Now", S.REASON_BUY, 9.0)
    assert got["high_pos"][:2] == ("Wait", S.REASON_HIGH_POSITIVE)
    assert got["good_neg"][:2] == ("Wait", S.REASON_GOOD_MIXED)
    assert got["high_neg"][:2] == ("Wait", S.REASON_POOR)
    assert got["few"][:2] == ("Wait", S.REASON_NOT_ENOUGH)
    assert got["no_prices"] == ("Wait", S.REASON_NOT_ENOUGH, None)


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_alert_fixture_first_fire_and_rearm(spark):
    req = spark.createDataFrame(
        [("a@x", "P", 90.0, ts("2024-01-01 00:00"), 1), ("a@x", "P", 85.0, ts("2024-01-03 12:00"), 2),
         ("b@x", "P", None, ts("2024-01-01 00:00"), 3), ("c@x", "P", 95.0, ts("2024-01-01 00:00"), 4)],
        "email string, product_name string, target_price double, sub_ts timestamp, seq long")
    ticks = spark.createDataFrame(
        [("P", ts("2024-01-01 10:00"), 95.0, 1), ("P", ts("2024-01-02 10:00"), 88.0, 2),
         ("P", ts("2024-01-03 10:00"), 80.0, 3), ("P", ts("2024-01-05 10:00"), 80.0, 4)],
        "product_name string, ts timestamp, price double, seq long")
    valid, bad = AL.split_valid(req)
    assert rows(bad, "email", "reason") == [("b@x", "invalid_target")]
    fires = rows(AL.first_fire(valid, ticks), "email", "target_price", "fire_ts", "fire_price")
    assert fires == [("a@x", 85.0, ts("2024-01-05 10:00"), 80.0), ("a@x", 90.0, ts("2024-01-02 10:00"), 88.0),
                     ("c@x", 95.0, ts("2024-01-01 10:00"), 95.0)]
    assert fires == rows(first_fire_naive(valid, ticks), "email", "target_price", "fire_ts", "fire_price")


def test_first_fire_matches_naive_on_events(spark):
    from pricelens import adapters as A
    d = "/root/testdata/sf0.01"
    valid, _ = AL.split_valid(A.subscription_requests(spark, d))
    t = A.price_obs(spark, d)
    assert rows(AL.first_fire(valid, t)) == rows(first_fire_naive(valid, t))


def test_first_fire_over_long_intervals(spark):
    """Five years and more, before 1970 too, bounds on and off the hour, ties:
    the cover's pieces grow with the logarithm of the length."""
    import random
    rng = random.Random(3)
    start = ts("1968-03-01 00:00")
    ticks = [("P", start + dt.timedelta(minutes=rng.randrange(60 * 24 * 365 * 8) // 7 * 7), 100.0 - (rng.random() ** 9) * 60, i) for i in range(4000)]
    ticks += [("P", ticks[0][1], ticks[0][2], 4001), ("P", None, 1.0, 4002), ("P", start, None, 4003), (None, start, 1.0, 4004)]
    reqs = [(f"e{i}@x", rng.choice("PPPQ"), 100.0 - 60 * (i / 300), start + dt.timedelta(hours=rng.randrange(24 * 365 * 6), minutes=rng.choice([0, 0, 13])), i)
            for i in range(300)]
    reqs += [(e, p, t, s + dt.timedelta(days=rng.randrange(1, 2000), seconds=rng.choice([0, 7])), 1000 + i) for i, (e, p, t, s, _) in enumerate(reqs[::2])]
    reqs.append(("n@x", "P", None, start, 5000))
    r = spark.createDataFrame(reqs, "email string, product_name string, target_price double, sub_ts timestamp, seq long")
    t = spark.createDataFrame(ticks, "product_name string, ts timestamp, price double, seq long")
    got = rows(AL.first_fire(r, t))
    assert got == rows(first_fire_naive(r, t)) and len(got) > 100
    year = 365 * 24 * 3_600_000_000
    spans = spark.createDataFrame([(7, 7 + n * year) for n in (1, 5, 25)] + [(9, 9), (-5, 5)], "lo long, hi long")
    sizes = [x[0] for x in spans.orderBy(F.col("hi") - F.col("lo")).select(F.size(AL._cover())).collect()]
    assert sizes[0] == 0 and sizes[1] == 2 and sizes[-1] <= 2 + 62 * AL.LEVELS + 25 * 365 * 24 // 32768


def test_upsert_latest_and_idempotent(spark):
    req = spark.createDataFrame(
        [("a@x", "P", 90.0, ts("2024-01-01 00:00"), 1), ("a@x", "P", 85.0, ts("2024-01-02 00:00"), 2),
         ("a@x", "Q", 10.0, ts("2024-01-01 00:00"), 3)],
        "email string, product_name string, target_price double, sub_ts timestamp, seq long")
    st = AL.upsert_state(req)
    assert rows(st, "product_name", "target_price", "active") == [("P", 85.0, True), ("Q", 10.0, True)]
    assert rows(AL.upsert_state(req.unionByName(req)), "product_name", "target_price") == \
        rows(st, "product_name", "target_price")


def test_alerts_due_equal_price_fires_and_zero_skips(spark):
    cur = spark.createDataFrame([("P", 85.0), ("Z", 0.0)], "product_name string, current_price double")
    st = spark.createDataFrame([("a@x", "P", 85.0, True), ("b@x", "P", 84.0, True), ("c@x", "Z", 5.0, True),
                                ("d@x", "P", 99.0, False)],
                               "email string, product_name string, target_price double, active boolean")
    due = AL.alerts_due(cur, st).collect()
    assert [r.email for r in due] == ["a@x"]
    assert due[0].subject.endswith("P is a Good Buy!") and "Price: 85.0" in due[0].body


def test_subscription_file_store(spark):
    from pricelens.session import scratch_path
    root = scratch_path(spark, "t-subs")
    with open(root.replace("file:", "") + "/alerts.json", "w") as f:
        f.write('[{"email": "a@x", "product_name": "P", "target_price": 90, "active": true},\n'
                ' {"email": "b@x", "product_name": "Q", "target_price": 5.5}]')
    st = AL.read_subscription_file(spark, root + "/alerts.json")
    assert rows(st) == [("a@x", "P", 90.0, True), ("b@x", "Q", 5.5, False)]
    assert AL.read_subscription_file(spark, root + "/missing.json").count() == 0
    assert rows(AL.active_subscribers(st)) == [("P", "a@x")]


def test_an_alert_fires_once_until_its_key_subscribes_again(spark):
    import datetime as dt

    from pricelens.operators import alerts as AL
    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    req = spark.createDataFrame([("a@x", "P", 50.0, t[0], 1), ("b@x", "P", 10.0, t[0], 2)],
                                "email string, product_name string, target_price double, sub_ts timestamp, seq long")
    cur = spark.createDataFrame([("P", 40.0)], "product_name string, current_price double")
    state = AL.upsert_state(req)
    due = AL.alerts_due(cur, state)
    assert [r.email for r in due.collect()] == ["a@x"]
    fired = due.selectExpr("email", "product_name", "timestamp'2024-01-02' AS fired_ts")
    after = AL.apply_fired(state, fired.union(fired))
    assert AL.alerts_due(cur, after).count() == 0
    assert [r.email for r in AL.active_subscribers(after).collect()] == ["b@x"]
    again = req.union(spark.createDataFrame([("a@x", "P", 45.0, t[3], 3)], req.schema))
    assert [r.target_price for r in AL.alerts_due(cur, AL.apply_fired(AL.upsert_state(again), fired)).collect()] == [45.0]


def test_subscription_store_round_trip(spark):
    path = scratch_path(spark, "t-substore")
    rows_ = [("a@x", "P", 5.0, True), ("b@x", "Q", None, False), ("c@x", 'R "q"', 2.5, True)]
    AL.write_subscription_store(spark.createDataFrame(rows_, AL.STATE_FILE_SCHEMA), path)
    spark.createDataFrame([('{"email": "broken',), ("",), ('{"email": "d@x", "product_name": "S", "target_price": 1.0}',)], "value string").write.mode("append").text(path)
    got = {tuple(r) for r in AL.read_subscription_store(spark, path).collect()}
    assert got == {*rows_, ("d@x", "S", 1.0, False)}
    assert AL.read_subscription_store(spark, path + "-missing").count() == 0
    AL.write_subscription_store(spark.createDataFrame(rows_[:1], AL.STATE_FILE_SCHEMA), path)
    assert rows(AL.read_subscription_store(spark, path)) == rows_[:1]
