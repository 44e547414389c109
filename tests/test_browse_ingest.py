
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from pricelens import adapters as A
from pricelens import schemas as S
from pricelens.operators import browse as B
from pricelens.session import scratch_path
from pricelens.plans import landing as L
from pricelens.sources import price_pages as PP
from pricelens.sources import review_pages as RP
from pricelens.sources import store as ST


def test_paging_fixture(spark):
    df = spark.range(101).withColumnRenamed("id", "seq")
    assert B.page_numbers(101, 1) == (1, 3)
    assert B.page_numbers(101, 0) == (1, 3)
    assert B.page_numbers(101, 9) == (3, 3)
    assert B.page_numbers(0, 5) == (1, 1)
    p = B.paginate(df, 9, 50)
    assert (p.page, p.total_pages, p.total_rows) == (3, 3, 101)
    assert rows(p.rows, "seq") == [(100,)]


def test_page_union_is_whole(spark):
    df = spark.range(101).withColumnRenamed("id", "seq")
    got = []
    for k in range(1, 4):
        got += [r.seq for r in B.paginate(df, k, 50, total_rows=101).rows.collect()]
    assert sorted(got) == list(range(101))


def test_keyword_wildcards_and_any_column(spark):
    df = spark.createDataFrame([("user_1", None, "s"), ("userX1", "x", "s"), ("abc", "USER_1 here", "s")],
                               "product_name string, review_text string, source string")
    assert len(B.search_keyword(df, "user_1").collect()) == 3        # "_" is a wildcard
    assert len(B.search_any_column(df, "^abc$").collect()) == 1
    assert len(B.search_any_column(df, "zzz").collect()) == 0


def test_file_catalog_extensions_and_order(spark):
    root = scratch_path(spark, "t-cat")
    spark.range(3).write.csv(f"{root}/a.csv")
    spark.range(3).write.json(f"{root}/sub/b.json")
    spark.range(3).write.parquet(f"{root}/c.parquet")
    cat = B.file_catalog(spark, root).collect()
    assert {r.name.rsplit(".", 1)[-1] for r in cat} == {"csv", "json"}
    assert [r.modified for r in cat] == sorted([r.modified for r in cat], reverse=True)


def test_store_append_scan_align(spark):
    path = scratch_path(spark, "t-store2")
    assert ST.scan_observations(spark, path + "/missing").count() == 0
    a = spark.createDataFrame([("2024-01-01", S.SOURCE_PRICE, "P", 1.0, 1)],
                              "timestamp string, source string, product_name string, price double, seq long")
    assert ST.append_observations(a, path)
    assert ST.append_observations(a.limit(0), path)
    assert ST.append_observations(a, path)
    got = ST.scan_observations(spark, path)
    assert got.columns == S.OBSERVATIONS.fieldNames() and got.count() == 2


def _price_page(product, pts, key="k3y", url=PP.PAGE_URL_PREFIX + "x"):
    import base64
    import json
    js = json.dumps({"History": {"Price": [{"x": x, "y": y} for x, y in pts]}})
    cipher = base64.b64encode(bytes(ord(c) ^ ord(key[i % len(key)]) for i, c in enumerate(js))).decode()
    title = f"<title>{product} Price History</title>" if product else ""
    return (f"<html><head>{title}</head><script>var PagePriceHistoryDataSet = \"{cipher}\";"
            f"let CachedKey='{key}';</script></html>"), url


def test_price_pages_fixture(spark):
    good, url = _price_page("Foo", [("2024-01-01", 10.5), ("2024-01-02", None)])
    notitle, _ = _price_page(None, [("2024-01-03", 3.0)])
    pages = spark.createDataFrame(
        [(1, url, good), (2, url, "<html>nothing</html>"), (3, url, good.replace("CachedKey", "Other")),
         (4, "https://elsewhere.example/x", good), (5, url, notitle)], "page_id long, url string, html string")
    st = dict(rows(PP.page_status(pages), "page_id", "status"))
    assert st == {1: "ok", 2: "no_data", 3: "no_key", 4: "invalid_url", 5: "ok"}
    out, rej = PP.decode_price_pages(pages)
    got = rows(out, "page_id", "product_name", "timestamp", "price", "price_defaulted")
    assert got == [(1, "Foo", "2024-01-01", 10.5, False), (1, "Foo", "2024-01-02", 0.0, True),
                   (5, "Flipkart Product", "2024-01-03", 3.0, False)]
    assert rows(rej, "page_id") == [(2,), (3,), (4,)]


def test_price_page_round_trip_on_events(spark):
    ticks = A.price_obs(spark, SF_SMALL)
    out, rej = PP.decode_price_pages(L.price_pages(ticks))
    assert rej.count() == 0
    back = out.select("product_name", F.to_timestamp("timestamp").alias("ts"), "price")
    assert rows(back) == rows(ticks.select("product_name", "ts", "price"))


CARD = ('<div class="c"><div><div><div>4<svg></svg></div></div><p>Great phone</p></div>'
        '<div><div>Battery lasts two full days and the screen is bright.<span>READ MORE</span></div></div>'
        '<div><div><div><div><div><p>Asha K</p><p><span>Certified Buyer</span></p><p>2 months ago</p>'
        '</div></div></div></div></div></div>')


def test_review_card_rules(spark):
    page = f"<html><body><main>{CARD}{CARD}</main></body></html>"
    pages = spark.createDataFrame([(1, page), (2, "<html><p>No reviews</p></html>"), (3, None)], "page_id long, html string")
    got = rows(RP.extract_reviews(pages))
    assert got == [(1, 0, "4", "Great phone", "Battery lasts two full days and the screen is bright.", "Asha K", True)]


def _elements(html):
    reader = RP._Elements()
    reader.feed(html)
    return sorted(reader.finish())


def test_page_elements():
    html = "<div>a<p> b <b>c</b></p><script>x</script><img></div><span>Certified Buyer</span>"
    assert _elements(html) == [
        (0, 6, "[page]", "abcCertified Buyer", True, True, None), (1, 5, "div", "abc", True, True, None), (2, 3, "p", "bc", False, False, None),
        (3, 3, "b", "c", False, False, None), (4, 4, "script", "x", False, False, None), (5, 5, "img", "", False, False, None),
        (6, 6, "span", "Certified Buyer", False, False, 0)]


def test_cards_equal_all_elements_by_all_cards():
    import random
    rng = random.Random(5)

    def html(depth):
        kids = "".join(html(depth - 1) for _ in range(rng.randint(0, 3))) if depth else rng.choice(["Certified Buyer", "4<svg></svg>", "words", ""])
        tag = rng.choice(["div", "p", "span", "b"])
        return f"<{tag}>{kids}</{tag}>"

    nested = 0
    for _ in range(300):
        elements = _elements(html(rng.randint(1, 9)))
        badge = [e for e in elements if e[6] is not None]
        outer = [e for e in badge if not any(o[0] < e[0] <= o[1] for o in badge)]
        last = {e[0]: e[1] for e in elements}
        want = []
        for card in {e[6] for e in outer}:
            first = min(e[0] for e in outer if e[6] == card)
            held = [e for e in elements if card < e[0] <= last[card] and e[2] in ("div", "span", "p")]
            want.append((first, [e[3] for e in held if e[2] != "p" and e[5] and e[3] in "1 2 3 4 5".split()],
                         [e[3] for e in held if not e[4]], [e[3] for e in held if e[2] != "div"]))
        got = RP.cards_of(elements)
        assert sorted(got) == sorted(want)
        nested += len({e[6] for e in outer}) > 1
    assert nested > 10


def test_cards_of_a_large_batch_are_handed_on_in_small_ones():
    import tracemalloc

    import pyarrow as pa
    page = "<html><body><main>" + "".join(CARD.replace("Great phone", f"Title {i}").replace("Battery", "word " * 500) for i in range(20)) + "</main></body></html>"
    batch = pa.RecordBatch.from_arrays([pa.array([*range(199), None], pa.int64()), pa.array([page] * 200)], names=["page_id", "html"])
    assert batch.nbytes > 10 << 20
    tracemalloc.start()
    n, ids = 0, []
    for out in RP.card_batches(iter([batch, batch.slice(0, 0)])):
        n += 1
        ids += out.column(0).to_pylist()
        assert out.num_rows <= RP.HELD_CARDS and out.nbytes < 2 * RP.HELD_CHARS
    assert n > 5 and ids == [i for i in [*range(199), None] for _ in range(20)]
    assert tracemalloc.get_traced_memory()[1] < 8 << 20  # once several times the batch
    tracemalloc.stop()


def test_review_extraction_job_and_pages_until_empty(spark):
    page = f"<html><body><main>{CARD}</main></body></html>"
    pages = spark.createDataFrame([(1, "u?x=1&page=1", page), (2, "u?x=1&page=2", page),
                                   (3, "u?x=1&page=3", "<html></html>"), (4, "u?x=1&page=4", page)],
                                  "page_id long, url string, html string")
    ex = RP.extract_reviews(pages)
    counts = ex.groupBy("page_id").count()
    p = RP.page_numbers(pages).join(counts, "page_id", "left").withColumn(
        "n_reviews", F.coalesce("count", F.lit(0)))
    assert rows(RP.pages_until_empty(p), "page") == [(1,), (2,)]
    assert rows(p, "base_url")[0] == ("u?x=1",)


def test_links(spark):
    df = spark.createDataFrame([('<a href="/s?q=x">s</a><a href="/foo/p/ab1">Foo</a><a href="/product-reviews/ab1">r</a>',)],
                               "html string")
    r = df.select(PP.first_link(F.col("html"), "/p/").alias("p"),
                  PP.first_link(F.col("html"), "/product-reviews/").alias("r")).collect()[0]
    assert (r.p, r.r) == ("/foo/p/ab1", "/product-reviews/ab1")


def test_pages_of_text_and_null_keys(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), ("c",), (None,)], "k string")
    assert [r.k for r in B.paginate(df, 2, 3, order_by="k").rows.collect()] == ["b", "c"]
    assert [r.k for r in B.paginate(df, 99, 2, order_by="k").rows.collect()] == ["c"]


def test_pages_until_empty_caps_at_ten(spark):
    df = spark.createDataFrame([("b", p, 1) for p in range(1, 15)], "base_url string, page int, n_reviews int")
    assert [r.page for r in RP.pages_until_empty(df, max_pages=10).orderBy("page").collect()] == list(range(1, 11))
    assert RP.pages_until_empty(df).count() == 14


def test_ingest_review_pages_api(spark):
    from pricelens import api
    page = f"<html><body><main>{CARD}</main></body></html>"
    pages = spark.createDataFrame([(1, "u?x=1&page=1", page)], "page_id long, url string, html string")
    r = api.ingest_review_pages(pages, "Foo").collect()[0]
    assert r.review_text == "Great phone - Battery lasts two full days and the screen is bright."
    assert r.product_name == "Foo" and r.rating == "4" and '"reviewer":"Asha K"' in r.metadata


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('timestamp,source,product_name,price,review_text\n2024-01-01,s,"He said ""great"", then\nbought two",1.5,"x, y"\n'
                 '2024-01-02,s,B,N/A,\n\n')
    t = ST.csv_replace_load(spark, str(f), str(tmp_path / "t"))
    assert rows(t, "product_name", "price", "review_text") == [("B", None, None), ('He said "great", then\nbought two', 1.5, "x, y")] or \
        {r.product_name: r.price for r in t.collect()} == {"B": None, 'He said "great", then\nbought two': 1.5}
    assert B.read_flat_file(spark, str(f)).count() == 2


def test_json_lines_and_arrays(spark, tmp_path):
    lines, array = tmp_path / "l.json", tmp_path / "a.json"
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    array.write_text('[\n  {\n    "a": 1\n  },\n  {"a": 2}\n]\n')
    assert rows(B.read_flat_file(spark, str(lines)), "a") == rows(B.read_flat_file(spark, str(array)), "a") == [(1,), (2,)]


def test_bad_price_pages_go_to_quarantine(spark):
    def page(cipher):
        return f'<html><title>T</title><script>var PagePriceHistoryDataSet = "{cipher}";\nlet CachedKey=\'k\';</script></html>'
    pages = spark.createDataFrame([(1, PP.PAGE_URL_PREFIX + "x", page("abcde")), (2, PP.PAGE_URL_PREFIX + "x", page("eyJh")), (3, PP.PAGE_URL_PREFIX + "x", page("!!"))],
                                  "page_id long, url string, html string")
    out, rejected = PP.decode_price_pages(pages)
    assert out.count() == 0
    assert {r.status for r in rejected.collect()} == {"decode_failed"} and rejected.count() == 3


def test_keyword_with_backslash(spark):
    df = spark.createDataFrame([("a\\", "", ""), ("b", "", "")], "product_name string, review_text string, source string")
    assert rows(B.search_keyword(df, "a\\"), "product_name") == [("a\\",)]


def test_review_ingest_stops_at_the_empty_page_and_names_the_product(spark):
    from pricelens import api
    page = f'<html><nav><a href="/p/foo">Foo 12</a></nav><main>{CARD}</main></html>'
    pages = spark.createDataFrame([(1, "u?x=1", page), (2, "u?x=1&page=2", page), (3, "u?x=1&page=3", "<p>none</p>"), (4, "u?x=1&page=4", page)],
                                  "page_id long, url string, html string")
    got = api.ingest_review_pages(pages)
    assert sorted((r.product_name, r.url) for r in got.collect()) == [("Foo 12", "u?x=1"), ("Foo 12", "u?x=1&page=2")]


def test_pages_of_ties_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(B, "RANGE_ROWS", 40)
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    index = B.rank_index(df, "k")
    assert len(index) > 10 and sum(r["n"] for r in index) == 900 and max(r["n"] for r in index) < 300
    got = [[(r.k, r.v) for r in B.paginate(df, p, 70, "k", index=index).rows.collect()] for p in range(1, 14)]
    flat = [x for page in got for x in page]
    assert [len(g) for g in got] == [70] * 12 + [60] and len(set(flat)) == 900
    assert [-1 if k is None else k for k, _ in flat] == sorted(-1 if k is None else k for k, _ in flat)


def test_deep_page_sorts_only_its_ranges(spark, monkeypatch):
    monkeypatch.setattr(B, "RANGE_ROWS", 100)
    df = spark.range(20_000).withColumnRenamed("id", "seq")
    p = B.paginate(df, 350, 50)
    assert [r.seq for r in p.rows.collect()] == list(range(17_450, 17_500))
    offset = p.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "17450" not in offset.split("Filter")[0]


def test_pages_of_an_empty_table(spark):
    p = B.paginate(spark.range(0).withColumnRenamed("id", "seq"), 3)
    assert (p.page, p.total_pages, p.total_rows, p.rows.count()) == (1, 1, 0, 0)


def _csv_records(text):
    """Records after the header, character by character."""
    n, quoted, any_ = 0, False, False
    for c in text:
        quoted ^= c == '"'
        if c == "\n" and not quoted:
            n, any_ = n + any_, False
        else:
            any_ = True
    return max(0, n + any_ - 1)


def test_csv_count_over_small_splits(spark, tmp_path):
    import random
    rng = random.Random(3)
    words = ["a", "bb", '"q ""x"" y"', '"two\nlines"', '"\n\nthree\n"', "", '""']
    texts = []
    for i in range(6):
        text = "c1,c2\n" + "".join(f"{rng.choice(words)},{rng.choice(words)}\n" + "\n" * (rng.random() < 0.1) for _ in range(rng.choice([0, 1, 400])))
        texts.append(text[:-1] if i % 2 else text)
        (tmp_path / f"f{i}.csv").write_text(texts[-1])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "open.csv").write_text('c1,c2\na,"left open\nb')
    texts.append('c1,c2\na,"left open\nb')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "1009", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert ST.csv_count(spark, str(tmp_path)) == (sum(map(_csv_records, texts)), False)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        assert ST.csv_splits(spark, str(tmp_path)).where("start > 0").count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_load_fails_on_a_lost_row(spark, tmp_path, monkeypatch):
    import pytest
    f = tmp_path / "a.csv"
    f.write_text("timestamp,source,product_name,price\n" + "".join(f"2024-01-0{i},s,P{i},1\n" for i in range(1, 8)))
    assert ST.csv_count(spark, str(f)) == (7, True)
    assert ST.csv_replace_load(spark, str(f), str(tmp_path / "ok")).count() == 7
    align = ST.align_to_schema
    monkeypatch.setattr(ST, "align_to_schema", lambda df, schema: align(df, schema).where("product_name <> 'P3'"))
    with pytest.raises(RuntimeError, match="7 rows in, 6 rows stored"):
        ST.csv_replace_load(spark, str(f), str(tmp_path / "lost"))


def test_file_catalog_newest_first_with_paths(spark, tmp_path):
    import os
    for i, name in enumerate(["old.csv", "sub/new.json", "sub/deep/mid.csv", "other.txt"]):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * (i + 1))
        os.utime(f, (1_700_000_000 + [0, 500, 200, 900][i],) * 2)
    for root in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
        got = [(r.relative_path, r.name, r.size, int(r.modified.timestamp())) for r in B.file_catalog(spark, root).collect()]
        assert got == [("sub/new.json", "new.json", 2, 1_700_000_500), ("sub/deep/mid.csv", "mid.csv", 3, 1_700_000_200), ("old.csv", "old.csv", 1, 1_700_000_000)]
