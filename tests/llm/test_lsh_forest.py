"""LSH forest components against all pairs."""

import random
import re

import pytest

from pricelens.llm import lsh_forest


def slow_set(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def slow_components(sets, percent=80):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def families(seed, sizes, words=120, flips=8):
    """Groups of texts that stray from a base text by a few words each."""
    rng = random.Random(seed)
    out = []
    for size in sizes:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(words // 2, words * 2))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, flips)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("crowd,tile", [(2048, 1024), (12, 8)])
def test_components_equal_all_pairs(spark, crowd, tile):
    """Also where every region is crowded and every group is many tiles."""
    texts = families(5, [1] * 60 + [2] * 20 + [6] * 8 + [70])
    sets = [slow_set(t) for t in texts]
    expect = slow_components(sets)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(df, crowd=crowd, tile=tile).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, expect))}


def test_threshold_is_exact(spark):
    """Eight of ten shingles link, 79 of 100 do not."""
    def text(shingles):  # one shingle of four words, then as many that each add a word
        return " ".join(f"a{i}" for i in range(shingles + 3))
    rows = [(1, text(80)), (2, text(100)), (3, "b " + text(79).replace("a", "c")), (4, text(101).replace("a", "c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df).collect()}
    sets = [slow_set(t) for _, t in rows]
    assert got == {i + 1: c + 1 for i, c in enumerate(slow_components(sets))} and got[2] == 1 and got[4] == 4


def test_short_empty_null_repeats_and_clashing_columns(spark):
    long = " ".join(f"v{i % 4000}" for i in range(60_000))
    rows = [(9, None, 1), (8, "", 2), (7, " \n\t", 3), (6, "One two", 4), (5, "one  TWO", 5), (5, "one  TWO", 5), (4, "two one", 6), (None, "one two", 7),
            (3, long, 8), (2, long + " end", 9), (None, "only here and null id", 10), (1, "É e a b", 11), (0, "é e a b", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEPT int").withColumn("a.b", __import__("pyspark").sql.functions.lit("x"))
    out = lsh_forest.near_duplicates(df.repartition(3))
    assert out.columns == ["doc_id", "a.b", "n_shingles", "component_id", "kept"]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in out.collect())
    assert got == sorted([("9", 0, 9, True), ("8", 0, 8, True), ("7", 0, 7, True), ("6", 1, 5, False), ("5", 1, 5, True), ("5", 1, 5, True), ("4", 1, 4, True),
                          ("None", 1, 5, False), ("3", 4000, 2, False), ("2", 4001, 2, True), ("None", 2, None, False), ("1", 1, 1, True), ("0", 1, 0, True)])
    assert lsh_forest.near_duplicates(df.limit(0)).count() == 0


def test_query_on_documents(spark):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    sets = [slow_set(t) for _, t in docs]
    expect = slow_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op12_lsh_forest"](spark, SF_SMALL).collect()}
    assert got == {i: (len(s), docs[c][0], docs[c][0] == i) for (i, _), s, c in zip(docs, sets, expect)}
