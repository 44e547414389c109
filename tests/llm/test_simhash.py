"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import xxhash

from pricelens.llm import simhash
from pricelens.llm.components import connected_components


def slow_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    x = np.array(fps, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)):
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    long = " ".join(f"w{i % 997}" for i in range(3000))
    for t in ["", " \n", "One", "a b c", "a b c d", "A b\x0bc\x0cd É e", "x y " * 40, "    a", long]:
        assert simhash.fingerprint(t, 4) == slow_fingerprint(t), t


def clustered(n, seed, flips=6):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 5, 40])):
            y = x
            for _ in range(rng.randint(0, flips)):
                y ^= 1 << rng.randrange(64)
            out.append(y)
    return sorted(set(out[:n]))


def test_links_equal_all_pairs_for_any_tile(spark):
    fps = clustered(1500, 3)
    base = 0x0F0F0F0F0F0F0F0F  # a hot block: thousands would share its ranges
    fps = sorted(set(fps) | {base ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    for radius, tile, agreeing in ((4, 4096, None), (4, 16, 1), (4, 16, 2), (4, 64, 3), (0, 64, None), (7, 32, None), (7, 32, 2)):
        expect = slow_components(fps, radius)
        got = {r.node: r.root for r in connected_components(simhash.links(df, radius, tile, agreeing)).collect()}
        groups = {}
        for x, c in zip(signed, expect):
            groups.setdefault(c, []).append(x)
        for members in groups.values():
            roots = {got.get(x, x) for x in members}
            assert roots == {min(members)}, (radius, tile, agreeing)


def test_blocks_stay_small_as_the_table_grows():
    for radius in (0, 1, 4, 7, 20, 64):
        for n in (0, 1, 10**4, 10**8, 10**10, 10**12):
            k = simhash._agreeing(n, radius, 4096)
            masks = simhash._masks(radius, k)
            if radius < 8:  # a fingerprint meets few tiles' worth of others in a block
                assert n / 2.0 ** (k * (64 // (radius + k))) < 16 * 4096, (radius, n, k)
            rng = random.Random(n + radius)
            for _ in range(20):  # any two within the radius agree in one choice of ranges
                x, flips = rng.getrandbits(64), sum(1 << b for b in rng.sample(range(64), radius))
                assert any(((x ^ flips) ^ x) & m == 0 for m in masks), (radius, k)


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (None, 5), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}
    assert connected_components(df.limit(0)).count() == 0


def test_frame_nulls_repeats_and_extras(spark):
    text = "the quick brown fox jumps over the lazy dog " * 20
    rows = [(5, text, "x"), (2, text.upper(), "y"), (2, text.upper(), "y"), (None, text, "z"), (9, None, "n"), (7, "", "e"), (None, " ", "e"), (1, "alone here", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumnRenamed("component_id", "least")
    got = sorted((str(r.doc_id), r.least, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("5", "x", 2), ("2", "y", 2), ("2", "y", 2), ("None", "z", 2), ("9", "n", 7), ("7", "e", 7), ("None", "e", 7), ("1", "a", 1)])
    clash = spark.createDataFrame([(1, "a b c d e", 3, 4)], "doc_id long, text string, fp int, component_id int")
    assert simhash.near_duplicates(clash).select("doc_id", "component_id").collect() == [(1, 1)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query_on_documents(spark):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    fps = [slow_fingerprint(t) for _, t in docs]
    expect = slow_components(fps, 4)
    got = {r.doc_id: r for r in QUERIES["op2_simhash"](spark, SF_SMALL).collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        i: (f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fps, expect)}
