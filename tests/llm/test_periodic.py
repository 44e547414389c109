"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from pricelens.llm import periodic


def slow_runs(w, least=6, exponent=4):
    out = set()
    n = len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            b = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - b
            stretch = w[b:b + length]
            if length >= max(least, exponent * q) and not any(
                    q % p == 0 and all(stretch[j] == stretch[j + p] for j in range(length - p)) for p in range(1, q)):
                out.add((b, length, q))
    return sorted(out)


def mutated(rng):
    """Words with repeated stretches, some broken by a foreign word."""
    out = []
    for _ in range(rng.randint(1, 4)):
        root = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        out += root * rng.randint(1, 9) + root[:rng.randint(0, len(root))]
        out += [rng.choice("abcdef") for _ in range(rng.randint(0, 6))]
    if out and rng.random() < 0.4:
        out[rng.randrange(len(out))] = "z"
    return out


def test_runs_equal_all_periods():
    rng = random.Random(2)
    cases = [[], ["a"], ["a"] * 5, ["a"] * 6, list("ababab"), list("abababab"), list("abcabcabcabc"), ["a"] * 500,
             list("aabaabaabaab") * 7, [rng.choice("ab") for _ in range(300)]]
    cases += [mutated(rng) for _ in range(400)]
    for least, exponent in ((6, 4), (1, 4), (10, 5)):
        finder = periodic.Finder(least, exponent)
        for at in range(0, len(cases), 37):  # several texts share a step
            part = cases[at:at + 37]
            got = finder.find([" ".join(w) for w in part])
            assert [r for _, r, _ in got] == [slow_runs(w, least, exponent) for w in part]
            assert [n for n, _, _ in got] == [len(w) for w in part]


def test_wavelet_successor():
    rng = np.random.default_rng(4)
    x = rng.permutation(300)
    tree = periodic.Wavelet(x)
    lo = rng.integers(0, 299, 200)
    hi = np.array([rng.integers(a + 1, 301) for a in lo])
    v = rng.integers(0, 300, 200)
    assert tree.below(lo, hi, v).tolist() == [int((x[a:b] < c).sum()) for a, b, c in zip(lo, hi, v)]
    k = np.array([rng.integers(0, b - a) for a, b in zip(lo, hi)])
    assert tree.ascending(lo, hi, k).tolist() == [int(np.sort(x[a:b])[c]) for a, b, c in zip(lo, hi, k)]


def slow_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = slow_runs(w) if n < 400 else None
    return w, found


def check(row, w, found):
    drop = [False] * len(w)
    for b, length, q in found:
        drop[b + q:b + length] = [True] * (length - q)
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    kept = " ".join(x for x, d in zip(w, drop) if not d)
    lines = "".join(f"{b},{length},{q}\n" for b, length, q in found)
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(found), *best, milli)
    assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
    assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_query_on_documents(spark):
    """Texts of fewer than 400 words against the slow search, all others by
    what the planted stretch must give."""
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF_SMALL).collect()}
    assert set(got) == set(texts)
    some = 0
    for i, t in texts.items():
        w, found = slow_row(i, t)
        if found is not None:
            check(got[i], w, found)
            some += bool(found)
    assert some > 2


def test_null_empty_long_repeats_and_clashing_columns(spark):
    long = "one two three " * 200_000 + "four"
    rows = [(1, None, 3), (2, "", 4), (3, " \n", 5), (4, "x " * 7 + "y", 6), (4, "x " * 7 + "y", 6), (None, "a b " * 4, 7), (5, long, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, BEST int").withColumn("a.b", F.lit(1)).repartition(3)
    out = periodic.runs(df)
    assert out.columns == ["doc_id", "text", "a.b", "n_words", "runs", "best", "collapsed"]
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in out.collect())
    x = ("4", 8, [(0, 7, 1)], (0, 7, 1), "x y")
    assert got == sorted([("1", 0, [], None, ""), ("2", 0, [], None, ""), ("3", 0, [], None, ""), x, x, ("None", 8, [(0, 8, 2)], (0, 8, 2), "a b"),
                          ("5", 600_001, [(0, 600_000, 3)], (0, 600_000, 3), "one two three four")])
    assert periodic.runs(df.limit(0)).count() == 0
