"""Compression-distance scores: held-out accuracy and edge cases."""

import random

import pytest

from pricelens.llm import toxicity

BAD = ["grubble", "snarkwit", "vilefang", "dregspawn"]


def texts(n, seed, bad):
    rng = random.Random(seed)
    parts = ["an", "be", "con", "der", "el", "for", "ga", "hin", "lo", "mar", "ne", "or", "pel", "ri", "sa", "ton", "ul", "ver"]
    out = []
    for _ in range(n):
        w = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 300))]
        if bad:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.train(texts(150, 1, True), texts(300, 2, False))


def test_held_out_accuracy(spark, model):
    rows = [(i, t, 1) for i, t in enumerate(texts(60, 3, True))] + [(100 + i, t, 0) for i, t in enumerate(texts(200, 4, False))]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, truth int"), model).collect()
    assert sum((r.score >= 0.5) == (r.truth == 1) for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_phrases_of_ordinary_words(spark):
    """A phrase whose words stand in ordinary text too marks toxic text."""
    phrase = "gaton hin marsa verlo pelri conul"

    def marked(n, seed):
        rng, out = random.Random(seed), []
        for t in texts(n, seed, False):
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), phrase)
            out.append(" ".join(w))
        return out

    def ordinary(n, seed):
        return [f"{t} {w}" for t, w in zip(texts(n, seed, False), phrase.split() * n)]

    model = toxicity.train(marked(200, 21), ordinary(400, 22))
    rows = [(t, 1) for t in marked(60, 23)] + [(t, 0) for t in ordinary(120, 24)]
    got = toxicity.score(spark.createDataFrame(rows, "text string, truth int"), model).collect()
    assert sum((r.score >= 0.5) == (r.truth == 1) for r in got) >= 0.9 * len(got)


def test_vocabulary_spread_over_many_words():
    """Words in one toxic text of a hundred each, phrases as rare."""
    plain = texts(2000, 31, False)
    bad = [f"{t} zork{i % 100}q {' '.join(t.split()[:1])} lo{i % 100} mar ne" for i, t in enumerate(texts(2000, 32, False))]
    plain, bad = [" ".join(t.split()[:20]) for t in plain], [" ".join(t.split()[-25:]) for t in bad]
    assert {w for _, w in toxicity._marks(bad, plain, 1)} >= {b"zork%dq" % i for i in range(100)}
    assert {w for _, w in toxicity._marks(bad, plain, 3)} >= {b"lo%d mar ne" % i for i in range(100)}
    assert toxicity._marks(plain[:1000], plain[1000:], 2) == []


def test_case_length_and_edges(spark, model):
    clean = texts(1, 9, False)[0]
    long = " ".join(texts(250, 10, False))
    rows = [(1, clean), (2, f"{clean} GRUBBLE snarkwit Vilefang"), (3, None), (4, ""), (4, ""), (None, clean), (5, long), (6, f"{long} grubble vilefang dregspawn snarkwit grubble")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, SCORE string")
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = [(r.doc_id, r.score) for r in out.collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[2] >= 0.5 > by[1] == by[None]
    assert by[3] == by[4] < 0.5 and by[5] < by[6]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_one_class_or_none():
    import numpy as np

    for toxic, plain, expect in (([], ["a"], 0.0), (["a"], [], 1.0), ([], [], 0.0)):
        m = toxicity.train(toxic, plain)
        meter = toxicity._meter(m)
        assert abs(toxicity._scores(np.array([toxicity._features(meter.distances("a b"), m.thresholds)]), m)[0] - expect) < 1e-6


def test_sample_is_bounded_distinct_and_stable(spark):
    rows = [(i, f"text {i % 40} " + ("bad" if i % 4 == 0 else "good")) for i in range(400)] + [(1000, None), (1001, "unlabelled"), (None, "no id")]
    labels = [(i, 1 if i % 4 == 0 else 0) for i in range(400)] + [(1000, 1), (5, 0), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    toxic, plain = toxicity.sample(docs.repartition(7), marks, sample_docs=6)
    assert len(toxic) == len(set(toxic)) == 6 and len(plain) == len(set(plain)) == 6
    assert all(t.endswith("bad") for t in toxic) and all(t.endswith("good") for t in plain)
    assert (toxic, plain) == toxicity.sample(docs.repartition(2), marks.repartition(3), sample_docs=6)
    assert toxicity.sample(docs, marks.limit(0)) == ([], [])


def test_sample_passes_over_long_texts(spark):
    """A text beyond the bytes takes neither its class nor the later ones away."""
    rows = [(i, f"text {i}", i % 2) for i in range(20)] + [(100 + i, f"long {i} " * 100, i % 2) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for got in toxicity.sample(docs, docs, sample_bytes=200):
        assert len(got) == 10 and all(t.startswith("text") for t in got)
    only = docs.where("doc_id >= 100 or toxic = 1")
    toxic, plain = toxicity.sample(only, only, sample_bytes=200)
    assert len(toxic) == 10 and len(plain) == 1 and plain[0].startswith("long")


def test_query_learns_only_outside_the_fold(spark):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES
    import zlib

    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, SF_SMALL).collect()}
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert len(got) == n
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
