"""SpotSigs fingerprints and their likeness."""

import hashlib
import random

import pytest

from pricelens.llm import spotsigs


def sets(text):
    return {text[k:k + 8] for k in range(0, len(text), 8)}


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def slow_spots(text, chain, anchors):
    words = [w for w in (x.strip(spotsigs._TRIM) for x in text.lower().split()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in anchors:
            nxt = [x for x in words[i + 1:] if x not in anchors][:chain]
            if len(nxt) == chain:
                out.add((w, *nxt))
    return out


def test_signatures_are_chains_after_anchors():
    anchors = frozenset(["the", "of", "a"])
    rng = random.Random(2)
    s = spotsigs.Spotter(2, anchors)
    words = ["the", "of", "a", "cat", "dog", "Sun,", "moon.", "--", "The", "tree"]
    known = {}
    for _ in range(500):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))
        slow = slow_spots(t, 2, anchors)
        if slow:
            got = s.spots(t)
            assert len(got) == len(slow)
            # the same chains have the same signatures in every text
            assert known.setdefault(frozenset(slow), got.tolist()) == got.tolist()
    assert s.spots("The cat, runs!").tolist() == s.spots("the CAT runs").tolist()
    assert len(s.spots("")) == len(s.spots(" .. -- ")) == 0
    assert len(s.spots("nothing common here whatsoever")) > 0  # no anchor: every word is one
    assert s.spots("cat").tolist() != s.spots("dog").tolist()


@pytest.mark.parametrize("parts,range_bytes", [(1, 1 << 24), (7, 8000), (40, 300)])
def test_next_and_edited(spark, monkeypatch, parts, range_bytes):
    rng = random.Random(parts)
    words = "the a of in cat dog house tree sun moon river stone and to with bird".split()
    ids = rng.sample(range(-50, 10 ** 6), 90)
    docs = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 200]))) for i in ids}
    docs[ids[0]], docs[ids[1]] = None, "é日 🙂" * 2000
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", range_bytes)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r for r in spotsigs.compare_with_next(df).collect()}
    order = sorted(docs, reverse=True)
    assert set(got) == set(docs)
    for k, i in enumerate(order):
        t, n, r = docs[i] or "", docs[order[(k + 1) % len(order)]] or "", got[i]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + n[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - jaccard(r.fingerprint, got[order[(k + 1) % len(order)]].fingerprint)) < 1e-12


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", 4)
    one = spark.createDataFrame([(5, "the cat sat in the house with a dog", "x")], "doc_id long, text string, part string")
    (r,) = spotsigs.compare_with_next(one).collect()
    assert r.near_next == 1.0
    rows = [(5, "a b"), (5, "a b"), (5, "c d"), (None, "nothing"), (None, None), (1, "")]
    assert spotsigs.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count() == len(rows)
    assert spotsigs.compare_with_next(one.limit(0)).count() == 0
    out = spotsigs.fingerprints(one.withColumnRenamed("part", "FINGERPRINT"))
    assert out.columns == ["doc_id", "text", "fingerprint"]


def test_query_on_documents(spark):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op9_spotsigs"](spark, SF_SMALL).collect()}
    assert set(got) == set(docs)
    by = {}
    for i, t in docs.items():
        assert by.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    order = sorted(docs, reverse=True)
    assert all(abs(got[i].near_next - jaccard(got[i].fingerprint, got[j].fingerprint)) < 1e-12 for i, j in zip(order, order[1:] + order[:1]))
    longer = [r for r in got.values() if r.n_chars > 600]
    assert sorted(r.near_edited for r in longer)[len(longer) // 2] > 0.4  # a third of the text differs


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_equals_all_pairs(spark, threshold):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        t = [x for _ in range(rng.randint(3, 40)) for x in ("the", rng.choice(words), rng.choice(words))]
        docs.append((len(docs), " ".join(t)))
        for _ in range(rng.choice([0, 0, 3])):  # near copies
            u = list(t)
            for _ in range(rng.randint(0, 4)):
                u[rng.randrange(len(u))] = rng.choice(words)
            docs.append((len(docs), " ".join(u)))
    docs += [(1000 + k, docs[k][1].upper()) for k in range(30)] + [(None, docs[0][1]), (None, "the unnamed text"), (2000, None), (2001, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    classes, pairs = spotsigs.similar(df.repartition(4), threshold)
    s = spotsigs.Spotter(2, spotsigs.every_anchor())
    of, least = {}, {}
    for i, t in docs:
        key = spotsigs.as_text(s.spots(t or ""))
        of.setdefault(key, []).append(i)
    for key, ids in of.items():
        least[key] = min((i for i in ids if i is not None), default=None)
    assert sorted(map(str, ((r.doc_id, r["class"]) for r in classes.collect()))) == sorted(map(str, ((i, least[k]) for k, ids in of.items() for i in ids)))
    keys = [k for k in of if k and least[k] is not None]
    expect = {}
    for x, k in enumerate(keys):
        for m in keys[:x]:
            j = jaccard(k, m)
            if j >= threshold:
                a, b = sorted((len(q), least[q]) for q in (k, m))
                expect[a[1], b[1]] = j
    got = {(r.a, r.b): r.likeness for r in pairs.collect()}
    assert set(got) == set(expect) and all(abs(got[p] - expect[p]) < 1e-12 for p in got)
    assert [t.count() for t in spotsigs.similar(df.limit(0), threshold)] == [0, 0]
