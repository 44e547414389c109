"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from pricelens.llm import repeats


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow(docs, size):
    """doc -> flags of removed words, for [(id, text)]."""
    least, out = {}, []
    for i, t in docs:
        w = words_of(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k:k + size])
                least[key] = min(least.get(key, i), i)
    for i, t in docs:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and least.get(tuple(w[k:k + size]), i) < i:
                gone[k:k + size] = [True] * size
        out.append((i, w, gone))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        docs.append((i, " ".join(w)))
    docs += [(n + k, docs[k % 7][1]) for k in range(40)]  # a group of copies
    hot = " ".join(passages[0] + passages[1])
    docs += [(2 * n + k, f"a{k} b{k} {hot} c{k} d{k} " * 2) for k in range(60)]  # a passage in many texts
    docs += [(3 * n, " ".join(["same"] * 200)), (3 * n + 1, " ".join(["same"] * 90))]
    return docs


@pytest.mark.parametrize("size,anchor,parts,crowded", [(13, 5, 6, 16), (13, 5, 1, 2), (6, 6, 3, 1), (9, 1, 4, 3)])
def test_equals_all_windows(spark, monkeypatch, size, anchor, parts, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    docs = corpus(150, size)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r for r in repeats.remove_repeats(df, min_words=size, anchor=anchor).collect()}
    assert len(got) == len(docs)
    for i, w, gone in slow(docs, size):
        r = got[i]
        assert (r.n_words, r.n_removed) == (len(w), sum(gone)), i
        assert r.kept == " ".join(x for x, g in zip(w, gone) if not g)
        spans = [(s.first, s.last) for s in r.repeats]
        assert [k for a, b in spans for k in range(a, b + 1)] == [k for k, g in enumerate(gone) if g]


def test_layout_nulls_repeated_rows_and_names(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a\n{p}\nz", 1, "x"), (2, f"b  \n\t{p}  c\n\nd", 2, "y"), (2, f"b  \n\t{p}  c\n\nd", 2, "y"), (None, p, 3, "n"), (4, None, 4, None),
            (5, "", 5, ""), (2, f"other {p}", 6, "same id"), (0, "é " * 12, 7, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc long, th string")
    out = repeats.remove_repeats(df, keep_layout=True)
    assert out.columns == ["doc_id", "text", "doc", "th", "n_words", "n_removed", "kept", "repeats"]
    got = sorted((r.doc, r.th, r.n_words, r.n_removed, r.kept) for r in out.collect() if r.th is not None)
    assert got == sorted([(1, "x", 22, 0, f"a\n{p}\nz"), (2, "y", 23, 20, "b  \n\tc\n\nd"), (2, "y", 23, 20, "b  \n\tc\n\nd"), (3, "n", 20, 0, p),
                          (5, "", 0, 0, ""), (6, "same id", 21, 20, "other "), (7, "short", 12, 0, "é " * 12)])
    assert [r.n_words for r in out.where("th IS NULL").collect()] == [0]
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, min_words=4, anchor=5)


def test_very_long_text(spark):
    long = " ".join(f"w{i % 5003}x{i // 5003}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "start " + long + " end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept if r.doc_id == 2 else "") for r in repeats.remove_repeats(df).collect()}
    assert got == {1: (60_000, 0, ""), 2: (60_002, 60_000, "start end")}


def test_query_on_documents(spark):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op8_substring_dedup"](spark, SF_SMALL).collect()}
    for i, w, gone in slow(docs, 13):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
