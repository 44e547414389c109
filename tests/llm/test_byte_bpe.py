"""Byte-level BPE against the tiktoken library."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from pricelens.llm import byte_bpe
from pricelens.llm.queries import BYTE_RANKS


@pytest.fixture(scope="module")
def library():
    with open(BYTE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  a  b", "\n\n x\t y", "aaaaaaaaaaaaaaaa" * 30, "don't we'll", "日本語 🙂🙂", "!!!!???", " lead", "x\r\n\r\ny \x1c z",
       "0123456789" * 30, "a​b ́c", "<|endoftext|>"]


def test_encoder_equals_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab \n\t'sé日1!?_   \x1c\x85T") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    enc = byte_bpe.Encoder(byte_bpe.load(BYTE_RANKS), P.PATTERN)
    for part in (texts, texts[::-1]):  # a second time from the kept runs
        ids, off = enc.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [library.encode_ordinary(t) for t in part]


def test_encoder_forgets_and_goes_on(library):
    enc = byte_bpe.Encoder(byte_bpe.load(BYTE_RANKS), P.PATTERN)
    enc.KEPT = 3
    for text in ("one two three four", "four five", "one"):
        assert enc.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_merge_that_makes_a_lower_rank():
    """A vocabulary in which a merge opens one of lower rank: leftmost, lowest first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"dd": 258, b"add": 259}
    m = byte_bpe.Merges(ranks)
    for word in (b"abcabc", b"dddd", b"adddabc", b"xabcx", b"bcbcabc"):
        ids, off = m.replay([word, b"q", word])
        assert ids[off[0]:off[1]].tolist() == ids[off[2]:off[3]].tolist() == m._one(word)


def test_frame_nulls_extras_repeats(spark, library):
    long = "lorem ipsum " * 60_000
    rows = [(1, "a b", 5), (1, "a b", 5), (None, None, 6), (3, "", 7), (4, long, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS long").repartition(3)
    out = byte_bpe.round_trip(df, BYTE_RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((r.doc_id or 0, r.ids, bytes(r.decoded).decode()) for r in out.collect())
    assert got == sorted([(1, library.encode_ordinary("a b"), "a b")] * 2 + [(0, [], ""), (3, [], ""), (4, library.encode_ordinary(long), long)])
    assert byte_bpe.encode(df.limit(0), BYTE_RANKS, P.PATTERN).count() == 0


def test_decode_unknown_and_null_ids(spark):
    df = spark.createDataFrame([([1, -5, 10 ** 6, 1],), (None,), ([],), ([None, 0],)], "ids array<int>").coalesce(1)
    got = [bytes(r.decoded) for r in byte_bpe.decode(df, BYTE_RANKS).collect()]
    assert got == [b'""', b"", b"", b"!"]


def test_query_on_documents(spark, library):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, SF_SMALL).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_in_slices(spark, library):
    """Only the text goes to Python, slices of a batch come back in order, odd
    column names stay."""
    rows = [(i, ("slice %d of the text " % i) * (1 + i % 7) if i % 11 else None, i) for i in range(500)] + [(500, "long " * 3_000_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").repartition(2)
    out = byte_bpe.encode(df, BYTE_RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "a.b", "ids"]
    got = {r.doc_id: r for r in out.drop("text").collect()}
    for i, t, x in rows:
        assert got[i].ids == library.encode_ordinary(t or "") and got[i]["a.b"] == x
