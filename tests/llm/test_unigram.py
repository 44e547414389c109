"""Unigram piece counts against the tokenizers library."""

import random

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from pricelens.llm import unigram

MODEL = P.path("piece_bpe_32k.model")


def library(scores):
    """The tokenizers library's unigram model over the same pieces and scores."""
    low = min(scores.values())
    vocab = [("<unk>", low)] + [(f"<0x{b:02X}>", low) for b in range(256)] + list(scores.items())
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_public_vocabulary(spark):
    scores = unigram.vocabulary(MODEL)
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ref, own = Tokenizer(models.Unigram([(m.id_to_piece(i), scores.get(m.id_to_piece(i), min(scores.values()))) for i in range(m.get_piece_size())],
                                        unk_id=0, byte_fallback=True)), unigram.Counter(scores)
    ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(4)
    for _ in range(2000):
        t = "".join(rng.choice("abcthe \n日🙂é▁  ing\t'ß") for _ in range(rng.randint(0, 40)))
        assert own.text(t) == len(ref.encode(t, add_special_tokens=False).ids), repr(t)


def test_ties_keep_the_piece_that_begins_first():
    rng = random.Random(6)
    for seed in range(40):
        letters = "▁abc"
        scores = {c: -2.0 for c in letters if rng.random() < 0.9}
        for _ in range(14):  # equal scores on purpose
            p = "".join(rng.choice("abc") for _ in range(rng.randint(2, 4)))
            scores["▁" * rng.randint(0, 1) + p] = -float(rng.choice([2, 3, 4]))
        ref, own = library(scores), unigram.Counter(scores)
        for _ in range(100):
            t = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))
            assert own.text(t) == len(ref.encode(t, add_special_tokens=False).ids), (scores, t)


def test_frame_edges(spark):
    long = "wonderful things " * 40_000
    rows = [(1, "hello world", 1), (1, "hello world", 1), (None, "x", 2), (2, None, 3), (3, "", 4), (4, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens int").repartition(3)
    out = unigram.token_counts(df, MODEL)
    assert out.columns == ["doc_id", "text", "n_tokens"]
    c = unigram.counter(MODEL)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out.collect()) == sorted((i or 0, c.text(t or "")) for i, t, _ in rows)
    assert c.text(long) > 80_000
    assert unigram.token_counts(df.limit(0), MODEL).count() == 0
    assert unigram.Counter({}).text("ab é") == 3 + 1 + 1 + 3 + 2  # nothing known: bytes, low lines too


def test_query_on_documents(spark):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    ref = library(unigram.vocabulary(MODEL))
    got = {r.doc_id: (r.n_chars, r.n_tokens) for r in QUERIES["op3_token_counts"](spark, SF_SMALL).collect()}
    assert got == {i: (len(t), len(ref.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
