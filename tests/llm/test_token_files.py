"""Token files: coder, entropy code, files, damage."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pricelens.llm import files, token_files
from pricelens.session import scratch_path

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_coder_equals_library(library):
    rng = random.Random(5)
    alphabet = "abçÉß'sıİΣσ日🙂 \n\t\x1c\x85　´é1²!?_<Ⅷ​\xa0ª\xad"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x <|endoftext|> y", "<|startoftext|>", "a  b"]
    c = token_files.WordCoder(PATH)
    for part in (texts, texts[::-1]):
        assert [i.tolist() for i in c.encode(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_new_words_go_to_the_library_together(library, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéßX") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "!?", "'s", "7", "日"]) for _ in range(3000)]
    texts = [" ".join(words[i:i + 50]) + " \n" * (i % 3) for i in range(0, 3000, 50)] + ["", "  "]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    c, calls = token_files.WordCoder(PATH), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, text, **kw):
            calls.append(text)
            return self.inner.encode(text, **kw)

    c.spelt = Counted(c.spelt)
    assert [i.tolist() for i in c.encode(texts)] == want
    assert 0 < len(calls) <= 8  # at most 500 pieces to a call
    assert [i.tolist() for i in c.encode(texts)] == want and len(calls) <= 8
    monkeypatch.setattr(token_files, "KEPT_WORDS", 100)  # forgets between steps
    assert [i.tolist() for t in texts for i in c.encode([t])] == want


@pytest.mark.parametrize("n,lanes,kinds", [(1, 1, 1), (5, 4, 2), (10_000, 64, 300), (9_999, 1024, 40_000), (4096, 64, 1)])
def test_entropy_code_round_trip(n, lanes, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.int32) * 3
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts).astype(np.int32)
    freq = token_files.frequencies(counts[symbols])
    assert freq.min() >= 1 and freq.sum() == 1 << token_files.SCALE
    table = token_files.Table(symbols, freq)
    data = table.encode(ids, lanes)
    assert table.decode(data, n, lanes).tolist() == ids.tolist()
    if kinds == 300:  # close to the entropy
        p = counts[symbols] / n
        assert (len(data) - 8 * lanes) * 8 <= -(p * np.log2(p)).sum() * n * 1.02 + 64 * lanes


def frame(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10 ** 12), " ".join(rng.choice(["alpha", "beta", "gamma,", "Delta", "ε"]) for _ in range(rng.randint(0, 400)))) for _ in range(120)]
    rows += [(None, "no id"), (5, None), (5, "same id"), (6, ""), (6, ""), (7, "long " * 30_000), (-3, "negative")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(6)


@pytest.mark.parametrize("file_tokens,block,per_task", [(1 << 20, 1 << 18, 16), (3000, 500, 2), (1, 100, 1)])
def test_files_round_trip(spark, library, file_tokens, block, per_task):
    df = frame(spark)
    listing = token_files.write(df, scratch_path(spark, "tokens-test"), PATH, file_tokens=file_tokens, block_tokens=block)
    got = sorted(token_files.read(listing, blocks_per_task=per_task).collect(), key=lambda r: r.start)
    assert len(got) == df.count()
    at, texts = 0, {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [1])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        texts[r.doc_id].remove(ids)
        at += len(ids)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: -10 ** 18 if i is None else i)
    if file_tokens == 1 << 20:
        assert sum(r.ids for r in listing.collect()) == at


def test_no_end_token_and_empty(spark):
    df = spark.createDataFrame([(1, ""), (2, "x"), (3, None), (4, "")], "doc_id long, text string").coalesce(1)
    got = token_files.read(token_files.write(df, scratch_path(spark, "tokens-test"), PATH, end_id=None)).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got) == [(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 0)]
    void = spark.createDataFrame([(1, "")], "doc_id long, text string")
    got = token_files.read(token_files.write(void, scratch_path(spark, "tokens-test"), PATH, end_id=None)).collect()
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == [(1, 0, 0, b"")]
    assert token_files.read(token_files.write(df.limit(0), scratch_path(spark, "tokens-test"), PATH)).count() == 0


def test_damage_is_found(spark):
    df = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    folder = scratch_path(spark, "tokens-test")
    (line,) = token_files.write(df, folder, PATH, block_tokens=1000).collect()
    data = files.read_all(line.file)
    for at in (len(data) // 3, len(data) - 60, len(data) - 3):
        w = files.Writer(folder, "bad", ".ranstok")
        w.write(data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1:])
        w.close()
        with pytest.raises((ValueError, zlib.error, IndexError)):
            list(token_files.File(w.uri).documents(0, line.blocks))


def test_query_on_documents(spark, library):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, SF_SMALL).collect()}
    at = 0
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got
