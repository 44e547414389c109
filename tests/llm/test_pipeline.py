"""The pipeline against brute force, and its stages' edge cases."""

import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_repeats import slow
from test_simhash import slow_components, slow_fingerprint

import corpus_pipeline
from pricelens.llm import byte_bpe, stages, toxicity
from pricelens.llm.queries import BYTE_RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_against_brute_force(spark):
    from conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = stages.training(docs.select("doc_id", "text"), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    meter = toxicity._meter(model)
    clean = [i for i in sorted(rows) if toxicity._scores(np.array([toxicity._features(meter.distances(rows[i].text or ""), model.thresholds)]), model)[0] < 0.5]
    comp = slow_components([slow_fingerprint(rows[i].text) for i in clean], 4)
    kept = [i for k, i in enumerate(clean) if comp[k] == k]
    texts = {}
    for i, w, gone in slow([(i, rows[i].text) for i in kept], 13):
        texts[i] = [x for x, g in zip(w, gone) if not g]
    enc = byte_bpe.Encoder(byte_bpe.load(BYTE_RANKS), P.PATTERN)
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(kept)
    tokens = {}
    for i, rs in by.items():
        assert 1 <= len(rs) <= 4 and len({(r.text, tuple(r.ids)) for r in rs}) == 1
        r = rs[0]
        assert words(r.text) == texts[i] and r.n_chars == (len(r.text) if texts[i] != words(rows[i].text) else rows[i].n_chars)
        assert (r.lang, r.source) == (rows[i].lang, rows[i].source)
        assert r.ids == enc.encode([r.text])[0].tolist() and r.n_tokens == len(r.ids)
        tokens[r.source] = tokens.get(r.source, 0) + len(texts[i])
    # the largest source is used once, none less often
    largest = max(tokens, key=tokens.get)
    assert all(len(rs) == 1 for rs in by.values() if rs[0].source == largest)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"v{i % 7919}q{i % 13}" for i in range(30_000))
    rows = [(1, "first text with a few words here", "en", "a", 3), (1, "first text with a few words here", "en", "a", 3), (None, "no id at all", None, None, None),
            (2, None, "en", "a", None), (3, "", "en", "b", 0), (4, long, "de", "b", 1), (5, long, "de", "b", 1), (None, None, None, None, None), (6, " \n", "en", "c", 2),
            (1, "the same id but another text", "en", "a", 9)]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, th int").repartition(3)


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows_and_empty_table(spark, odd, k):
    from conftest import SF_SMALL

    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF_SMALL)
    if k < 4:
        assert sorted(out.columns) == sorted(odd.columns)
    got = out.collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    if name == "simhash_near_dedup":  # copies of 1 and 5 go, of the texts without words (2, 3, 6) one stays
        assert [i for null, i in ids if not null] in ([1, 1, 2, 4], [1, 2, 4])
        assert sum(null for null, _ in ids) == 1  # "no id at all"; the null text is in the group of 2
    elif name == "substring_dedup":
        assert len(got) == 10 and {r.doc_id: r.text for r in got}[5] == "" and {r.doc_id: r.text for r in got}[2] is None
    else:
        assert {i for null, i in ids if not null} == {1, 2, 3, 4, 5, 6}
    assert stage(spark, odd.limit(0), SF_SMALL).count() == 0


def test_planted_cases(spark):
    """Copies, near copies and shared passages go; clean documents stay whole."""
    from conftest import SF_SMALL

    base = " ".join(f"w{i * 37 % 1009}" for i in range(400))
    near = base.replace("w37 ", "changed ", 1)
    passage = " ".join(f"p{i}" for i in range(60))

    def own(i):
        return " ".join(f"o{i}x{k}" for k in range(120))

    rows = [(10, base), (11, base), (12, near), (13, f"{own(13)} {passage} four"), (14, f"{own(14)}\n{passage}\nseven"), (15, "a clean text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS))
    kept = stages.drop_near_duplicates(spark, docs, SF_SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == [10, 13, 14, 15]
    cut = {r.doc_id: r for r in stages.cut_repeats(spark, kept, SF_SMALL).collect()}
    assert cut[14].text == own(14) + "\nseven" and cut[14].n_chars == len(cut[14].text)
    assert all(cut[i].text == dict(rows)[i] for i in (10, 13, 15))
    mixed = stages.mix_sources(spark, docs.withColumn("source", F.lit(None).cast("string")), SF_SMALL)
    assert sorted(mixed.columns) == sorted(COLUMNS) and mixed.count() == 6
