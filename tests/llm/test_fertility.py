"""Quality rules from tokeniser fertility."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers as P
import sentencepiece

from pricelens.llm import fertility

MODEL = P.path("piece_bpe_32k.model")


def slow_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    again = [0] * len(w)
    for k in range(len(w) - 2):
        if tri[tuple(w[k:k + 3])] > 1:
            again[k:k + 3] = [1] * 3
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(again)


def test_counts_and_measures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n \t", "a", "a b c a b c", "same\nsame\n \n same\nsame", "# * $ % & | < > é", "日本 🙂🙂 x", "a a a a", "x y z " * 5000,
             *("".join(rng.choice(["ab ", "c\n", "d\x0b", "é", "\x1c", "#", "ab c ", "　"]) for _ in range(rng.randint(0, 80))) for _ in range(200))]
    df = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, N_WORDS int").repartition(3)
    out = fertility.measure(df, MODEL)
    assert out.columns[:3] == ["doc_id", "text", "lang"] and out.columns.count("n_words") == 1 and "N_WORDS" not in out.columns
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in out.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        ids = [i for x in w for i in sp.encode(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(texts[r.doc_id]), texts[r.doc_id]
        assert r.n_tokens == len(ids)
        assert abs(r.byte_share - (sum(map(sp.is_byte, ids)) / len(ids) if ids else 0)) < 1e-12
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in collections.Counter(ids).values()) if ids else 0
        assert abs(r.token_entropy - entropy) < 1e-9


def prose(rng, n):
    words = "the of and to in is that it was for on are with as his they be at one have this from by hot but some what there we can out other were all your when".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "ing", "er", ","]) for _ in range(n))


def test_verdicts(spark):
    rng = random.Random(8)
    rows = [(i, "en", prose(rng, rng.randint(60, 400)), "good") for i in range(200)]
    rows += [(1000 + i, "en", " ".join(w + "&%*" for w in prose(rng, 150).split()), "bad") for i in range(8)]
    rows += [(2000 + i, "en", " ".join(f"x{rng.randrange(10 ** 9):x}" for _ in range(150)), "bad") for i in range(8)]
    rows += [(3000, "xx", "日本 語語 " * 40, "base"), (3001, "xx", " ".join(f"語{chr(0x4e00 + k)}" for k in range(100)), "good"), (3002, None, prose(rng, 80), "good"),
             (3003, "en", None, "base"), (3004, "en", "too few words", "base"), (None, "en", prose(rng, 90), "good")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, slope string")
    got = fertility.quality(df.repartition(4), MODEL).collect()
    assert len(got) == len(rows)
    for kind in ("good", "bad"):
        kept = [r.kept for r in got if r.slope == kind]
        assert sum(kept) / len(kept) > 0.98 if kind == "good" else not any(kept)
    assert all(r.base_failed and not r.kept for r in got if r.slope == "base")
    assert fertility.quality(df.limit(0), MODEL).count() == 0


def test_rare_languages_are_judged(spark):
    """Junk under a rare or misspelt label meets the band of its script, and that
    of all documents where the script is rare too."""
    rng = random.Random(11)
    rows = [(i, "en", prose(rng, rng.randint(60, 400)), True) for i in range(200)]
    for k, lang in enumerate(("eng", "xx", None)):
        rows += [(1000 + 10 * k, lang, prose(rng, 120), True), (1001 + 10 * k, lang, " ".join(f"x{rng.randrange(10 ** 9):x}" for _ in range(150)), False)]
    rows.append((2000, "zz", " ".join(chr(0x12000 + rng.randrange(200)) * 2 for _ in range(120)), False))
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, good boolean")
    got = fertility.quality(df.repartition(3), MODEL).collect()
    assert {r.doc_id for r in got if r.doc_id >= 1000 and r.kept != r.good} == set()
    assert sum(r.kept for r in got if r.doc_id < 1000) >= 198
    few = spark.createDataFrame([(i, f"l{i}", prose(rng, 200), True) for i in range(30)] + [rows[201]], df.schema)
    assert [r.doc_id for r in fertility.quality(few, MODEL).collect() if not r.kept] == [1001]
    assert fertility._script("Привет, мир abc 12") == "CYRILLIC" and fertility._script("12 %") == ""


def test_query_on_documents(spark):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op4_fertility"](spark, SF_SMALL).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n, chars, symbols, dup, rep = slow_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.kept and r.base_failed)


def test_repeats_of_millions_of_words():
    """No two different triples are taken for one, however many words there are."""
    n = 4_400_000
    words = np.arange(n)
    assert fertility._repeats(words) == 0
    words[-3:] = words[:3]
    assert fertility._repeats(words) == 6
    rng = np.random.default_rng(1)
    few = rng.integers(0, 6, 500)  # the same for small and for large numbers
    assert fertility._repeats(few) == fertility._repeats(few + (1 << 21)) == fertility._repeats(few * 3_000_000) > 100


def slow_judge(rows, group, least_docs=50):
    """Verdicts by the rules written out, one row at a time."""
    def mid(x):
        x = sorted(x)
        return x[max(0, math.ceil(len(x) * 0.5) - 1)]

    def band(members):
        cpt = mid(r.chars_per_token for r in members)
        ln, h = (np.array([f(r) for r in members]) for f in (lambda r: math.log2(r.n_tokens), lambda r: r.token_entropy))

        def line(ln, h):
            if len(ln) < 2 or not ln.var():
                return 0.0, h.mean()
            slope = ((ln - ln.mean()) * (h - h.mean())).sum() / ((ln - ln.mean()) ** 2).sum()
            return slope, h.mean() - slope * ln.mean()
        slope, cut = line(ln, h)
        off = h - slope * ln - cut
        close = abs(off) <= 3 * 1.4826 * mid(abs(off))
        slope, cut = line(ln[close], h[close])
        fit = h - slope * ln - cut
        return dict(cpt=cpt, byte=mid(r.byte_share for r in members), slope=slope, cut=cut,
                    spread=1.4826 * mid(abs((r.chars_per_token - cpt) * math.sqrt(r.n_tokens)) for r in members),
                    h_mid=mid(fit), h_spread=1.4826 * mid(abs(fit)))

    enough = [r for r in rows if r.n_tokens >= 30]
    groups, scripts = collections.defaultdict(list), collections.defaultdict(list)
    for r in enough:
        groups[r[group] or ""].append(r)
        scripts[r.script or ""].append(r)
    by_group = {g: band(m) for g, m in groups.items() if len(m) >= least_docs}
    by_script = {g: band(m) for g, m in scripts.items() if len(m) >= least_docs}
    whole = band(enough) if enough else None
    out = {}
    for r in rows:
        b = by_group.get(r[group] or "") or by_script.get(r.script or "") or whole
        if not b or not r.n_tokens:
            out[r.doc_id] = False
            continue
        low_cpt = (b["cpt"] - r.chars_per_token) * math.sqrt(r.n_tokens) / max(b["spread"], 0.02 * b["cpt"])
        low_h = (b["slope"] * math.log2(r.n_tokens) + b["cut"] + b["h_mid"] - r.token_entropy) / max(b["h_spread"], 0.02)
        out[r.doc_id] = low_cpt > 5 or low_h > 5 or low_cpt + low_h > 7 or r.byte_share > b["byte"] + 0.1
    return out


def test_verdicts_equal_the_rules_written_out(spark):
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang", "text")
    rng = random.Random(4)
    junk = [(10_000 + i, rng.choice(["en", "de", "zz", None]), " ".join(f"x{rng.randrange(10 ** 9):x}" for _ in range(80)) + " " + prose(rng, 10 * i))
            for i in range(30)]
    every = fertility.quality(docs.unionByName(spark.createDataFrame(junk, docs.schema)), MODEL).collect()
    expect = slow_judge([r for r in every if not r.base_failed], "lang")
    assert {r.doc_id: r.rejected for r in every if not r.base_failed} == expect
    assert any(expect.values()) and not all(expect.values())
