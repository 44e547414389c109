"""Temperature mixing: exponents, budgets, blocks."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from pricelens.llm import mixing

SIZES = {"hot": 900, "mid": 200, "low": 60, None: 30, "void": 0}


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for source, n in SIZES.items():
        for k in range(max(n, 3)):
            rows.append((i, source, " ".join(["t"] * (0 if source == "void" else 1 + k % 7)), k))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string, epoch long").repartition(5)


def entropy(shares):
    return -sum(p * math.log(p) for p in shares if p)


def shares_at(tokens, a):
    z = sum(t ** a for t in tokens)
    return [t ** a / z for t in tokens]



def tokens_of(docs):
    out = Counter()
    for r in docs.collect():
        out[r.source] += len((r.text or "").split())
    return out


def test_entropy_target_and_budget(docs):
    n = tokens_of(docs)
    budget = sum(n.values())
    planned = mixing.plan(docs, budget_tokens=budget, entropy_share=0.9, max_repeats=None, block_tokens=200, chunk_rows=16).collect()
    used, copies = Counter(), Counter()
    for r in planned:
        used[r.source] += r.n_tokens
        copies[r.source, r.doc_id] += 1
    tokens = [n[s] for s in ("hot", "mid", "low", None)]
    a = max(k for k in range(0, (1 << 20) + 1, 64) if entropy(shares_at(tokens, k / (1 << 20))) >= 0.9 * math.log(4)) / (1 << 20)
    for s, w in zip(("hot", "mid", "low", None), shares_at(tokens, a)):
        assert abs(used[s] - w * budget) <= 8 + 64e-6 * budget, s  # the last document is taken whole
    # epochs of a source use all its documents before the next begins
    for s in n:
        each = [copies[s, r.doc_id] for r in docs.collect() if r.source == s]
        assert max(each) - min(each) <= 1
    # the sources' shares hold in the first half of the blocks as in all
    blocks = max(r.block for r in planned) + 1
    half = Counter()
    for r in planned:
        if r.block < blocks // 2:
            half[r.source] += r.n_tokens
    for s in ("hot", "mid", "low"):
        assert abs(half[s] / sum(half.values()) - used[s] / sum(used.values())) < 0.03
    at = defaultdict(list)
    for r in planned:
        at[r.block].append(r.pos)
    assert all(sorted(p) == list(range(len(p))) for p in at.values())


def test_without_budget_every_document_once_or_more_within_the_limit(docs):
    planned = mixing.plan(docs, budget_tokens=None, entropy_share=1.0, max_repeats=3.0, block_tokens=500, chunk_rows=50).collect()
    copies = Counter((r.source, r.doc_id) for r in planned)
    assert set(copies) == {(r.source, r.doc_id) for r in docs.collect()}
    by = defaultdict(list)
    for (s, _), c in copies.items():
        by[s].append(c)
    assert set(by["hot"]) == {1} and set(by["void"]) == {1}
    assert max(max(v) for v in by.values()) == 3


def test_same_plan_for_any_partitioning(docs):
    def run(df):
        return sorted((r.doc_id, r.epoch, r.block, r.pos) for r in mixing.plan(df, block_tokens=300, chunk_rows=10).collect())
    assert run(docs) == run(docs.repartition(2).sortWithinPartitions("text"))


def test_mix_keeps_columns_nulls_and_repeated_rows(spark):
    rows = [(1, "a", "x y", 1), (1, "a", "x y", 1), (None, "a", "z", 2), (3, None, None, 3), (3, "b", "", 4), (4, "b", "q " * 50_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, pos int")
    planned = mixing.plan(df, entropy_share=None, max_repeats=None)
    got = mixing.mix(df, planned)
    assert got.columns == ["doc_id", "source", "text", "epoch", "block", "pos"]
    assert Counter((r.doc_id, r.source, r.text) for r in got.collect()) == Counter(r[:3] for r in rows)
    assert mixing.plan(df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    from conftest import SF_SMALL, rows
    from pricelens.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    cols = ["doc_id", "source", "n_tokens", "epoch", "block", "pos"]
    expect = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op1_mixing']})").fetchall())
    assert rows(QUERIES["op1_mixing"](spark, SF_SMALL), *cols) == expect


def test_sql_and_spread_of_a_source_without_tokens(spark, tmp_path):
    from pricelens.llm.queries import ORACLE_SQL, QUERIES

    rows_ = [(i, "void", None if i % 2 else " ") for i in range(300)] + [(i, "full", "t " * 2_000) for i in range(300, 900)]
    spark.createDataFrame(rows_, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op1_mixing"](spark, str(tmp_path)).select("doc_id", "source", "n_tokens", "epoch", "block", "pos").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expect = con.execute(f"SELECT doc_id, source, n_tokens, epoch, block, pos FROM ({ORACLE_SQL['op1_mixing']})").fetchall()
    assert sorted(got) == sorted(expect)
    void = Counter(r[4] for r in got if r[1] == "void")
    assert sum(void.values()) == 300 and len(void) == 5 and max(void.values()) < 100


def test_rows_without_id_are_spread(spark):
    df = spark.createDataFrame([(None, "a", f"w{i} x") for i in range(400)], "doc_id long, source string, text string")
    at = Counter(r.block for r in mixing.plan(df, entropy_share=None, max_repeats=None, block_tokens=80, chunk_rows=40).collect())
    assert sum(at.values()) == 400 and len(at) == 10 and max(at.values()) < 60


def test_main_path_has_no_python(spark):
    from conftest import SF_SMALL
    from pricelens.llm.queries import QUERIES

    plan = QUERIES["op1_mixing"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
