"""SQL (DuckDB) spellings of the text expressions, mirroring
``pricelens.functions.text`` for the oracle statements."""

from __future__ import annotations

from .. import schemas as S


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(col: str, review_side: bool) -> str:
    low = f"lower({col})"
    if review_side:
        low = f"replace({low}, {q(S.NAME_NOISE_PHRASE)}, '')"
    return f"regexp_replace({low}, '[^a-z0-9]', '', 'g')"


def tokens(col: str) -> str:
    stops = ", ".join(q(s) for s in S.NAME_STOP_TOKENS)
    l_ = f"regexp_extract_all(lower({col}), '[a-z0-9]+')"
    # distinct in first-seen order, then drop stop tokens
    return (f"list_filter(list_filter({l_}, lambda x, i: list_position({l_}, x) = i), "
            f"lambda x: NOT list_contains([{stops}], x))")


def overlap_ok(a: str, b: str) -> str:
    return (f"(len({a}) > 0 AND len({b}) > 0 AND "
            f"len(list_intersect({a}, {b})) >= least(len({a}), len({b})) * CAST({S.OVERLAP_RATIO} AS DOUBLE))")


def names_match(tn: str, rn: str, tt: str, rt: str) -> str:
    return (f"((length({tn}) > 0 AND length({rn}) > 0 AND (contains({rn}, {tn}) OR contains({tn}, {rn}))) "
            f"OR coalesce({overlap_ok(tt, rt)}, false))")


def any_contains(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"


def category(col: str, categories=S.CATEGORIES) -> str:
    low = f"lower({col})"
    parts = [f"WHEN {col} IS NULL OR {col} = '' THEN {q(S.DEFAULT_CATEGORY)}"]
    for name, words in categories:
        parts.append(f"WHEN {any_contains(low, words)} THEN {q(name)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(S.DEFAULT_CATEGORY)} END"


def score(col: str, pos, neg) -> str:
    low = f"lower({col})"
    p = " + ".join(f"CAST(contains({low}, {q(w)}) AS INTEGER)" for w in pos)
    n = " + ".join(f"CAST(contains({low}, {q(w)}) AS INTEGER)" for w in neg)
    return f"(({p}) - ({n}))"


def rule_label(col: str, pos=S.POSITIVE_WORDS, neg=S.NEGATIVE_WORDS) -> str:
    s = score(col, pos, neg)
    return (f"CASE WHEN {col} IS NULL OR {col} = '' THEN 'Neutral' WHEN {s} > 1 THEN 'Positive' "
            f"WHEN {s} < -1 THEN 'Negative' ELSE 'Neutral' END")


def rule_conf(col: str, pos=S.POSITIVE_WORDS, neg=S.NEGATIVE_WORDS) -> str:
    s = score(col, pos, neg)
    return (f"CASE WHEN {col} IS NULL OR {col} = '' THEN 0.5 WHEN {s} > 1 OR {s} < -1 THEN 0.75 "
            f"ELSE 0.5 END")


def llm_parsed(resp: str) -> str:
    """Subquery columns: label, confidence (NULL row values when invalid)."""
    obj = f"regexp_extract({resp}, '\\{{[^{{}}]*\\}}', 0)"
    js = f"CASE WHEN json_valid({obj}) AND {obj} <> '' THEN {obj} END"
    raw_l = f"json_extract_string({js}, '$.sentiment')"
    raw_c = f"json_extract_string({js}, '$.confidence')"
    lab = f"(upper(substr(coalesce({raw_l}, ''), 1, 1)) || lower(substr(coalesce({raw_l}, ''), 2)))"
    has_c = f"coalesce(list_contains(json_keys({js}), 'confidence'), false)"
    conf = (f"(CASE WHEN NOT {has_c} THEN 0.0 WHEN {raw_c} = 'true' THEN 1.0 WHEN {raw_c} = 'false' THEN 0.0 "
            f"ELSE try_cast({raw_c} AS DOUBLE) END)")
    ok = f"({js} IS NOT NULL AND {lab} IN ('Positive', 'Neutral', 'Negative') AND {conf} IS NOT NULL)"
    return f"CASE WHEN {ok} THEN {lab} END AS label, CASE WHEN {ok} THEN {conf} END AS confidence"


def rnd(x: str, n: int) -> str:
    """Spark's ``round`` for doubles: HALF_UP on the shortest decimal text of
    the value (DuckDB's own ``round`` works on the binary value, which
    differs at exact decimal ties such as 1060.2115625)."""
    return (f"CAST(CAST(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)) AS DECIMAL(38,{n})) AS DOUBLE)")
