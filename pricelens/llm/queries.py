"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import align, byte_bpe, fertility, lsh_forest, mixing, periodic, repeats, simhash, spotsigs, token_files, toxicity, unigram, warc
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again; digests of both."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, shingle=4, radius=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that stand in an earlier one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, min_words=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def training(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Toxicity model learned from the labels outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return toxicity.train(*toxicity.sample(docs, labels.where(fold != 0)))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = training(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all sources: a budget of as many words as the corpus has,
    weights with 0.995 of the greatest entropy, four epochs at most."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    budget = docs.agg(F.sum(mixing.token_count(F.col("text")))).first()[0] or 0
    return mixing.plan(docs, budget_tokens=budget, entropy_share=0.995, max_repeats=4.0).select(
        "doc_id", "source", "n_tokens", "epoch", "block", "pos")


ORACLE_SQL["op1_mixing"] = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY source),
logs AS (SELECT ln(tokens::DOUBLE) AS log_n, max(ln(tokens::DOUBLE)) OVER () AS log_max, min(ln(tokens::DOUBLE)) OVER () AS log_min,
                count(*) OVER () AS k, sum(tokens) OVER () AS budget FROM totals WHERE tokens > 0),
even(lo, hi) AS (  -- largest exponent with enough entropy
  SELECT 0::BIGINT, 1048576::BIGINT
  UNION ALL
  SELECT CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid - 1 END FROM (
    SELECT lo, hi, (lo + hi + 1) // 2 AS mid,
           ln(sum(exp(((lo + hi + 1) // 2) / 1048576.0::DOUBLE * (log_n - log_max))))
           - ((lo + hi + 1) // 2) / 1048576.0::DOUBLE * sum(exp(((lo + hi + 1) // 2) / 1048576.0::DOUBLE * (log_n - log_max)) * (log_n - log_max))
             / sum(exp(((lo + hi + 1) // 2) / 1048576.0::DOUBLE * (log_n - log_max))) >= 0.995::DOUBLE * ln(max(k)::DOUBLE) AS good
    FROM even, logs WHERE lo < hi GROUP BY lo, hi)),
within_(lo, hi) AS (  -- smallest exponent within the repetition limit
  SELECT 0::BIGINT, 1048576::BIGINT
  UNION ALL
  SELECT CASE WHEN good THEN lo ELSE mid + 1 END, CASE WHEN good THEN mid ELSE hi END FROM (
    SELECT lo, hi, (lo + hi) // 2 AS mid,
           ln(max(budget)::DOUBLE) - ln(sum(exp(((lo + hi) // 2) / 1048576.0::DOUBLE * (log_n - log_max)))) - max(log_max)
           + (1 - ((lo + hi) // 2) / 1048576.0::DOUBLE) * (max(log_max) - min(log_min)) <= ln(4.0::DOUBLE) AS good
    FROM within_, logs WHERE lo < hi GROUP BY lo, hi)),
exponent AS (SELECT greatest((SELECT max(lo) FROM even WHERE lo = hi), (SELECT max(lo) FROM within_ WHERE lo = hi)) / 1048576.0::DOUBLE AS a),
norm AS (SELECT a, max(log_max) AS log_max, sum(exp(a * (log_n - log_max))) AS z, max(budget)::DOUBLE AS whole FROM logs, exponent GROUP BY a),
shared AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN round(exp(a * (ln(tokens::DOUBLE) - log_max)) / z * whole)::BIGINT ELSE 0 END AS budget
  FROM totals, norm),
blocks AS (SELECT greatest(1, ceil(sum(budget) / 262144.0))::BIGINT AS n FROM shared),
copies AS (
  SELECT d.*, s.tokens, s.budget, e.epoch, md5('mix:' || e.epoch || ':' || d.doc_id) AS key
  FROM docs d JOIN shared s ON d.source IS NOT DISTINCT FROM s.source,
       LATERAL (SELECT unnest(range(CASE WHEN s.tokens = 0 THEN 1 ELSE ceil(s.budget / s.tokens::DOUBLE)::BIGINT END)) AS epoch) e),
placed AS (
  SELECT *, epoch * tokens + sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS at_
  FROM copies),
taken AS (
  SELECT doc_id, source, n_tokens, epoch, key, CASE WHEN tokens = 0 THEN (('0x' || substr(key, 1, 7))::BIGINT * n) >> 28 ELSE least(floor(at_::DOUBLE / budget * n)::BIGINT, n - 1) END AS block
  FROM placed, blocks WHERE at_ < budget OR (n_tokens = 0 AND at_ <= budget))
SELECT doc_id, source, n_tokens, epoch::BIGINT AS epoch, block::BIGINT AS block,
       row_number() OVER (PARTITION BY block ORDER BY key, doc_id) - 1 AS pos
FROM taken
"""


@query
def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, token measures and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return fertility.quality(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "byte_share", "token_entropy")


@query
def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness."""
    return spotsigs.compare_with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), "text")
    return unigram.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_chars", "n_tokens")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through monolithic archives, the normaliser and its sidecars."""
    folder = scratch_path(spark, "warc")
    archives = warc.write(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read(warc.normalise(archives, folder), with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op5_warc"] = """
WITH rows_ AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
marked AS (SELECT *, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last_id FROM rows_)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM marked
"""


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the token files: place, length and checksum."""
    files = token_files.write(read(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "token-files"),
                              public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lsh_forest.near_duplicates(docs, shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in the text of about every tenth one, by
    the CRC-32 of its id; words are joined by one space there."""
    @F.arrow_udf("string")
    def tail(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for i, t in zip(ids.to_pylist(), texts.to_pylist()):
            h = zlib.crc32(str(i).encode())
            if i is not None and h % 10 == 0 and t:
                words = t.encode("utf-8", "replace").split()  # bytes: cuts at 0x20 and 0x09-0x0D only
                n, g = len(words), h // 10
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    t = b" ".join(words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn("text", tail("doc_id", "text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, after about every tenth got a periodic
    tail; digests of the runs and of the text without them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.runs(planted(docs), least=6, exponent=4)
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned, and how common its
    links are in the corpus."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
