"""Quality rules from tokeniser fertility.

A public vocabulary cuts every text; characters per token, the share of
byte-fallback tokens and the entropy of the token distribution say how well
the text fits what the vocabulary has seen.  Rejection bands are set per
language from statistics over all its documents:

* characters per token lie around the language's median with a spread that
  shrinks with the root of the number of tokens,
* token entropy follows the logarithm of the number of tokens,
* the byte-fallback share stays near the language's median.

A language with too few documents for a band of its own is judged by the band
of its texts' script (that of most letters), over all documents in this script;
where the script has too few as well, by one band over all documents.

A text is rejected if one of the first two lies ``one_sided`` robust deviations
below its band's centre, if both together lie ``both`` below, or if the
byte-fallback share exceeds the median by ``byte_margin``.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import offsets, ragged, texts_of, with_columns, worker_state

STEP = 8 << 20
#: Words a worker keeps before it starts anew (fewer than 2**21, see _repeats).
KEPT = 400_000
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\r\x0b\x0c"
#: The group of all documents, beside the names of scripts.
ALL = "*"


class Pieces:
    """Token ids of the words met so far under one vocabulary."""

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.off = np.zeros(1, np.int64)

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the words of each text."""
        if len(self.known) > KEPT:
            self.forget()
        known, fresh, out = self.known, [], []
        for t in texts:
            words = t.encode("utf-8", "replace").split()  # bytes: cuts at 0x20 and 0x09-0x0D only
            for w in set(words).difference(known):
                known[w] = len(known)
                fresh.append(w.decode())
            out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if fresh:
            ids = self.model.encode(fresh, num_threads=1)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], np.int32)])
            self.off = np.concatenate([self.off, self.off[-1] + offsets(lens)[1:]])
        return out

    def tokens(self, words: np.ndarray) -> np.ndarray:
        return ragged(self.ids, self.off[words], self.off[words + 1] - self.off[words])


def pieces(model_path: str) -> Pieces:
    return worker_state(("fertility", model_path), lambda: Pieces(model_path))


def _repeats(words: np.ndarray) -> int:
    """Words in windows of three words that stand in the text twice or more."""
    if len(words) < 4:
        return 0
    if words.max() < 1 << 21:  # three numbers fit into one of 63 bits
        key = words[:-2] << 42 | words[1:-1] << 21 | words[2:]
    else:  # numbered by what the text holds, first pairs, then a pair and a word
        words = np.unique(words, return_inverse=True)[1]
        pairs = np.unique(words[:-1] * len(words) + words[1:], return_inverse=True)[1]
        key = pairs[:-1] * len(words) + words[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + len(again)] |= again
    return int(covered.sum())


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def _entropy(tokens: np.ndarray) -> float:
    if not len(tokens):
        return 0.0
    ordered = np.sort(tokens)
    cut = np.flatnonzero(np.diff(ordered)) + 1
    p = np.diff(np.concatenate([[0], cut, [len(ordered)]])) / len(ordered)
    return float(-(p * np.log2(p)).sum())


@functools.cache
def _scripts() -> tuple[list[str], np.ndarray]:
    """Names of scripts and, for each code point, the place of its own: the
    first word of a letter's Unicode name, the empty name for all else."""
    places, of = {"": 0}, np.zeros(0x110000, np.uint16)
    for c in filter(str.isalpha, map(chr, range(0x110000))):
        of[ord(c)] = places.setdefault(unicodedata.name(c, "").split(" ")[0], len(places))
    return list(places), of


def _script(text: str) -> str:
    """The script of most letters, empty without letters."""
    names, of = _scripts()
    letters = np.zeros(len(names), np.int64)
    for i in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[i:i + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters += np.bincount(of[codes], minlength=len(names))
    letters[0] = 0
    return names[int(letters.argmax())]


_MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
             ("n_repeat_words", T.LongType()), ("n_tokens", T.LongType()), ("chars_per_token", T.DoubleType()),
             ("byte_share", T.DoubleType()), ("token_entropy", T.DoubleType()),
             ("script", T.StringType())]


def measure(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, token measures and script of ``text_col``: null
    and empty texts have zero everywhere and no script (the empty name).  Other columns pass through, those named
    as a measure are replaced."""
    def run(batch: pa.RecordBatch) -> list:
        vocabulary, texts, rows = pieces(model_path), texts_of(batch, text_col), []
        for text, words in zip(texts, vocabulary.words(texts)):
            tokens = vocabulary.tokens(words)
            chars, n = len(text) - sum(map(text.count, _BLANKS)), len(tokens)
            rows.append((len(words), chars, sum(map(text.count, SYMBOLS)), _duplicate_lines(text), _repeats(words), n,
                         chars / n if n else 0.0, float(vocabulary.is_byte[tokens].mean()) if n else 0.0, _entropy(tokens),
                         _script(text)))
        return [pa.array(c) for c in map(list, zip(*rows))]

    return with_columns(docs, text_col, [T.StructField(*m) for m in _MEASURES], run, limit=STEP)


def _median(c: Column | str) -> Column:
    return F.percentile_approx(c, F.lit(0.5), F.lit(10_000))


def bands(measured: DataFrame, group: str, least_docs: int = 50, least_tokens: int = 30) -> DataFrame:
    """Centre and spread of the measures in each group with ``least_docs``
    documents of ``least_tokens`` tokens: one row per group, ``grp`` its name.
    Where texts of one length leave entropy no slope, its mean is the centre."""
    rows = measured.where(F.col("n_tokens") >= least_tokens).select(
        F.coalesce(F.col(group), F.lit("")).alias("grp"), F.col("chars_per_token").alias("cpt"), "byte_share",
        F.col("token_entropy").alias("h"), F.log2("n_tokens").alias("ln"), F.sqrt("n_tokens").alias("root"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(small(right), "grp")

    def line(slope: str, cut: str) -> list[Column]:
        return [F.coalesce(F.regr_slope("h", "ln"), F.lit(0.0)).alias(slope),
                F.coalesce(F.regr_intercept("h", "ln"), F.avg("h")).alias(cut)]

    first = rows.groupBy("grp").agg(
        F.count("*").alias("docs"), _median("cpt").alias("cpt_mid"), _median("byte_share").alias("byte_mid"),
        *line("slope0", "cut0")).where(F.col("docs") >= least_docs)
    first = materialize(first)
    off = F.col("h") - (F.col("slope0") * F.col("ln") + F.col("cut0"))
    second = materialize(joined(rows, first).groupBy("grp").agg(
        (1.4826 * _median(F.abs((F.col("cpt") - F.col("cpt_mid")) * F.col("root")))).alias("cpt_spread"),
        (3 * 1.4826 * _median(F.abs(off))).alias("near")))
    near = joined(joined(rows, first), second).where(F.abs(off) <= F.col("near"))
    third = materialize(near.groupBy("grp").agg(*line("slope", "cut")))
    fit = F.col("h") - (F.col("slope") * F.col("ln") + F.col("cut"))
    fourth = joined(rows, third).groupBy("grp").agg(_median(fit).alias("h_mid"), (1.4826 * _median(F.abs(fit))).alias("h_spread"))
    return (first.select("grp", "docs", "cpt_mid", "byte_mid").join(second.select("grp", "cpt_spread"), "grp")
            .join(third, "grp").join(fourth, "grp"))


def small(table: DataFrame, rows: int = 10_000) -> DataFrame:
    """The table with a broadcast hint if it is small by count."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def judge(measured: DataFrame, group: str = "lang", one_sided: float = 5.0, both: float = 7.0, byte_margin: float = 0.1,
          least_spread: float = 0.02, least_docs: int = 50) -> DataFrame:
    """``measured`` with ``rejected``: whether the token measures lie outside the
    bands of the row's group.

    A null group is a group of its own.  A group without ``least_docs``
    documents of enough tokens has the band of the row's ``script``, a script
    without as many the band over all documents, however few they are: every
    text with tokens is judged, unless no document at all has enough of them.
    Texts without tokens are never rejected here.  The spreads have a floor:
    ``least_spread`` of the centre, or as many bits of entropy.
    """
    wider = bands(measured.withColumn("__wider", F.explode(F.array(F.coalesce("script", F.lit("")), F.lit(ALL)))), "__wider", 1)
    wider = materialize(wider.where((F.col("docs") >= least_docs) | (F.col("grp") == ALL)))
    kinds = [f for f in wider.schema.fields if f.name != "grp"]
    whole = wider.where(F.col("grp") == ALL).first()  # one row of numbers
    rows, found = measured, []
    for limits, name, key in ((materialize(bands(measured, group, least_docs)), "group", F.coalesce(F.col(group), F.lit(""))),
                              (wider, "script", F.coalesce("script", F.lit("")))):
        band = limits.select(F.col("grp").alias(f"__{name}"), F.struct(*[f.name for f in kinds]).alias(f"__{name}_band"))
        rows = rows.withColumn(f"__{name}", key).join(small(band), f"__{name}", "left").drop(f"__{name}")
        found.append(f"__{name}_band")
    last = F.struct(*[F.lit(whole[f.name] if whole else None).cast(f.dataType).alias(f.name) for f in kinds])
    rows = rows.withColumn("__band", F.coalesce(*found, last)).drop(*found)

    def of(name: str) -> Column:
        return F.col(f"__band.{name}")

    n = F.greatest("n_tokens", F.lit(1))
    low_cpt = (of("cpt_mid") - F.col("chars_per_token")) * F.sqrt(n) / F.greatest(of("cpt_spread"), least_spread * of("cpt_mid"))
    low_h = (of("slope") * F.log2(n) + of("cut") + of("h_mid") - F.col("token_entropy")) / F.greatest(of("h_spread"), F.lit(least_spread))
    out = (low_cpt > one_sided) | (low_h > one_sided) | ((low_cpt + low_h) > both) | (F.col("byte_share") > of("byte_mid") + byte_margin)
    return rows.withColumn("rejected", F.coalesce(out & (F.col("n_tokens") > 0), F.lit(False))).drop("__band")


def quality(docs: DataFrame, model_path: str, text_col: str = "text", group: str = "lang", least_words: int = 50) -> DataFrame:
    """``docs`` without the text, with its measures, ``base_failed`` (few words,
    or over half of them in repeated windows), ``rejected`` and ``kept``.

    The bands are learned from documents that pass the base rules; repeated
    rows count as often as they occur.
    """
    rows = measure(docs, model_path, text_col).drop(text_col).withColumn(
        "base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = materialize(rows)
    passed = judge(rows.where(~F.col("base_failed")), group)
    failed = rows.where("base_failed").withColumn("rejected", F.lit(False))
    return passed.unionByName(failed).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))
