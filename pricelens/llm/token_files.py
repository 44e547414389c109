"""Token-id files: tokens of whole documents under a static range asymmetric
numeral system.

:func:`write` tokenises documents in ascending id order and writes them as
files of about ``file_tokens`` ids.  A file has one frequency table, made from
all its ids and shared by its blocks.  A block holds ``block_tokens`` ids on
interleaved lanes (id i on lane i mod the number of lanes), each lane a 64-bit
state that gives off 32-bit words; it decodes without any other block.  The
footer has a checkpoint for each block (offset, length, first id, number of ids,
lanes, checksum) and the id and length of each document.  :func:`read` gives
tasks runs of blocks: a task decodes the documents that begin in its run.

File layout (little endian)::

    "RANSTOK1"  blocks  footer  footer length (8)  checksum of footer (4)  "RANSTOK1"
    footer: zlib of  header length (4)  header (JSON: scale bits, blocks, documents, ids, symbols)
            symbols (4 each)  frequencies (4 each)  checkpoints (6 x 8 each)
            document ids (8 each)  has an id (1 each)  document lengths (8 each)
"""

from __future__ import annotations

import json
import zlib
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from ..session import materialize
from .common import offsets, ragged, steps, texts_of, worker_state
from .files import Writer, random_access

MAGIC = b"RANSTOK1"
SCALE = 20
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
STEP = 6 << 20
#: Words and pieces a worker keeps before it starts anew.
KEPT_WORDS, KEPT_PIECES = 700_000, 500_000

# --- range asymmetric numeral system ---------------------------------------


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, one at least for each symbol."""
    if len(counts) > 1 << SCALE:
        raise ValueError("more symbols than the frequency scale has room for")
    total, room = int(counts.sum()), (1 << SCALE) - len(counts)
    freq = 1 + counts.astype(object) * room // total if total > 1 << 40 else 1 + counts.astype(np.int64) * room // total
    freq = np.array(freq, np.int64)
    freq[int(np.argmax(counts))] += (1 << SCALE) - int(freq.sum())
    return freq


class Table:
    """Symbols (ascending ids) with their frequencies."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.start = offsets(freq)[:-1].astype(np.uint64)

    @property
    def places(self) -> np.ndarray:
        """Place in the table of each id up to the largest symbol."""
        if not hasattr(self, "_places"):
            self._places = np.zeros(int(self.symbols[-1]) + 1, np.int32)
            self._places[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        return self._places

    def encode(self, ids: np.ndarray, lanes: int) -> bytes:
        """States of all lanes, then the words in the order a decoder needs."""
        at = self.places[ids]
        freq, start = self.freq[at], self.start[at]
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        shift = np.uint64(31 - SCALE + 32)
        for lo in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            f, s = freq[lo:lo + lanes], start[lo:lo + lanes]
            n = len(f)
            y = x[:n]
            full = y >= f << shift
            if full.any():
                words.append(y[full].astype(np.uint32))
                y = np.where(full, y >> _32, y)
            q, r = np.divmod(y, f)
            x[:n] = (q << np.uint64(SCALE)) + r + s
        out = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        return x.astype("<u8").tobytes() + out.astype("<u4").tobytes()

    @property
    def slots(self) -> np.ndarray:
        if not hasattr(self, "_slots"):
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots

    def decode(self, data: bytes, n: int, lanes: int) -> np.ndarray:
        x = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
        words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
        out = np.empty(n, np.int32)
        mask, scale, at, slots = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), 0, self.slots
        for lo in range(0, n, lanes):
            k = min(lanes, n - lo)
            y = x[:k]
            slot = y & mask
            s = slots[slot]
            out[lo:lo + k] = s
            y = self.freq[s] * (y >> scale) + slot - self.start[s]
            empty = y < LOW
            need = int(np.count_nonzero(empty))
            if need:
                y[empty] = (y[empty] << _32) | words[at:at + need]
                at += need
            x[:k] = y
        if at != len(words) or (x != LOW).any():
            raise ValueError("a block does not decode to its end")
        return self.symbols[out]


# --- tokenising -------------------------------------------------------------

# The layout of the word-BPE tokenizer file for which a text may be cut at spaces and letters runs.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Known:
    """Texts met and the ids of each, one after another."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.off = np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.at)

    def places(self, texts: list[str], learn) -> np.ndarray:
        """Numbers of the texts; ``learn`` gives ids and lengths, in arrays, of those not met yet."""
        at = np.fromiter(map(self.at.get, texts, repeat(-1)), np.int64, len(texts))
        new = at < 0
        if new.any():
            fresh = list(dict.fromkeys(compress(texts, new.tolist())))
            ids, lens = learn(fresh)
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh))))
            self.ids = np.concatenate([self.ids, *ids])
            self.off = np.concatenate([self.off, self.off[-1] + offsets(np.concatenate(lens))[1:]])
            at[new] = np.fromiter(map(self.at.__getitem__, compress(texts, new.tolist())), np.int64, int(new.sum()))
        return at

    def lens(self, at: np.ndarray) -> np.ndarray:
        return self.off[at + 1] - self.off[at]

    def ids_of(self, at: np.ndarray) -> np.ndarray:
        return ragged(self.ids, self.off[at], self.lens(at))


class WordCoder:
    """Ids of texts as the tokenizer file gives them; keeps those of words met.

    For the known layout (composed, lower case, white space dropped, pieces by
    one pattern) a text is the sequence of its words, a word that of its
    pieces, and a piece goes through the library's BPE model once.  Words with
    characters beyond visible Latin ones, texts with a special token in them, and
    files of another layout go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps_ = pre.get("pretokenizers", [])
        self.known_layout = ([n.get("type") for n in norm.get("normalizers", [])] == _NORMALIZERS and len(steps_) == 2
                             and steps_[0].get("pattern", {}).get("Regex") == _SPLIT and steps_[1].get("type") == "ByteLevel")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if self.known_layout:
            m = spec["model"]
            self.bpe = models.BPE(vocab=m["vocab"], merges=[tuple(x if isinstance(x, list) else x.split(" ")) for x in m["merges"]],
                                  end_of_word_suffix=m["end_of_word_suffix"], cache_capacity=0)
            self.spelt = Tokenizer(self.bpe)  # of pieces in byte letters, a space between two
            self.spelt.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.find = regex.compile(_SPLIT).findall
        self.plain = regex.compile("[!-~¡-ɏ]+").fullmatch
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = iter(range(256, 512))
        self.letters = {b: chr(b) if b in visible else chr(next(hidden)) for b in range(256)}
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = Known(), Known()

    def _cut(self, word: str) -> tuple[str, ...]:
        """The pieces of a word; one that the whole tokenizer must see stays as it is, after a space."""
        if not (word.isascii() and word.isprintable() or self.plain(word)):
            return (" " + word,)
        word = word.lower()
        if word.isalpha():  # letters only: one piece
            return (word,)
        if word[-1:] in ".,;:!?" and word[:-1].isalpha():
            return word[:-1], word[-1]
        return tuple(self.find(word))

    def _piece_ids(self, fresh: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of new pieces and how many each has, a few hundred pieces to a call of the library."""
        ids, lens = [], []
        for lo in range(0, len(fresh), 500):
            part = fresh[lo:lo + 500]
            whole = {k: self.whole.encode(p[1:], add_special_tokens=False).ids for k, p in enumerate(part) if p[0] == " "}
            spelt = [p if p.isascii() else p.encode("utf-8").decode("latin-1").translate(self.letters) for k, p in enumerate(part) if k not in whole]
            found = self.spelt.encode(" ".join(spelt), add_special_tokens=False)
            got, n = np.array(found.ids, np.int32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(spelt))
            if whole:
                at, rows = iter(np.split(got, np.cumsum(n)[:-1])), []
                for k in range(len(part)):
                    rows.append(np.array(whole[k], np.int32) if k in whole else next(at))
                got, n = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
            ids.append(got)
            lens.append(n)
        return ids, lens

    def _word_ids(self, fresh: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        cuts = list(map(self._cut, fresh))
        pieces = self.pieces.places(list(chain.from_iterable(cuts)), self._piece_ids)
        per_word = np.fromiter(map(len, cuts), np.int64, len(cuts))
        along = offsets(self.pieces.lens(pieces))
        return [self.pieces.ids_of(pieces)], [np.diff(along[offsets(per_word)])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > KEPT_WORDS or len(self.pieces) > KEPT_PIECES:
            self.forget()
        alone = {k: np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32) for k, t in enumerate(texts)
                 if not self.known_layout or any(s in t for s in self.special)}
        # Arrow cuts at 0x20 and 0x09-0x0D only, and numbers the distinct words; white space at an end gives an empty word
        cut = pc.ascii_split_whitespace(pa.array([b"" if k in alone else t.encode("utf-8", "replace") for k, t in enumerate(texts)], pa.large_string()))
        found = cut.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary)
        words = pc.binary_join(distinct, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(found.dictionary) else []
        at, of = self.words.places(words, self._word_ids)[found.indices.to_numpy()], cut.offsets.to_numpy()
        return [alone[k] if k in alone else self.words.ids_of(at[of[k]:of[k + 1]]) for k in range(len(texts))]


def coder(path: str) -> WordCoder:
    return worker_state(("token_files", path), lambda: WordCoder(path))


# --- files ------------------------------------------------------------------


def _finish(folder: str, stem: str, docs: list[np.ndarray], ids: list, block_tokens: int, lanes: int) -> tuple:
    """Writes one file and returns its line of the listing."""
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    tokens = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    counts = np.bincount(tokens) if len(tokens) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts).astype(np.int32)
    freq = frequencies(counts[symbols]) if len(symbols) else np.zeros(0, np.int64)
    table = Table(symbols, freq)
    out = Writer(folder, stem, ".ranstok")
    out.write(MAGIC)
    checkpoints = []
    for lo in range(0, len(tokens), block_tokens):
        part = tokens[lo:lo + block_tokens]
        width = max(1, min(lanes, len(part) // 64))
        data = table.encode(part, width)
        checkpoints.append((out.write(data), len(data), lo, len(part), width, zlib.crc32(part.astype("<u4").tobytes())))
    header = json.dumps({"scale": SCALE, "blocks": len(checkpoints), "documents": len(docs), "ids": len(tokens), "symbols": len(symbols)}).encode()
    footer = zlib.compress(b"".join([
        len(header).to_bytes(4, "little"), header, symbols.astype("<i4").tobytes(), freq.astype("<u4").tobytes(),
        np.array(checkpoints, "<i8").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(),
        np.array([i is not None for i in ids], np.uint8).tobytes(), lens.astype("<i8").tobytes()]))
    out.write(footer + len(footer).to_bytes(8, "little") + zlib.crc32(footer).to_bytes(4, "little") + MAGIC)
    out.close()
    return out.uri, len(docs), len(tokens), len(checkpoints)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text",
          file_tokens: int = 8 << 20, block_tokens: int = 1 << 18, lanes: int = 1024) -> DataFrame:
    """Writes the documents in ascending id order and returns the list of files:
    ``file``, ``documents``, ``ids``, ``blocks`` and ``start`` (ids in all files
    before it).

    A null text is empty; ``end_id``, unless null, follows every document; a
    null id comes first; rows that share an id follow each other by the hash of
    their text.  An empty table gives no files.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    end = np.array([] if end_id is None else [end_id], np.int32)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        held, ids, size, done = [], [], 0, []

        def finish():
            nonlocal held, ids, size, k
            done.append((part, k, *_finish(folder, f"part-{part:05d}-{k:04d}", held, ids, block_tokens, lanes)))
            held, ids, size, k = [], [], 0, k + 1

        for batch in steps(batches, "text", STEP):
            for id_, tokens in zip(batch.column(batch.schema.get_field_index("id")).to_pylist(), coder(tokenizer_path).encode(texts_of(batch, "text"))):
                held.append(np.concatenate([tokens, end]))
                ids.append(id_)
                size += len(held[-1])
                if size >= file_tokens:
                    finish()
        if held:
            finish()
        cols = list(zip(*done)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 3)],
                                         names=["part", "k", "file", "documents", "ids", "blocks"])

    files = materialize(rows.mapInArrow(run, "part long, k long, file string, documents long, ids long, blocks long"))
    # parts and their files are numbered in id order; a part's files are few
    parts = files.groupBy("part").agg(F.sum("ids").alias("in_part"))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("in_part").over(along), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("ids").over(inside), F.lit(0))
    return materialize(files.join(parts, files.part == parts.p).withColumn("start", start).select("file", "documents", "ids", "blocks", "start"))


class File:
    """A token file opened for reading."""

    def __init__(self, uri: str):
        self.f = random_access(uri)
        size = self.f.size()
        tail = self.f.read_at(20, size - 20)
        if tail[12:] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        length = int.from_bytes(tail[:8], "little")
        packed = self.f.read_at(length, size - 20 - length)
        if zlib.crc32(packed) != int.from_bytes(tail[8:12], "little"):
            raise ValueError(f"the footer of {uri} does not match its checksum")
        data = zlib.decompress(packed)
        n = int.from_bytes(data[:4], "little")
        head, at = json.loads(data[4:4 + n]), 4 + n
        if head["scale"] != SCALE:
            raise ValueError(f"{uri} has another frequency scale")

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.table = Table(take("<i4", head["symbols"]), take("<u4", head["symbols"]).astype(np.int64))
        self.checkpoints = take("<i8", 6 * head["blocks"]).reshape(-1, 6).tolist()
        self.doc_ids, self.has_id = take("<i8", head["documents"]), take("u1", head["documents"])
        self.doc_start = offsets(take("<i8", head["documents"]))

    def block(self, b: int) -> np.ndarray:
        at, length, _, n, lanes, crc = self.checkpoints[b]
        ids = self.table.decode(self.f.read_at(length, at), n, lanes)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {b} does not match its checksum")
        return ids

    def documents(self, first: int, last: int):
        """(id, first token in the file, ids) of the documents that begin in the
        blocks ``first`` to ``last`` (exclusive); one block is held at a time."""
        total = int(self.doc_start[-1])
        at = [c[2] for c in self.checkpoints] + [total]
        lo, hi = (at[first], at[last]) if self.checkpoints else (0, 0)
        d0 = int(np.searchsorted(self.doc_start[:-1], lo))
        d1 = len(self.doc_ids) if last >= len(self.checkpoints) else int(np.searchsorted(self.doc_start[:-1], hi))
        b, ids, base = first, np.zeros(0, np.int32), lo
        for d in range(d0, d1):
            s, e = int(self.doc_start[d]), int(self.doc_start[d + 1])
            parts = []
            while e > base + len(ids):
                parts.append(ids[max(0, s - base):])
                base += len(ids)
                ids = self.block(b)
                b += 1
            parts.append(ids[max(0, s - base):e - base])
            yield (int(self.doc_ids[d]) if self.has_id[d] else None), s, np.concatenate(parts)


def read(files: DataFrame, blocks_per_task: int = 16, id_col: str = "doc_id") -> DataFrame:
    """The documents of the listed files: ``id_col``, ``start`` (ids of all
    documents before it), ``n_tokens`` and ``ids`` (the ids as little-endian
    unsigned 32-bit integers).  Damage found by a checksum raises ``ValueError``."""
    runs = files.select("file", "start", "blocks", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.col("blocks") - 1, F.lit(0)), F.lit(blocks_per_task).cast("long"))).alias("first"))
    tasks = max(1, runs.count())

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f = File(row["file"])
                last = min(row["first"] + blocks_per_task, row["blocks"])
                out, size = [], 0
                for id_, at, ids in f.documents(row["first"], last):
                    out.append((id_, row["start"] + at, len(ids), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size > 1 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)

    def batch_of(rows_):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                          names=[id_col, "start", "n_tokens", "ids"])

    return runs.repartitionByRange(tasks, "file", "first").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids binary")
