"""Best-two-fit packing of tokenised documents into sequences.

Only the lengths matter for the plan, and there are at most CAPACITY of them:
the plan is made on the driver from the histogram of lengths, whatever the
number of documents.  A sequence is filled greedily with the longest piece that
still fits; then its smallest piece is exchanged for two unpacked ones that
fill the space it leaves more tightly, as long as there are such.  The same
filling repeats until one of its lengths runs out, so the plan has at most as
many kinds of sequence as there are lengths.  A piece finds its place by its
length and its number among the pieces of that length.
"""

from __future__ import annotations

import os
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .sharding import slots
from .tokens import slices

CAPACITY = 2048
#: Words whose ids a worker keeps in each of two generations (some 150 bytes a word),
#: and the bytes of text that it encodes together.
CACHED_WORDS, ENCODED_BYTES = 600_000, 3_000_000


class Encoder:
    """Token ids of texts in a lower-casing tokenizer that never merges across white
    space, nor across a letter and a mark that follows it.

    It gives a text the ids of its words in turn, so each word is encoded once
    and then looked up.  Only blanks, tabs and line ends split here; what else counts as white space stays inside a word, where the
    tokenizer itself sees to it.  Words are kept in two generations, so that
    the frequent ones stay when the memory is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self._mark, self._mark_id = max(special.items(), default=("", -1))
        self._special = tuple(special)
        self._known: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word: all in one text, parted by a special token."""
        if not self._mark or any(x in w for x in self._special for w in words):
            return self._one_by_one(words)
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self._tokenizer.encode_batch_fast([self._mark.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self._mark_id)
            data, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            starts = [0, *(4 * cuts + 4).tolist()]
            out += [data[a:b] for a, b in zip(starts, ends)] if len(cuts) == len(some) - 1 else self._one_by_one(some)
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """For each text (null: empty) its ids as little-endian 32-bit numbers."""
        if len(self._known) > CACHED_WORDS:
            self._known, self._older = {"": b""}, self._known
        # Lower case may come first where no accent can combine: the tokenizer lower-cases anyway.
        split = [(t.lower() if t.isascii() and not any(x in t for x in self._special) else t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in (t or "" for t in texts)]
        found = [list(map(self._known.get, words)) for words in split]
        gaps = [[i for i, p in enumerate(parts) if p is None] for parts in found]
        missing = list({words[i] for words, own in zip(split, gaps) for i in own})
        # A word of letters and the marks at its end are encoded apart: there are fewer of either.
        apart = {w: (core, w[len(core) :]) for w in missing if w not in self._older and (core := w.rstrip(string.punctuation)) != w and core.isalpha()}
        wanted = {x for w in missing for x in apart.get(w, (w,)) if x not in self._known}
        new = [w for w in wanted if w not in self._older]
        self._known.update((w, self._older[w]) for w in wanted if w in self._older)
        self._known.update(zip(new, self._encoded(new)))
        self._known.update((w, self._known[core] + self._known[end]) for w, (core, end) in apart.items())
        for words, parts, own in zip(split, found, gaps):
            for i in own:
                parts[i] = self._known[words[i]]
        return [b"".join(parts) for parts in found]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents.

    A document is its ids and then end_id (so a null or empty one has length
    1), cut only where it is longer than `capacity`.  Rows are taken one by
    one: repeated ids give repeated pieces, a null id stays null.
    """

    def cut(batches):
        encoder, end = _encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for s in slices(batches, text, ENCODED_BYTES):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(s.batch.column("doc_id").to_pylist(), encoder.ids(s.batch.column(text).to_pylist())):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _two(left: np.ndarray, gap: int) -> tuple[int, int]:
    """The two lengths, of which enough are left, with the largest sum up to gap."""
    lengths = np.flatnonzero(left[: gap + 1])
    low, high, best = 0, len(lengths) - 1, (0, 0)
    while low <= high:
        a, b = int(lengths[low]), int(lengths[high])
        if a + b > gap or (low == high and left[a] < 2):
            high -= 1
            continue
        if a + b > sum(best):
            best = (b, a)
        low += 1
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences) that pack all pieces."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        bin_: list[int] = []
        gap = capacity
        while gap and (fits := np.flatnonzero(left[1 : gap + 1])).size:
            length = int(fits[-1]) + 1
            n = min(gap // length, int(left[length]))
            bin_ += [length] * n
            left[length] -= n
            gap -= n * length
        while gap and len(bin_) > 1:
            small = bin_[-1]
            pair = _two(left, gap + small)
            if sum(pair) <= small:
                break
            bin_[-1:] = pair
            left[small] += 1
            for x in pair:
                left[x] -= 1
            gap += small - sum(pair)
            bin_.sort(reverse=True)
        lengths, uses = np.unique(bin_, return_counts=True)
        more = int((left[lengths] // uses).min())
        left[lengths] -= more * uses
        out.append((bin_, more + 1))
    return out


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (with `length`, 1 to capacity) with sequence_id and offset.

    Every row is placed; an empty table gives an empty one.  Rows of one length
    are exchangeable, so repeated rows simply take several places.
    """
    numbered = staged(slots(rows, "length", "doc_id"), "numbered")
    counts = {int(r["length"]): int(r["n"]) for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, base, used = [], 0, dict.fromkeys(counts, 0)
    for lengths, n in plan(counts, capacity):
        at = 0
        for length in lengths:
            places.append((length << 44 | used[length], base, at))
            used[length] += n
            at += length
        base += n
    key, first, offset = (np.array(c, dtype=np.int64) for c in (zip(*sorted(places)) if places else ([], [], [])))
    schema = numbered.drop("slot").withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema
    for f in schema:
        f.nullable = True

    def place(batches):
        for b in batches:
            own = (b.column("length").to_numpy() << 44) | b.column("slot").to_numpy()
            at = np.searchsorted(key, own, "right") - 1
            keep = [b.column(c) for c in b.schema.names if c != "slot"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(first[at] + own - key[at]), pa.array(offset[at])], names=schema.names)

    return numbered.mapInArrow(place, schema)


def word_tokenizer() -> str:
    """Where the installed vocabulary package keeps the word-end BPE."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return packed(pieces(docs, tokenizer or word_tokenizer()))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences; see pieces() and packed() for nulls, empty texts, ties and repeated rows."""
    return pack_documents(table(spark, sf_dir, "documents"))
