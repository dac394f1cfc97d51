"""Best-fit decreasing packing of tokenised documents into sequences of fixed length.

Lengths are integers up to the capacity, so documents of one length are interchangeable and the
best-fit decreasing run depends on the corpus only through its histogram of lengths (at most
``capacity`` rows, whatever the corpus). The driver replays the algorithm on that histogram with
a segment tree over remaining capacities, placing runs of equal documents into runs of equal open
bins: the same bins as one document at a time. Executors then look up each document's place by
its length and its rank among the documents of that length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import addressed, give_back, table
from plotweave.operators.ranks import ranked
from plotweave.sources.workspace import staged

CAPACITY, END_ID = 4096, 1
#: Characters of a slice of a long text. Words that each of a worker's two generations remembers,
#: and the UTF-8 bytes of the longest of them: a bound of about 80 MB a worker.
SLICE, KEPT, LONGEST = 1 << 18, 1 << 18, 32
#: Places of the hashes of words that were missed once.
MISSED = 1 << 20


class CapacityTree:
    """A segment tree over 0..capacity that finds the smallest marked value not below a bound."""

    def __init__(self, capacity: int):
        self.base = 1 << (capacity + 1).bit_length()
        self.marks = bytearray(2 * self.base)

    def mark(self, value: int, on: bool) -> None:
        at = self.base + value
        self.marks[at] = on
        while at > 1:
            at >>= 1
            self.marks[at] = self.marks[2 * at] | self.marks[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = self.base + least
        if self.marks[at]:
            return least
        while at > 1 and not (at % 2 == 0 and self.marks[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.base:
            at = 2 * at + (not self.marks[2 * at])
        return at - self.base


def plan_packing(lengths: Iterable[tuple[int, int]], capacity: int) -> np.ndarray:
    """Best-fit decreasing over (length, count) pairs.

    Returns rows (length, first rank, documents, first bin, documents per bin, offset), in
    descending length and ascending rank: the documents of that length with those ranks fill
    consecutive bins, so many to a bin, from that offset on.
    """
    tree, open_bins, rows, bins = CapacityTree(capacity), {}, [], 0

    def keep(room: int, first: int, count: int) -> None:
        if room and count:
            open_bins.setdefault(room, []).append((first, count))
            tree.mark(room, True)

    for length, left in sorted(lengths, reverse=True):
        rank = 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(count, left // each)
            if full:
                rows.append((length, rank, full * each, first, each, capacity - room))
                keep(room - each * length, first, full)
                first, count, rank, left = first + full, count - full, rank + full * each, left - full * each
            if left and left < each and count:
                rows.append((length, rank, left, first, left, capacity - room))
                keep(room - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            keep(room, first, count)
    return np.array(rows, np.int64).reshape(-1, 6)


#: Where a long text may be cut: the tokenizer's pattern never spans ASCII white space.
SPACES = re.compile(r"[ \t\n\x0b\x0c\r]")


def slices(text: str) -> Iterator[str]:
    """A text in slices of about ``SLICE`` characters, cut before white space; one of "" for "".

    Ids of the slices in order are the ids of the text. A run without white space stays whole.
    """
    at = 0
    while len(text) - at > SLICE and (cut := SPACES.search(text, at + SLICE)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


#: Pieces between white space that the fast path takes apart itself: letters, digits and marks of
#: ASCII and Latin-1, which the tokenizer's normaliser only lower-cases.
PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the UTF-8 bytes of the non-ASCII letters in ``PLAIN``."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    letter = {b: chr(b if b in shown else next(hidden)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class _Words(dict):
    """Ids of words by their UTF-8; a word that is missing is encoded.

    A word is remembered when it is missed for the second time (about: by a table of hashes). A
    full generation becomes the older one and the one before it goes, so frequent words stay.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older, self.missed = encode, {}, bytearray(MISSED)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids, place = self.encode(word.decode()), hash(word) % MISSED
            if not self.missed[place] or len(word) > LONGEST:
                self.missed[place] = 1
                return ids
        if len(self) >= KEPT:
            self.older, self.missed = self.copy(), bytearray(MISSED)
            self.clear()
        self[word] = ids
        return ids


class Tokens:
    """Token ids of texts, with the ids of frequent words remembered.

    The tokenizer's pattern never spans ASCII white space, so a text's ids are its words' ids in
    order, and only a word that isn't remembered needs encoding. A plain word is cut into the
    pattern's pieces here and the vocabulary's merges run on them; any other word goes through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.merge, self.letters = self.encoder.model.tokenize, _byte_letters()
        self.known = _Words(self.word)
        self.marks: dict[str, bytes] = {}  # of single marks and digits, so never many

    def _merged(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.merge(piece if piece.isascii() else piece.translate(self.letters))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(piece) > 1:
            key = piece.encode()
            return self.known.get(key) or self.known.older.get(key) or self._merged(piece)
        if not (ids := self.marks.get(piece)):
            ids = self.marks[piece] = self._merged(piece)
        return ids

    def word(self, word: str) -> bytes:
        low = word.lower()
        if low.isascii():
            if low.isalpha():
                return self._merged(low)
            stem = low.rstrip(",.")
            if stem.isalpha() and len(low) - len(stem) == 1:  # the most frequent of the others
                return self._piece(stem) + self._piece(low[-1])
        parts = PLAIN.findall(low)
        if "<|" in low or sum(map(len, parts)) != len(low) or len(low) != len(word):
            return array("I", self.encoder.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join([self._piece(p) for p in parts]) if len(parts) > 1 else self._merged(low)

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        known = self.known.__getitem__
        return b"".join([b"".join(map(known, s.encode("utf-8").split())) for s in slices(text or "")])


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The worker's own, which lives as long as the worker does."""
    return _TOKENS.get(path) or _TOKENS.setdefault(path, Tokens(path))


def _tokenise(path: str, capacity: int, end_id: int, with_ids: bool):
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        names = ["__file", "__row", "id", "piece", "start", "length", "crc", *["ids"] * with_ids]
        kinds = [*[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * with_ids]
        for b in batches:
            rows = []
            places = zip(*(b.column(c).to_pylist() for c in ("__file", "__row", "id")))
            for (f, r, i), t in zip(places, b.column("t")):
                ids = tokens.ids(t.as_py()) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    rows.append((f, r, i, k, at // 4, len(part) // 4, zlib.crc32(part),
                                 *[np.frombuffer(part, "<u4").tolist()] * with_ids))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             names=names)
        give_back()

    return run


def _place(plan: np.ndarray):
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    starts = (plan[:, 0] << 44) | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(starts, (length << 44) | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(row[:, 3] + nth // row[:, 4]),
                 pa.array(row[:, 5] + nth % row[:, 4] * length)],
                names=[*b.schema.names, "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", *,
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: its document, span, checksum and place in a sequence.

    A document is its ids plus ``end_id``; one longer than ``capacity`` (below 2^18) is cut into
    pieces of that length, the last of which may be shorter. Null and empty texts are the end id
    alone. Repeated rows are packed as often as they occur; null ids sort first; an empty table
    gives an empty result. Sequences are filled without gaps from 0. Returns ``key``, ``piece``,
    ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` and, on request, ``ids``.
    """
    kind = ("__file long, __row long, id long, piece int, start long, length long, crc long"
            + ", ids array<long>" * with_ids)
    pieces = staged(
        addressed(docs)
        .select("__file", "__row", F.col(key).cast("long").alias("id"),
                F.col(text).cast("string").alias("t"))
        .mapInArrow(_tokenise(tokenizer, capacity, end_id, with_ids), kind),
        "pieces",
    )
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    plan = plan_packing([(r["length"], r["n"]) for r in histogram], capacity)
    order = ranked(pieces, ["length"], ["id", "piece", "crc"], groups_bounded=True)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in order.schema.fields)
    return order.mapInArrow(_place(plan), kinds + ", sequence_id long, offset long").select(
        F.col("id").alias(key), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        "sequence_id", "offset", *["ids"] * with_ids,
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; nulls, long texts and repeated rows as in :func:`pack_documents`."""
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe())


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
