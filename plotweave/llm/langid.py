"""Language identification: known words first, shorter and shorter n-grams for the others.

The model is counted on a bounded sample of labelled documents. A known word adds its logarithmic
frequency in every language. An unseen word falls back to its character n-grams of the greatest
length of which at least one is known, so the evidence gets shorter only as far as it must. Every
word and n-gram of the sample is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import give_back, table, text_of

#: Labelled rows that the model is counted on (about), the longest n-grams, and words counted at
#: once on the driver.
TRAIN_ROWS, GRAM, CHUNK = 20_000, 5, 1 << 15
#: Words, and n-grams, that are looked up at once; a longer text or run is read in parts of that
#: many, so memory doesn't grow with either.
TOGETHER = 1 << 18
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")  # runs of letters, and of numbers that aren't digits


def sampled(rows: DataFrame, id_column: str, at_most: int) -> DataFrame:
    """About ``at_most`` rows, chosen by a hash of the id; all of them where there are fewer."""
    share = at_most / max(1, rows.count())
    if share >= 1:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 30)) < int(share * (1 << 30)))


def ngrams(word: str, size: int) -> list[str]:
    """Runs of characters of a word with its start and end marked; single ones without marks."""
    edged = word if size == 1 else f"^{word}$"
    return [edged[i:i + size] for i in range(len(edged) - size + 1)]


def _logs(counts: np.ndarray) -> np.ndarray:
    n = counts + 0.5
    return np.log(n / n.sum(axis=0)).astype(np.float32)


def _places(values: list[str] | pa.Array, among: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of the values occur ``among`` others, and the places of those that do."""
    at = pc.index_in(values if isinstance(values, pa.Array) else pa.array(values, pa.large_string()), value_set=among)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    return known, at.drop_null().to_numpy()


def _sums(owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by owner, each in the order of its rows."""
    return np.stack([np.bincount(owner, column, n) for column in rows.T], axis=1) if rows.shape[1] else np.zeros((n, 0))


def _packs(parts: Iterator[tuple[int, list[str]]]) -> Iterator[list[tuple[int, list[str]]]]:
    """The parts in lists of about ``TOGETHER`` strings; no part is split."""
    pack, size = [], 0
    for part in parts:
        pack.append(part)
        size += len(part[1])
        if size >= TOGETHER:
            yield pack
            pack, size = [], 0
    yield pack


def _grams_of(words: list[str], table: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """The different n-grams of some words and their counts by language, one length after the other.

    The n-grams at all places are numbered together: an n-gram is the number of the one a
    character shorter at its place, and its last character.
    """
    edged = "".join([f"^{w}$" for w in words])
    chars = np.frombuffer(edged.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters to the word's end
    marks = (left == 1) | (left == lengths[owner])
    alphabet, letter = np.unique(chars, return_inverse=True)
    at, code = np.arange(len(chars)), letter.astype(np.int64)
    for size in range(1, GRAM + 1):
        if size > 1:
            whole = left[at] >= size
            at = at[whole]
            code = code[whole] * len(alphabet) + letter[at + size - 1]
        used = ~marks if size == 1 else np.ones(len(at), bool)
        _, first, place = np.unique(code[used], return_index=True, return_inverse=True)
        of = owner[at[used]]
        yield [edged[i:i + size] for i in at[used][first].tolist()], np.stack(
            [np.bincount(place, column[of], len(first)) for column in table.T], axis=1
        ) if table.shape[1] else np.zeros((len(first), 0))
        code = place if size > 1 else code


class Model:
    """Log frequencies of words and n-grams by language, as Arrow arrays with tables beside.

    Nothing is remembered between texts: the different words of some texts are looked up at once.
    """

    def __init__(self, counts: pa.Table | list[tuple[str, str, int]]):
        if not isinstance(counts, pa.Table):
            counts = pa.table([pa.array(c) for c in zip(*counts)] or [[], [], []], names=["word", "lang", "n"])
        word, lang = (counts[c].cast(pa.large_string()).combine_chunks().dictionary_encode() for c in ("word", "lang"))
        self.languages = sorted(lang.dictionary.to_pylist())
        place = {x: i for i, x in enumerate(self.languages)}
        columns = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int64)
        self.words: pa.Array = word.dictionary
        table = np.zeros((len(self.words), len(place)))
        if len(counts):
            np.add.at(table, (word.indices.to_numpy(), columns[lang.indices.to_numpy()]), counts["n"].to_numpy())
        self.word_logs = _logs(table)
        self.grams, self.gram_logs = self._count_grams(table)

    def _count_grams(self, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """All n-grams of the words, and their log frequencies among those of one length."""
        grams: dict[str, int] = {}
        sums = np.zeros((0, table.shape[1]))
        for i in range(0, len(self.words), CHUNK):
            for found, counts in _grams_of(self.words[i:i + CHUNK].to_pylist(), table[i:i + CHUNK]):
                at = [grams.setdefault(g, len(grams)) for g in found]
                sums = np.concatenate([sums, np.zeros((len(grams) - len(sums), table.shape[1]))])
                sums[at] += counts
        logs, sizes = np.zeros(sums.shape, np.float32), np.fromiter(map(len, grams), np.int64, len(grams))
        for size in range(1, GRAM + 1):
            logs[sizes == size] = _logs(sums[sizes == size])
        return pa.array(grams, pa.large_string()), logs

    def _gram_sums(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the known n-grams of one length by word, and how many there are."""
        total, found = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)

        def parts() -> Iterator[tuple[int, list[str]]]:
            for i, w in enumerate(words):
                edged = w if size == 1 else f"^{w}$"
                last = len(edged) - size + 1
                for at in range(0, last, TOGETHER):
                    yield i, [edged[j:j + size] for j in range(at, min(at + TOGETHER, last))]

        for pack in _packs(parts()):
            known, places = _places([g for _, part in pack for g in part], self.grams)
            of = np.repeat(np.arange(len(pack)), [len(part) for _, part in pack])[known]
            word = np.array([i for i, _ in pack], np.int64)
            np.add.at(total, word, _sums(of, self.gram_logs[places], len(pack)))
            np.add.at(found, word, np.bincount(of, minlength=len(pack)))
        return total, found

    def scores(self, words: list[str] | pa.Array) -> np.ndarray:
        """A row a word, a column a language. An unseen word has the mean of its known n-grams of
        the greatest length of which any is known, and zeros if none is known at all."""
        if not isinstance(words, pa.Array):
            words = pa.array(words, pa.large_string())
        out = np.zeros((len(words), len(self.languages)), np.float32)
        known, places = _places(words, self.words)
        out[known] = self.word_logs[places]
        left = np.flatnonzero(~known)
        for size in range(GRAM, 0, -1):
            if not len(left):
                break
            total, found = self._gram_sums(words.take(pa.array(left)).to_pylist(), size)
            hit = found > 0
            out[left[hit]] = total[hit] / found[hit, None]
            left = left[~hit]
        return out

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """Language and score of every text."""
        letter: list[bool] = []

        def parts() -> Iterator[tuple[int, list[str]]]:
            for i, t in enumerate(texts):
                low = (t or "").lower()
                letter.append(False)
                if len(low) <= TOGETHER:
                    runs = iter([LETTERS.findall(low)])
                else:
                    each = (m[0] for m in LETTERS.finditer(low))
                    runs = chain([[]], iter(lambda: list(islice(each, TOGETHER)), []))
                for words in runs:
                    letter[i] = letter[i] or any(w.isalpha() or any(map(str.isalpha, w)) for w in words)
                    yield i, words

        def totals() -> Iterator[tuple[int, np.ndarray]]:
            for pack in _packs(parts()):
                words = pa.array([w for _, part in pack for w in part], pa.large_string()).dictionary_encode()
                of = np.repeat(np.arange(len(pack)), [len(part) for _, part in pack])
                rows = self.scores(words.dictionary)[words.indices.to_numpy()]
                yield from zip((i for i, _ in pack), _sums(of, rows, len(pack)))

        for i, runs in groupby(totals(), itemgetter(0)):
            total = sum(t for _, t in runs)
            if not self.languages or not letter[i]:
                yield UNKNOWN, 0.0
            else:
                best = int(total.argmax())
                yield self.languages[best], min(1.0, 1.0 / float(np.exp(np.minimum(total - total[best], 0)).sum()))


def fit(docs: DataFrame, text: str, lang: str, *, rows: int = TRAIN_ROWS, key: str = "doc_id") -> Model:
    """Count a model on ``docs``, all of which must be rows to learn from.

    ``rows`` bounds the sample. The words are counted by Spark; the driver gets every (word,
    language) pair of it, whose n-grams make the backoff.
    """
    words = F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"(\p{L}+)"), F.lit(1))
    counts = (
        sampled(docs.where(F.col(lang).isNotNull()), key, rows)
        .select(F.col(lang).cast("string").alias("lang"), F.explode(words).alias("word"))
        .groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    )
    return Model(counts.toArrow())


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(model.predict(t.as_py() for t in b.column("__text")))
            rest = [c for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in rest], pa.array([x for x, _ in found], pa.string()),
                 pa.array([x for _, x in found], pa.float64())],
                names=[*rest, "__lang", "__score"],
            )
        give_back()

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of every row with ``__lang`` and ``__score``.

    The score is the share of the winning language in the likelihoods. A text that is null or has
    no letter, and every text where nothing could be learned, is ``und`` with score 0. Equal
    likelihoods go to the first language by code point. Whole texts are read, row by row.
    """
    rows = docs.select(*[F.col(c) for c in carry or []], F.col(text).cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields
                      if f.name != "__text")
    return rows.mapInArrow(_predict(model), f"{kinds}, __lang string, __score double")


def remainder(key: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(by))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model of the rows not held out; nulls and texts without letters as in :func:`predict`."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = fit(docs.where(~held_out), "text", "lang")
    return predict(docs.withColumn("__held", held_out), model, carry=["doc_id", "__held"]).select(
        "doc_id", F.col("__held").alias("held_out"),
        F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *,
    wanted: Iterable[str] | None = None, least_score: float | None = None,
) -> DataFrame:
    """``docs`` whose text is predicted to be in a language that is wanted, all columns unchanged.

    The prediction decides, not ``lang``, which only serves to learn from: a text with a wrong or
    no label goes by what it is written in. ``wanted`` is every learned language unless given;
    ``least_score`` is the least share of the winning language in the likelihoods, unless given
    any that is above an even guess: a text goes in which no word, n-gram or letter is known.
    Texts that are null or have no letter go. Where no row has a language nothing can be learned,
    and unless languages were asked for every text with a letter stays.
    """
    model = fit(docs, text, lang, key=key)
    if not model.languages and wanted is None:
        return docs.where(text_of(text).rlike(r"\p{L}"))
    whole = docs.withColumn("__text", F.col(text).cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    found = whole.mapInArrow(_predict(model), f"{kinds}, __lang string, __score double")
    keep = F.col("__lang") != UNKNOWN
    if least_score is not None:
        keep &= F.col("__score") >= least_score
    elif len(model.languages) > 1:
        keep &= F.col("__score") > 1 / len(model.languages)
    if wanted is not None:
        keep &= F.col("__lang").isin(*wanted)
    return found.where(keep).select(*[f"`{c}`" for c in docs.columns])
