"""Document fingerprints by consistent weighted sampling.

Terms are word shingles, weights their counts. For every sample k, a term x with weight w draws
r, c from Gamma(2, 1) and b from the uniform distribution, all functions of (x, k) only, and

    t = floor(log(w) / r + b),  y = exp(r (t - b)),  a = c / (y exp(r));

the sample is the (x, t) with the smallest a. Two documents have equal samples with a probability
equal to their generalised Jaccard similarity, sum of smaller over sum of larger weights.

The draws are made of three exponential ones, A, B and C, each from a hash of (x, k) of its own:
c = A + B, r = log(c / A) + C, b = C / r. These have the laws above, and a for weight 1 is A
itself, so among terms of weight 1 the smallest hash wins. For weight w, a is A exp(-C) / w at
least, so only terms whose bound is below the smallest a known are drawn in full.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import addressed, table, text_of

SAMPLES, SHINGLE, SEED = 256, 5, 11
#: Terms weighed at once: of weight 1, and of others.
CHUNK, HEAVY_CHUNK = 4096, 1024
#: Texts that a task should get, in bytes, when documents are dealt by id, and the most ranges
#: that ids are dealt into; beyond it tasks stream longer ranges.
TASK_BYTES, MAX_RANGES = 32 << 20, 50_000
#: Words whose hashes a worker remembers, and the bytes of the longest of them; beyond the number
#: the memory starts anew.
REMEMBERED, LONGEST = 1 << 17, 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h.astype(np.float64) + 0.5) / (1 << 32)


def _exponential(h: np.ndarray) -> np.ndarray:
    """Exponential draws that ascend with their 32-bit hashes."""
    return -np.log1p(-_uniform(h))


class _Hashes(dict):
    """Hashes of words by their UTF-8."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


class Sampler:
    """Signatures of texts: one 16-bit sample for each of ``samples`` draws."""

    def __init__(self, samples: int = SAMPLES, shingle: int = SHINGLE):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.samples, self.shingle, self.known = samples, shingle, _Hashes()
        odd = lambda: (rng.integers(0, 1 << 32, samples, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.jump, self.turn = odd(), odd()
        self.salt = rng.integers(0, 1 << 64, samples, dtype=np.uint64)

    def _draw(self, k: np.ndarray, term: np.ndarray, w: np.ndarray, first: np.ndarray, third: np.ndarray):
        """a and t of terms with weights above 1, from their hashes for A and C."""
        second = _mix(_mix(term + self.salt[k]))
        e_b = -np.log(((second >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
        e_a, e_c = _exponential(first), -np.log(_uniform(third))
        c = e_a + e_b
        r = np.log(c / e_a) + e_c
        b = e_c / r
        t = np.floor(np.log(w) / r + b)
        return c * np.exp(-r * (t - b) - r), t.astype(np.int64)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes in ascending order, and their counts."""
        words = text.encode("utf-8", "surrogatepass").split()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h, np.zeros(0, np.int64)
        n = min(self.shingle, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = _mix(out + h[i:i + len(out)])
        return np.unique(out, return_counts=True)

    def signature(self, text: str) -> np.ndarray:
        """16-bit samples; all zero for a text without words."""
        terms, counts = self.terms(text)
        if not len(terms):
            return np.zeros(self.samples, np.uint16)
        low = np.full(self.samples, np.inf)
        term = np.zeros(self.samples, np.uint64)
        level = np.zeros(self.samples, np.int64)
        rows = np.arange(self.samples)
        single = counts == 1
        light = terms if single.all() else terms[single]
        for i in range(0, len(light), CHUNK):
            part = light[i:i + CHUNK]
            place = self._place(part)
            best = place.argmin(axis=1)
            smallest, x = _exponential(place[rows, best]), part[best]
            less = (smallest < low) | ((smallest == low) & (x < term))
            low, term = np.where(less, smallest, low), np.where(less, x, term)
        heavy, weights = (terms[~single], counts[~single].astype(np.float64)) if len(light) < len(terms) else (terms[:0], counts[:0])
        for i in range(0, len(heavy), HEAVY_CHUNK):
            part, w = heavy[i:i + HEAVY_CHUNK], weights[i:i + HEAVY_CHUNK]
            first = self._place(part)
            third = self.turn[:, None] * part.astype(np.uint32)[None, :]
            # A above its hash's share and a not above A: what is left can have the smallest a.
            bound = (first >> np.uint32(16)) * (third >> np.uint32(16))
            limit = np.minimum(low, _exponential(first.min(axis=1))) * (1 << 32) * (1 + 1e-9)
            k, j = np.nonzero(bound <= limit[:, None] * w[None, :])
            a = np.full(first.shape, np.inf)
            t = np.zeros(first.shape, np.int64)
            a[k, j], t[k, j] = self._draw(k, part[j], w[j], first[k, j], third[k, j])
            best = a.argmin(axis=1)
            smallest, x = a[rows, best], part[best]
            less = (smallest < low) | ((smallest == low) & (x < term))
            low = np.where(less, smallest, low)
            term, level = np.where(less, x, term), np.where(less, t[rows, best], level)
        return (_mix(term + level.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(48)).astype(np.uint16)

    def _place(self, terms: np.ndarray) -> np.ndarray:
        """Hashes for A, a row for each k: the high bits of a term times an odd number of k's own."""
        return self.jump[:, None] * (terms >> np.uint64(32)).astype(np.uint32)[None, :]


_SAMPLERS: dict[int, Sampler] = {}


def sampler_of(samples: int) -> Sampler:
    """The worker's sampler, kept from task to task."""
    return _SAMPLERS.get(samples) or _SAMPLERS.setdefault(samples, Sampler(samples))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first characters of ``following``."""
    part = len(text) // 3
    return text[:len(text) - part] + following[:part]


def _pairs(samples: int):
    """Rows in order, each with the row after it; a row that isn't ``own`` only follows another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        sampler, held = sampler_of(samples), None
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            rows = []
            for part, i, text, own in zip(*(b.column(c).to_pylist() for c in ("part", "id", "t", "own"))):
                sign = None
                if held is not None and held[0] == part:
                    _, before, old, old_sign, _ = held
                    sign = old_sign if text == old else sampler.signature(text)
                    new = edited(old, text)
                    new_sign = old_sign if new == old else sign if new == text else sampler.signature(new)
                    rows.append((before, len(old), hashlib.sha256(new.encode()).hexdigest(),
                                 old_sign.astype(">u2").tobytes().hex(), new_sign.astype(">u2").tobytes().hex(),
                                 likeness(old_sign, new_sign), likeness(old_sign, sign)))
                held = (part, i, text, sampler.signature(text) if sign is None else sign, own) if own else None
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return run


#: What rows are ordered by: a null id below all others, then the id, then a hash of the row.
KEY = "struct<has:boolean,id:bigint,h:bigint>"


def _not_above(cuts: list[tuple[bool, int, int]], value: Column) -> Column:
    """How many of the ascending cuts are not above the value, by binary search."""
    if not cuts:
        return F.lit(0)
    text = json.dumps([{"has": has, "id": i, "h": h} for has, i, h in cuts])
    array = F.from_json(F.lit(text), f"array<{KEY}>")  # folded into one literal
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        under = (s["low"] < s["high"]) & (F.get(array, middle) <= value)
        return F.struct(F.when(under, middle + 1).otherwise(s["low"]).alias("low"),
                        F.when(under, s["high"]).otherwise(F.least(s["high"], middle)).alias("high"))

    steps = F.array(*[F.lit(i) for i in range(len(cuts).bit_length() + 1)])
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def _cuts(quantiles: list[int], nulls: int, parts: int) -> list[tuple[bool, int, int]]:
    """Ascending cuts of keys. An id that is several quantiles has many rows, and so may null:
    their rows are cut by hash into as many ranges."""
    def of(has: bool, i: int, n: int) -> list[tuple[bool, int, int]]:
        return [(has, i, -(1 << 63) + (j << 64) // n) for j in range(n)]

    out = of(False, 0, nulls)[1:] if nulls > 1 else []
    for i, n in sorted(Counter(quantiles).items()):
        out += of(True, i, n)
    return out


def _sign(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_of(samples)
        for b in batches:
            prints = [sampler.signature(t).astype(">u2").tobytes().hex() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(prints, pa.string())], names=["id", "fingerprint"])

    return run


def document_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", *, samples: int = SAMPLES) -> DataFrame:
    """``key`` and ``fingerprint`` (four hex digits a sample) of every row, without a shuffle.

    The share of equal samples of two fingerprints estimates the generalised Jaccard similarity
    of their five-word shingle counts. Null counts as empty; texts without words have a
    fingerprint of zeros; shorter texts are one shingle; whole texts are read, in chunks.
    """
    return (docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t"))
            .mapInArrow(_sign(samples), "id long, fingerprint string").withColumnRenamed("id", key))


def compare_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", *, samples: int = SAMPLES,
                      task_bytes: int = TASK_BYTES, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Every row with its edited text's fingerprint and the likeness to it and to the next row.

    The next row is the one after it by descending id, null ids last, after the last the first; a
    single row is its own next. Rows of one id come in an order of their own, by a hash of their
    places in the stored table, so that an id with any share of the rows is cut like the rest.
    Rows are dealt to tasks by ranges of about ``task_bytes`` (at most ``max_ranges`` of them, which
    only makes ranges longer), and each range also gets a copy of the first row of the range after
    it, so that texts are shuffled once and no task sees more than its range.
    """
    rows = addressed(docs).select(
        F.struct(F.col(key).isNotNull().alias("has"), F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("id"),
                 F.xxhash64("__file", "__row").alias("h")).alias("key"), text_of(text).alias("t"))
    ids = rows.select(F.when(F.col("key.has"), F.col("key.id")).alias("id"), F.octet_length("t").alias("size"))
    total, n, known = ids.agg(F.sum("size"), F.count(F.lit(1)), F.count("id")).first()
    parts = min(int((total or 0) // task_bytes) + 1, max_ranges)
    shares = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("id", shares, 100 * parts)).first()[0] if shares and known else None
    cuts = _cuts(found or [], -(-(n - known) * parts // max(n, 1)), parts)
    # Ranges in descending order of keys.
    placed = rows.withColumn("part", (len(cuts) - _not_above(cuts, F.col("key"))).cast("int"))
    # The first row of each range: a row for each range.
    firsts = (
        placed.groupBy("part").agg(F.max("key").alias("top"))
        .withColumn("before", F.lag("part").over(Window.partitionBy(F.lit(0)).orderBy("part")))
        .withColumn("before", F.coalesce("before", F.max("part").over(Window.partitionBy(F.lit(0)))))
    )
    heads = placed.join(
        F.broadcast(firsts.select(F.col("part").alias("p"), "top", "before")),
        (F.col("part") == F.col("p")) & (F.col("key") == F.col("top")),
    ).groupBy("before").agg(F.first("key").alias("key"), F.min("t").alias("t")).select(
        F.col("before").alias("part"), "key", "t", F.lit(False).alias("own"))
    order = [F.col("part"), F.col("own").desc(), F.col("key").desc(), F.col("t")]
    return (
        placed.select("part", "key", "t", F.lit(True).alias("own")).unionByName(heads.select("part", "key", "t", "own"))
        .repartitionById(len(cuts) + 1, "part").sortWithinPartitions(*order)
        .select("part", F.when(F.col("key.has"), F.col("key.id")).alias("id"), "t", "own")
        .mapInArrow(_pairs(samples), "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")
        .withColumnRenamed("id", key)
    )


def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside its edited text and the next one; nulls and repeated ids as in :func:`compare_with_next`."""
    return compare_with_next(table(spark, sf_dir, "documents"))
