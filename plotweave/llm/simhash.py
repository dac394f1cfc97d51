"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are dealt by the leading bits of each of ``radius + 1`` blocks: two
fingerprints that differ in at most ``radius`` bits agree in one whole block, so every link has a
bucket that holds both ends. Buckets are sorted by population count and cut into tiles; numpy
compares tile pairs by exclusive-or and bit counts, and pairs whose population counts are further
apart than the radius are skipped. A tile pair reports a spanning forest of its links, which has
the same components as all of them and no more rows than the tiles have fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import addressed, table
from plotweave.operators.components import connected_components
from plotweave.sources.workspace import staged

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Fingerprints in a tile, and hashes whose bits are counted at once.
TILE, CHUNK = 4096, 1 << 16


def shingle_hashes(text: str | None, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; A-Z are lower-cased before."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1:])], np.uint64
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at:at + CHUNK].astype("<u8"))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [fingerprint(shingle_hashes(t)) for t in b.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("__file"), b.column("__row"), b.column("id"), pa.array(fp, pa.int64())],
            names=["__file", "__row", "id", "fp"],
        )


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``__file``, ``__row``, ``id``, ``fp`` (the 64 bits as a signed long) of every row.

    Null and empty texts and texts of white space have the fingerprint zero; fewer than three
    words make one shingle of all of them.
    """
    return (
        addressed(docs)
        .select("__file", "__row", F.col(key).cast("long").alias("id"),
                F.col(text).cast("string").alias("t"))
        .mapInArrow(_fingerprint_batches, "__file long, __row long, id long, fp long")
    )


def _cut_tiles(tile: int):
    """Cut the sorted rows of a partition into tiles that stay inside one bucket."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def tiles(rows: np.ndarray, last: bool) -> tuple[list[tuple], np.ndarray]:
            edges = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            ends = [*edges.tolist(), len(rows)]
            out, start = [], 0
            for end in ends:
                while end - start >= tile or (start < end and (last or end != len(rows))):
                    stop = min(end, start + tile)
                    part = rows[start:stop]
                    out.append((int(part[0, 0]), int(part[0, 1]), int(part[0, 2]),
                                int(part[-1, 2]), int(part[0, 3]),
                                part[:, 3].astype("<i8").tobytes()))
                    start = stop
            return out, rows[start:]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = zip(*rows) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                names=["block", "bucket", "low", "high", "first", "fps"],
            )

        for b in batches:
            held.append(np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)]))
            if sum(map(len, held)) >= 8 * tile:
                out, rest = tiles(np.concatenate(held), False)
                held = [rest]
                yield batch(out)
        if held:
            out, _ = tiles(np.concatenate(held), True)
            yield batch(out)

    return cut


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles (or within one): (fingerprint, root)."""
    both = a if same else np.concatenate([a, b])
    root = np.arange(len(both))
    shift = 0 if same else len(a)
    high = max(1, (1 << 20) // max(1, len(b)))
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    for at in range(0, len(a), high):
        near = np.bitwise_count(ua[at:at + high, None] ^ ub[None, :]) <= radius
        for i in np.flatnonzero(near.sum(axis=1) > same):
            known = np.unique(np.append(root[np.flatnonzero(near[i]) + shift], root[at + i]))
            if len(known) > 1:
                root[np.isin(root, known)] = known[0]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return list(zip(both[moved].tolist(), both[root[moved]].tolist()))


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for a, b, same in zip(batch.column("fps").to_pylist(), batch.column("other").to_pylist(),
                                  batch.column("same").to_pylist()):
                for x, y in tile_links(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), radius, same):
                    src.append(x)
                    dst.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())],
                                             names=["src", "dst"])

    return compare


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (``src``, ``dst``) whose components are those of all pairs within ``radius`` bits.

    ``distinct`` has one row per fingerprint (``fp``). The number of leading bits that name a
    bucket follows the number of fingerprints, so that a bucket holds about one tile; with every
    number of bits the result is exact. A bucket of any size is cut into tiles.
    """
    spark = distinct.sparkSession
    n, wide = distinct.count(), 64 // (radius + 1)
    bits = min(wide, max(0, (max(1, n // tile) - 1).bit_length()))
    blocks = range(radius + 1) if bits else range(1)
    mask = (1 << bits) - 1
    keyed = distinct.select(
        "fp", F.bit_count("fp").alias("pc"),
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("block"),
                     F.expr(f"cast(shiftrightunsigned(fp, {wide * (k + 1) - bits}) & {mask}L as int)"
                            if bits else "0").alias("bucket"))
            for k in blocks
        ])).alias("k"),
    ).select("k.block", "k.bucket", F.col("pc").cast("int").alias("pc"), "fp")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                len(blocks) * n // (64 * tile) + 1)
    order = ["block", "bucket", "pc", "fp"]
    tiles = staged(
        keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(_cut_tiles(tile), "block int, bucket int, low int, high int, first long, fps binary"),
        "tiles",
    )
    # Pairs of tiles are found by what the tiles span and dealt one by one, so that a bucket of
    # any number of tiles is compared by many tasks.
    inner = tiles.select("fps", F.col("fps").alias("other"), F.lit(True).alias("same"))
    spans = tiles.select("block", "bucket", "low", "high", "first")
    others = spans.select("block", "bucket", F.col("low").alias("low2"), F.col("first").alias("first2"))
    pairs = spans.join(others, ["block", "bucket"]).where(
        ((F.col("low") < F.col("low2")) | ((F.col("low") == F.col("low2")) & (F.col("first") < F.col("first2"))))
        & (F.col("low2") <= F.col("high") + radius)
    ).select("block", "first", "first2")
    outer = (
        staged(pairs, "pairs").join(tiles.select("block", "first", "fps"), ["block", "first"])
        .join(tiles.select("block", F.col("first").alias("first2"), F.col("fps").alias("other")), ["block", "first2"])
        .select("fps", "other", F.lit(False).alias("same"))
    )
    return inner.unionByName(outer).mapInArrow(_compare(radius), "src long, dst long").distinct()


def simhash_groups(
    docs: DataFrame, text: str = "text", key: str = "doc_id", *, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """Per document its fingerprint and the smallest id that links lead to.

    Returns ``__file``, ``__row``, ``key``, ``fp`` (long), ``fingerprint`` (16 hex digits),
    ``component_id`` (null if no document of the component has an id). Documents without words
    share the fingerprint zero and are linked like any other; repeated rows are linked with each
    other; an empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, text, key), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    found = connected_components(links(distinct.select("fp"), radius, tile))
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component")
    )
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = named.join(lows, "component").select("fp", "component", "component_id")
    return prints.join(ids, "fp").select(
        "__file", "__row", F.col("id").alias(key), "fp",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component", "component_id",
    )


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", *, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of every component: the smallest id, then the first by address."""
    rows = addressed(docs)
    groups = staged(simhash_groups(rows, text, key, radius=radius).select(
        "component", "__file", "__row", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"),
                                                 "__file", "__row").alias("place")), "groups")
    first = groups.groupBy("component").agg(F.min("place").alias("stays"))
    gone = groups.join(first, "component").where("place <> stays").select("__file", "__row")
    return rows.join(gone, ["__file", "__row"], "left_anti").select(
        *[f"`{c}`" for c in docs.columns]
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; nulls, empty and repeated texts as in :func:`simhash_groups`."""
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id"
    )
