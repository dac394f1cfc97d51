"""Sharding along a Hilbert curve over several metadata dimensions (DataFrame functions only).

Each dimension is quantised into cells of about equal numbers of rows, the cells' coordinates
become an index on the Hilbert curve, and the sorted rows are cut into runs. Neighbours on the
curve are neighbours in every dimension, so a shard covers a narrow range of each and readers can
skip files by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotweave.llm.common import addressed, table, text_of
from plotweave.operators.ranks import ranked
from plotweave.operators.sweeps import prefix_sums
from plotweave.sources.workspace import staged

SHARDS, BITS = 8, 5


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell with ``bits``-bit coordinates.

    The published transposition algorithm (Skilling, 2004) as a fold over (bit, dimension) steps.
    """
    n = len(coordinates)
    if n * bits > 62:
        raise ValueError("the index must fit into a long")
    x = F.array(*[c.cast("long") for c in coordinates])
    high_bits = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i"))
                      for q in high_bits for i in range(n)])

    def step(acc: Column, s: Column) -> Column:
        own, low = F.get(acc, s["i"]), s["q"] - 1
        swap = F.get(acc, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        hit = own.bitwiseAND(s["q"]) != 0
        none = F.lit(0).cast("long")
        return F.transform(acc, lambda v, j: v.bitwiseXOR(
            F.when(hit, F.when(j == 0, low).otherwise(none))
            .when((j == 0) | (j == s["i"]), swap).otherwise(none)))

    def last(acc: Column) -> Column:
        gray = F.transform(acc, lambda v, j: F.aggregate(
            F.slice(acc, F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))
        turn = F.aggregate(
            F.array(*[F.lit(q).cast("long") for q in high_bits] or [F.lit(1).cast("long")]), F.lit(0).cast("long"),
            lambda t, q: F.when(F.get(gray, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        out = F.lit(0).cast("long")
        places = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("b"), F.lit(i).alias("i"))
                           for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(places, out, lambda a, p: a * 2 + F.get(gray, p["i"]).bitwiseXOR(turn)
                           .bitwiseAND(p["b"]).cast("boolean").cast("long"))

    return F.aggregate(steps, x, step, last) if bits > 1 else last(x)


def _running(df: DataFrame, column: str, n_name: str = "upto") -> DataFrame:
    """``value``, ``n``, ``upto``: the column's values in order, null first, with their rows so far."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(n, [], ["value"], "n", n_name)


def text_cells(df: DataFrame, column: str, bits: int) -> DataFrame:
    """``value``, ``cell`` of a text column: its values in order, cut by their shares of the rows."""
    middle = F.col("upto") - F.col("n") / 2
    return _running(df, column).select("value", F.floor(middle * (1 << bits) / max(1, df.count())).alias("cell"))


def number_cell(df: DataFrame, column: str, bits: int) -> Column:
    """The cell of a number among exact quantiles, of which there are 2^bits - 1; null is in the first.

    A quantile is the least value that its share of the rows isn't above; it ends its cell.
    """
    rows, cells = df.where(F.col(column).isNotNull()), 1 << bits
    n = max(1, rows.count())
    share = lambda c: F.floor(c * cells / n)  # noqa: E731  quantiles reached by a number of rows
    cuts = _running(rows, column).where(
        (share(F.col("upto")) > share(F.col("upto") - F.col("n"))) & (F.col("upto") < n)).select("value").collect()
    cell = F.lit(0)
    for r in cuts:  # fewer than there are cells
        cell = cell + F.when(F.col(column) > r["value"], 1).otherwise(0)
    return cell


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, *, text: str = "text", key: str = "doc_id",
    by_text: tuple = ("lang", "source"), bits: int = BITS,
) -> DataFrame:
    """Per document its place on the curve, its shard and its slot there.

    The dimensions are the text columns ``by_text`` and the size (UTF-8 bytes plus 1; a null text
    has none). Shards are runs of the sorted rows and their counts differ by one at most. Rows of
    one cell are ordered by a hash and then by text checksum and id, so that a cell of any size
    is ranked by many tasks and reruns agree; repeated rows are dealt one by one. Nulls sort
    first in their dimension; an empty table gives an empty result. Returns ``__file``,
    ``__row``, ``key``, ``size``, ``text_crc32``, ``curve``, ``shard``, ``slot``.
    """
    t = text_of(text)
    rows = staged(
        addressed(docs).select(
            "__file", "__row", F.col(key).cast("long").alias("id"),
            (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("crc"),
            *[F.col(c).cast("string").alias(f"d{i}") for i, c in enumerate(by_text)]),
        "metadata")
    placed = rows
    for i in range(len(by_text)):
        cells = text_cells(rows, f"d{i}", bits).select(F.col("value").alias(f"v{i}"), F.col("cell").alias(f"c{i}"))
        placed = placed.join(cells, F.col(f"d{i}").eqNullSafe(F.col(f"v{i}")))
    axes = [f"c{i}" for i in range(len(by_text) + 1)]
    placed = staged(placed.withColumn(axes[-1], number_cell(rows, "size", bits).cast("long"))
                    .select("__file", "__row", "id", "size", "crc", *axes), "cells")
    # The curve is folded once a cell, of which there are at most 2^(bits * dimensions); as a table,
    # so that no filter on it is pushed to the rows.
    curve = staged(placed.select(*axes).distinct(), "used").withColumn("curve", hilbert_index([F.col(c) for c in axes], bits))
    curve = staged(curve, "curve")
    placed = placed.join(F.broadcast(curve), axes).drop(*axes)
    order = Window.partitionBy(F.lit(0)).orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("curve").agg(F.count(F.lit(1)).alias("n")).select(
        "curve", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    # At most 2^(bits * dimensions) runs, whatever the corpus.
    return (
        ranked(placed, ["curve"], ["crc", "id", "size"], groups_bounded=True)
        .join(F.broadcast(runs), "curve")
        .withColumn("place", F.col("start") + F.col("rank")).withColumn("shard", F.expr(f"place * {shards} div all").cast("int"))
        .withColumn("slot", F.col("place") - F.expr(f"(shard * all + {shards - 1}) div {shards}"))
        .select("__file", "__row", F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"),
                "curve", "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> str:
    """Write ``docs`` as one folder per shard, rows in the order of the curve.

    Returns the name of the folders' column: ``shard``, with underscores where ``docs`` has one.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    addresses = addressed(docs)
    places = assign_shards(addresses, shards, **options).select(
        "__file", "__row", F.col("shard").alias(name), F.col("slot").alias("__slot"))
    rows = addresses.join(places, ["__file", "__row"]).drop("__file", "__row")
    (rows.repartitionByRange(name, "__slot").sortWithinPartitions(name, "__slot").drop("__slot")
     .write.partitionBy(name).parquet(path))
    return name


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of rows; nulls and repeated rows as in :func:`assign_shards`."""
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law of rows says: rows and slots by shard."""
    return op9_hilbert_shards(spark, sf_dir).groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first"),
        F.max("slot").alias("last"), F.sum("size").alias("sizes")).agg(
        F.sum("rows").alias("rows"), F.sum("slots").alias("slots"), F.max("first").alias("first"),
        F.sum(F.col("last") + 1).alias("lasts"), (F.max("rows") - F.min("rows") <= 1).alias("even"),
        F.sum("sizes").alias("sizes"))


COUNTS = """
SELECT count(*) AS rows, count(*) AS slots, CAST(0 AS BIGINT) AS first, count(*) AS lasts, true AS even,
    CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS sizes
FROM documents
"""
