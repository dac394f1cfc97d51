"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / size times; the whole part is certain, the fraction
is settled by pivotal rounding. Two documents with fractions trade words: the larger mass either
can give or take flows, in a direction drawn so that each keeps its expectation, until one of
them is wanted a whole number of times. The words of a pair don't change, so a source misses its
target by less than one document. Chunks of a source settle their documents independently and
pass one open document each up a reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import addressed, table, text_of
from plotweave.operators.sweeps import prefix_sums
from plotweave.sources.workspace import staged

WEIGHTS, LIMIT, SEED = (1.0, 2.0, 3.0), 3.0, 17
#: Documents that settle in one task's group, and open documents that meet in one node of the tree.
GROUP = 2000
#: A fraction this close to a whole number of copies counts as whole.
WHOLE = 1e-9


def words(text: Column) -> Column:
    r"""Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, limit: float = LIMIT, weights: tuple = WEIGHTS) -> DataFrame:
    """``source``, ``source_size``, ``docs``, ``place``, ``target`` of ``source``, ``size`` rows.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``limit``
    times its source's size and the excess is shared by weight among the others until none is
    above: target = min(limit * size, level * weight), where the level makes the targets add up
    to all sizes. Capped are the sources with the smallest limit * size / weight. Sources may be
    as many as web hosts are: their ranks and running sums go over range slices.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                         (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")).select(
        "*", F.col("source").isNull().alias("none"), F.lit(1).cast("long").alias("one"))
    s = (
        prefix_sums(s, [], ["none", "source"], "one", "place")
        .withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(limit))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    s = prefix_sums(s, [], ["ratio", "place"], {"cap": "caps", "weight": "weighed"})
    every, heavy = s.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = (F.lit(every or 0.0) - (F.col("caps") - F.col("cap"))) / (F.lit(heavy or 0.0) - (F.col("weighed") - F.col("weight")))
    # The level holds for the first source, by ratio, that it leaves below its cap.
    first = s.withColumn("level", level).where("ratio >= level").agg(
        F.min(F.struct("ratio", "place", "level"))["level"]).first()[0]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("weight"))
    return s.select("source", "source_size", "docs", "place", target.alias("target"))


def _uniform(*key: int) -> float:
    return xxhash.xxh64_intdigest(",".join(map(str, key)).encode(), SEED) / 2.0**64


def settle(rows: list[tuple], level: int) -> tuple[list[tuple], tuple | None]:
    """Pivotal rounding of (file, row, hash, size, fraction) in the given order.

    Returns (file, row, copies 0 or 1) of the settled ones, and the one still open.
    """
    done, held = [], None
    for row in rows:
        pair = [row]
        if held is not None and WHOLE < row[4] < 1 - WHOLE:
            (*a, size_a, pa), (*b, size_b, pb) = held, row
            up, down = min((1 - pa) * size_a, pb * size_b), min(pa * size_a, (1 - pb) * size_b)
            give = up if _uniform(a[2], b[2], level) * (up + down) < down else -down
            pair = [(*a, size_a, pa + give / size_a), (*b, size_b, pb - give / size_b)]
            held = None
        for x in pair:
            if WHOLE < x[4] < 1 - WHOLE:
                held = x
            else:
                done.append((x[0], x[1], int(x[4] > 0.5)))
    return done, held


def _round_group(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "hash", "__file", "__row"], ascending=[False, True, True, True])
        rows = list(zip(*(pdf[c].tolist() for c in ("__file", "__row", "hash", "size", "p"))))
        done, held = settle(rows, level)
        source, node = pdf["place"].iloc[0], pdf["node"].iloc[0]
        if held is not None and last:  # nobody is left to trade with
            done, held = [*done, (held[0], held[1], int(held[4] >= 0.5))], None
        out = [(source, node, f, r, 0, 0, 0.0, extra) for f, r, extra in done]
        if held is not None:
            out.append((source, node, *held, -1))
        return pd.DataFrame(out, columns=["place", "node", "__file", "__row", "hash", "size", "p", "extra"])

    return run


KIND = "place long, node long, __file long, __row long, hash long, size long, p double, extra int"


def mix(
    docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", *,
    limit: float = LIMIT, weights: tuple = WEIGHTS, group: int = GROUP,
) -> DataFrame:
    """Per document the copies that the mix takes.

    Returns ``__file``, ``__row``, ``key``, ``size`` (words; null text: 0), ``source_size``,
    ``target`` (its source's), ``copies`` (whole, ``limit`` at most), ``taken`` (copies * size).
    A null source is a source of its own, last in order. Documents without words take nothing and
    need no rounding. Repeated rows are rounded one by one. The draws are hashes of id and
    text: reruns agree. An empty table gives an empty result.
    """
    t = text_of(text)
    sizes = staged(
        addressed(docs).select(
            "__file", "__row", F.col(key).cast("long").alias("id"),
            F.col(source).cast("string").alias("source"), words(t).alias("size"),
            F.xxhash64(F.col(key).cast("long"), t).alias("hash"),
        ),
        "sizes",
    )
    targets = staged(source_targets(sizes, limit, weights), "targets")
    wanted = (
        sizes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                    .otherwise(0.0))
        .withColumn("whole", F.floor(F.col("ratio") + WHOLE))
        .withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
    )
    nodes = targets.agg(F.max(F.ceil(F.col("docs") / group))).first()[0] or 1
    spread, same = wanted.where("size > 0"), F.xxhash64("hash")
    repeated = staged(sizes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
                      .select(F.col("hash").alias("many")), "repeated")
    if not repeated.isEmpty():
        spread = spread.join(repeated, F.col("hash") == F.col("many"), "left")
        same = F.when(F.col("many").isNull(), same).otherwise(F.xxhash64("__file", "__row"))
    open_rows = spread.select("place", F.pmod(same, F.ceil(F.col("docs") / group)).alias("node"),
                              "__file", "__row", "hash", "size", "p")
    settled, level = [], 0
    while True:
        last = nodes <= 1
        step = staged(open_rows.groupBy("place", "node").applyInPandas(_round_group(level, last), KIND),
                      f"level{level}")
        settled.append(step.where("extra >= 0").select("__file", "__row", "extra"))
        if last:
            break
        nodes, level = -(-nodes // group), level + 1
        fold = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(nodes)) if nodes > 1 else F.lit(0)
        open_rows = step.where("extra < 0").select(
            "place", fold.cast("long").alias("node"), "__file", "__row", "hash", "size", "p")
    extras = settled[0]
    for s in settled[1:]:
        extras = extras.unionAll(s)
    return (
        wanted.join(extras, ["__file", "__row"], "left")
        .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0)))
                    .otherwise(F.least(F.round("ratio"), F.floor(F.lit(limit)))).cast("long"))
        .select("__file", "__row", F.col("id").alias(key), "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns unchanged."""
    rows = addressed(docs)
    copies = mix(rows, text, key, source).where("copies > 0").select(
        "__file", "__row", F.col("copies").alias("__copies"))
    return (
        rows.join(copies, ["__file", "__row"])
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
        .select(*[f"`{c}`" for c in docs.columns])
    )


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes; nulls and repeated rows as in :func:`mix`."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets alone, a row a source."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").cast("string").alias("source"), words(text_of("text")).alias("size"))
    return source_targets(docs).select("source", "source_size", "docs", F.round("target", 6).alias("target"))


TARGETS = r"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size,
    count(*) AS docs FROM documents GROUP BY source),
w AS (SELECT *, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3.0 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(CAST(cap AS DOUBLE)) OVER b, 0))
    / sum(CAST(weight AS DOUBLE)) OVER a AS level FROM r
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT source, source_size, docs, round(least(CAST(cap AS DOUBLE),
    coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio >= level) * CAST(weight AS DOUBLE), CAST(cap AS DOUBLE))), 6) AS target
FROM l
"""
