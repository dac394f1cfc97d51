"""Exact deduplication with disk-backed streaming state (DataFrame functions only).

A narrow ledger (row address, identifier, code points, SHA-256 of the normalised text) is written
in one scan of the texts. A Structured Streaming query folds the ledger into keyed state held in
RocksDB: per digest the best row's size, stable identifier and content locator, and the number of
rows. The state never expires. It is then read as a table from the query's checkpoint. Digests
that were hit more than once have their full normalised bytes compared; rows under one digest
whose bytes differ become classes of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import addressed, table, text_of, without_space
from plotweave.sources.workspace import local_options, new_path, staged, write

#: Bits of the bitmap of hit rows for each of them, the fewest that are worth it, and the logarithm
#: of the most bits that are broadcast (16 MB); with more hits, texts are matched by an equi-join.
BITS_A_HIT, LEAST_BITS, BITMAP_BITS = 64, 16, 27
#: The state lives in RocksDB; its files are not preallocated (there is one small store per
#: partition) and a batch writes its changes rather than a copy of the store.
_STORE = "spark.sql.streaming.stateStore"
STATE_CONF = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}
#: On a local file system the default writer of checkpoint files starts a ``chmod`` process a file.
LOCAL_CONF = {"spark.sql.streaming.checkpointFileManagerClass":
              "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


def _rank() -> Column:
    """Larger is better: most code points, smallest id (null last), then the row's address."""
    return F.struct("n", F.expr("~id").alias("inv"), F.expr("~__file").alias("f"),
                    F.expr("~__row").alias("r"))


def keyed_state(spark: SparkSession, ledger: DataFrame, path: str, max_bytes: int) -> DataFrame:
    """Fold the ledger's files into keyed state, micro-batch by micro-batch; the state as a table.

    Micro-batches take ``max_bytes`` of ledger each, and a query that is lost resumes from its
    checkpoint. Partial aggregation before the shuffle leaves one row per digest and task, so a
    digest that holds a third of all rows doesn't burden the task that keeps it. The settings of
    the state are those of a session of its own.
    """
    checkpoint, out = new_path(spark, "state"), new_path(spark, "digests")
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in (STATE_CONF | (LOCAL_CONF | local if (local := local_options(checkpoint)) else {})).items():
        own.conf.set(k, v)
    query = (
        own.readStream.schema(ledger.schema).option("maxBytesPerTrigger", max_bytes)
        .parquet(path)
        .groupBy("digest").agg(F.max(_rank()).alias("best"), F.count(F.lit(1)).alias("size"))
        .writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    kept = own.read.format("statestore").load(checkpoint)
    value = F.col("value")  # its fields have the names of the aggregates' buffers
    write(kept.select(F.col("key")["digest"].alias("digest"), value["max"].alias("best"),
                      value["count"].alias("size")), out)
    return spark.read.parquet(out)


def exact_dedup(
    docs: DataFrame, text: str = "text", key: str = "doc_id", *, digest_bytes: int = 32,
    max_bytes: int = 64 << 30,
) -> DataFrame:
    """One row per document: which row of its class of equal texts stays.

    Texts are equal when their bytes are, after deletion of every ASCII white-space character;
    null is the empty text, and all empty texts form one class. The row with the most code points
    in the original text stays, then the smallest id (a null id comes last), then the first by
    address, so that of rows repeated in every column exactly one stays. Returns ``__file``,
    ``__row``, ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. An empty table
    gives an empty result; other columns are neither read nor returned.

    ``digest_bytes`` shortens the state's key (tests force collisions by it); the comparison of
    full bytes makes the result the same for any value.
    """
    spark = docs.sparkSession
    texts = addressed(docs).select(
        "__file", "__row", F.col(key).cast("long").alias("id"), text_of(text).alias("t")
    )
    digest = F.substring(F.col("sha"), 1, digest_bytes)

    def digested(rows: DataFrame) -> DataFrame:
        rows = rows.select("__file", "__row", "id", F.char_length("t").cast("long").alias("n"),
                           without_space(F.col("t")).alias("norm"))
        return rows.withColumn("sha", F.unhex(F.sha2(F.col("norm"), 256))).withColumn("digest", digest)

    path = new_path(spark, "ledger")
    write(digested(texts).select("__file", "__row", "id", "n", "sha", "digest"), path)
    ledger = spark.read.parquet(path)
    state = keyed_state(spark, ledger, path, max_bytes)

    # Full bytes of the hits. A bitmap of their addresses that grows with them, within its bound,
    # keeps all other texts from being normalised again and out of the shuffle; a false positive
    # is a class of one row.
    hit = state.where("size > 1")
    n = hit.agg(F.sum("size")).first()[0] or 0
    bits = min(BITMAP_BITS, max(10, (BITS_A_HIT * n).bit_length()))
    if LEAST_BITS * n <= 1 << bits:
        place = F.shiftrightunsigned(F.xxhash64("__file", "__row"), 64 - bits)
        one = F.expr("shiftleft(1L, cast(place & 63 as int))")
        words = (
            ledger.join(hit.select("digest"), "digest", "left_semi").withColumn("place", place)
            .select(F.shiftright("place", 6).alias("word"), one.alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits"))
        )
        content = digested(
            texts.withColumn("place", place).withColumn("word", F.shiftright("place", 6))
            .join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(one) != 0)
        )
    else:
        content = digested(texts).join(hit.select("digest"), "digest", "left_semi")
    classes = content.groupBy("digest", "norm").agg(
        F.max(_rank()).alias("best"), F.count(F.lit(1)).alias("size")
    )
    split = staged(
        classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
        .select("digest"),
        "collisions",
    )
    best, size = F.col("best"), F.col("size")
    out = ledger.join(state, "digest")
    if not split.isEmpty():  # different bytes under one digest: their classes replace the digest's
        exact = (
            content.join(split, "digest", "left_semi").select("__file", "__row", "digest", "norm")
            .join(classes.select("digest", "norm", F.col("best").alias("b"),
                                 F.col("size").alias("s")), ["digest", "norm"])
            .select("__file", "__row", "b", "s")
        )
        out = out.join(exact, ["__file", "__row"], "left")
        best, size = F.coalesce("b", "best"), F.coalesce("s", "size")
    return out.withColumns({"best": best, "size": size}).select(
        "__file", "__row", F.col("id").alias(key), F.expr("~best.inv").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.expr("__file = ~best.f and __row = ~best.r").alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of every class of equal texts, all its columns unchanged."""
    rows = addressed(docs)
    gone = exact_dedup(rows, text, key).where("not kept").select("__file", "__row")
    return rows.join(gone, ["__file", "__row"], "left_anti").select(
        *[f"`{c}`" for c in docs.columns]
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its class that stays; nulls, ties and repeated rows as in :func:`exact_dedup`."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("__file", "__row")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
