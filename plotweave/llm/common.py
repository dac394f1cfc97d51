"""What the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.sources.workspace import staged

#: The white space of the contracts: space and the ASCII controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def give_back() -> None:
    """Return a worker's freed memory to the system at the end of a task; the worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def without_space(text: Column) -> Column:
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _plain_scan(df: DataFrame) -> bool:
    """Whether the frame is files with projections and filters only, so that a row of it is one
    row of one file."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation", "Relation"):
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def addressed(df: DataFrame) -> DataFrame:
    """Add ``__file`` and ``__row``, which name a row of the stored table and hold in any rerun.

    They come from the Parquet reader (a hash of the file's path, the row's index in it). A frame
    that isn't a scan of files is written to the shared folder first; one that has addresses
    stays as it is. The two names are reserved.
    """
    if {"__file", "__row"} <= set(df.columns):
        return df

    def at(x: DataFrame) -> DataFrame:
        meta = x.metadataColumn("_metadata")
        return x.withColumns({"__file": F.xxhash64(meta["file_path"]), "__row": meta["row_index"]})

    if _plain_scan(df):
        try:
            return at(df)
        except AnalysisException:  # files of another kind
            pass
    return at(staged(df, "rows"))
