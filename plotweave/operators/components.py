"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.operators.kernels import labels
from plotweave.sources.workspace import discard, staged

#: Nodes that a task holds at once; beyond it, it passes on what it has and starts anew.
HELD = 2_000_000


def _contract(by: list[str], held: int):
    """Stars instead of edges: every node met by a task with the lowest node it leads to there."""
    def fold(star: tuple[np.ndarray, np.ndarray], src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate([star[0], src]), np.concatenate([star[1], dst])
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        return nodes, nodes[labels(len(nodes), place[:len(a)], place[len(a):])]

    def batch(stars: dict) -> pa.RecordBatch:
        names = [np.full(len(nodes), g, object) for g, (nodes, _) in stars.items()] if by else []
        columns = [pa.array(np.concatenate(names), pa.string())] if names else []
        for i in (0, 1):
            columns.append(pa.array(np.concatenate([s[i] for s in stars.values()]), pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names=[*by, "node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars: dict = {}
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            src, dst = (b.column(c).to_numpy().astype(np.int64) for c in ("a", "b"))
            if by:
                names = b.column(by[0]).dictionary_encode()
                at = names.indices.to_numpy()
                groups = {g: at == i for i, g in enumerate(names.dictionary.to_pylist())}
            else:
                groups = {"": np.ones(len(src), bool)}
            for g, own in groups.items():
                if own.any():
                    stars[g] = fold(stars.get(g, empty), src[own], dst[own])
            if sum(len(nodes) for nodes, _ in stars.values()) > held:
                yield batch(stars)
                stars = {}
        if stars:
            yield batch(stars)

    return run


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", by: str | None = None,
                         max_rounds: int = 60, held: int = HELD) -> DataFrame:
    """Label every node that occurs in ``edges`` with the smallest node of its component.

    Nodes are whole numbers, of one graph or of one for each value of ``by`` (a string). Edges are
    range-partitioned by their lower ends, and every task first turns its own into stars, so what
    is left to connect are the stars that share a node. Those go through rounds of minimum-label
    hooking followed by pointer jumping: a star takes the smallest label among its neighbours, the
    root it belonged to is hooked onto that label as well, and every label is replaced by its
    label's label. Each round is written to the shared folder and roughly halves the depth of the
    label forest. Self-loops declare isolated nodes; null endpoints are ignored; repeated edges
    change nothing; an empty table gives an empty result. Returns ``by``, ``node``, ``component``.
    """
    keys = [by] if by else []
    e = edges.select(*[F.col(c).cast("string").alias(c) for c in keys], F.col(src).cast("long").alias("__a"),
                     F.col(dst).cast("long").alias("__b")).where("__a is not null and __b is not null")
    e = e.select(*keys, F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))
    kind = "".join(f"`{c}` string, " for c in keys) + "node long, root long"
    stars = e.repartitionByRange(*keys, "a", "b").mapInArrow(_contract(keys, held), kind)
    nodes = staged(stars.groupBy(*keys, "node").agg(F.collect_set("root").alias("roots")).withColumn(
        "first", F.array_min("roots")), "nodes")  # as many roots as tasks that met the node, at most
    core = nodes.where(F.size("roots") > 1).select(*keys, F.col("first").alias("a"), F.explode("roots").alias("b")).distinct()
    found = _hook(core, keys, max_rounds)
    return nodes.join(found.withColumnRenamed("node", "first"), [*keys, "first"], "left").select(
        *keys, "node", F.coalesce("component", "first").alias("component"))


def _hook(edges: DataFrame, keys: list[str], max_rounds: int) -> DataFrame:
    """Components of edges ``a``, ``b`` by rounds."""
    e = staged(edges.unionAll(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = staged(e.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(
        *keys, F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = (
            e.join(now.select(*keys, F.col("node").alias("b"), "label"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("low"))
        )
        seen = now.join(near, [*keys, "node"]).select(*keys, "node", "label", F.least("label", "low").alias("low"))
        hooks = seen.groupBy(*keys, "label").agg(F.min("low").alias("hook"))
        moved = staged(seen.join(hooks, [*keys, "label"], "left").select(
            *keys, "node", F.col("label").alias("old"), F.least("low", F.coalesce("hook", "low")).alias("label")), "hooked")
        up = moved.select(*keys, F.col("node").alias("label"), F.col("label").alias("jump"))
        best = F.least("label", F.coalesce("jump", "label"))
        after = staged(moved.join(up, [*keys, "label"], "left").select(
            *keys, "node", best.alias("label"), (best != F.col("old")).alias("changed")), "labels")
        discard(moved, now)  # earlier rounds are not read again
        now = after
        if after.where("changed").isEmpty():
            discard(e)
            return now.select(*keys, "node", F.col("label").alias("component"))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
