"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are column expressions. On a bounded sample of labelled rows the driver
grows shallow boosted trees, takes every path from a root as a rule (a conjunction of thresholds),
and fits a logistic model over the rules with a lasso penalty, which leaves few of them. The
remaining rules and weights are compiled into one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import table, text_of
from plotweave.llm.langid import remainder, sampled
from plotweave.sources.workspace import staged

#: Labelled rows to fit on (about), trees, their depth, cuts tried per statistic, lasso penalty.
TRAIN_ROWS, TREES, DEPTH, CUTS, PENALTY = 20_000, 60, 3, 31, 0.002


def statistics(t: Column) -> dict[str, Column]:
    """Statistics of a text; all are numbers for the empty text too."""
    n = F.char_length(t)
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    nw, nl = F.size(words), F.size(lines)

    def share(pattern: str) -> Column:
        return (n - F.char_length(F.regexp_replace(t, pattern, ""))) / F.greatest(n, F.lit(1))

    def of_words(x: Column) -> Column:
        return x / F.greatest(nw, F.lit(1))

    return {
        "log_words": F.log1p(nw.cast("double")),
        "word_length": of_words(F.aggregate(words, F.lit(0), lambda a, w: a + F.char_length(w))),
        "letters": share(r"\p{L}+"),
        "capitals": share(r"\p{Lu}+"),
        "digits": share("[0-9]+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:!?'\"()\-]+"),
        "bangs": share("[!?]+"),
        "stops": share("[.]+"),
        "commas": share("[,]+"),
        "distinct_words": of_words(F.size(F.array_distinct(words))),
        "log_lines": F.log1p(nl.cast("double")),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(nl, F.lit(1)),
        "words_a_line": F.log1p(nw / F.greatest(nl, F.lit(1))),
    }


@dataclass(frozen=True)
class RuleModel:
    """``rules`` are tuples of (statistic, above, threshold), ``weights`` theirs."""

    bias: float
    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & (F.col(name) > cut if above else F.col(name) <= cut)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray,
          depth: int, path: tuple, paths: list, values: np.ndarray) -> None:
    """One regression tree on gradients; notes every path and the leaves' steps."""
    if path:
        paths.append(path)
    best = (1e-6, None, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    if depth and len(rows) >= 20:
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            place = np.searchsorted(cut, x[rows, j], side="left")
            gl = np.cumsum(np.bincount(place, grad[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(place, hess[rows], len(cut) + 1))[:-1]
            nl = np.cumsum(np.bincount(place, minlength=len(cut) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl)**2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 5) | (len(rows) - nl < 5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, cut[k])
    _, j, cut = best
    if j is None:
        values[rows] = -g / (h + 1)
        return
    above = x[rows, j] > cut
    for side in (False, True):
        _grow(x, grad, hess, cuts, rows[above == side], depth - 1, (*path, (j, side, float(cut))), paths, values)


def _simplify(path: tuple) -> tuple:
    """The tightest threshold for each statistic and direction."""
    out: dict = {}
    for j, above, cut in path:
        old = out.get((j, above))
        out[j, above] = cut if old is None else (max if above else min)(old, cut)
    return tuple(sorted((j, above, cut) for (j, above), cut in out.items()))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradients."""
    mean, spread = r.mean(axis=0), np.maximum(r.std(axis=0), 1e-3)
    z = (r - mean) / spread
    step = 4.0 / max(np.linalg.norm(z, 2)**2 / len(y), 1.0)
    w = v = np.zeros(z.shape[1])
    b = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    momentum = 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(z @ v + b, -30, 30))) - y
        new = v - step * (z.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= error.mean()
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = new + (momentum - 1) / ahead * (new - w), new, ahead
    raw = w / spread
    return float(b - (raw * mean).sum()), raw


def fit(names: list[str], x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH,
        penalty: float = PENALTY) -> RuleModel:
    """A rule model of ``y`` (0 or 1); without both labels, the constant share of ones."""
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else float(np.clip(y.mean(), 0.01, 0.99))
        return RuleModel(float(np.log(share / (1 - share))), (), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    paths: list = []
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        values = np.zeros(len(y))
        _grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), depth, (), paths, values)
        total += 0.3 * values
    rules = sorted({_simplify(p) for p in paths})
    holds = np.ones((len(y), len(rules)))
    for i, rule in enumerate(rules):
        for j, above, cut in rule:
            holds[:, i] *= (x[:, j] > cut) if above else (x[:, j] <= cut)
    _, first = np.unique(holds, axis=1, return_index=True)  # rules that say the same on all rows
    first = np.sort(first)
    bias, weights = _lasso(holds[:, first], y, penalty)
    kept = [(rules[i], float(w)) for i, w in zip(first, weights) if abs(w) > 1e-6]
    return RuleModel(bias, tuple(tuple((names[j], a, c) for j, a, c in r) for r, _ in kept),
                     tuple(w for _, w in kept))


def with_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """A stored table of ``id`` and the statistics of every row, and their names."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t"))
    found = statistics(F.col("t"))
    return staged(rows.select("id", *[c.cast("double").alias(n) for n, c in found.items()]), "statistics"), list(found)


def fit_labels(stats: DataFrame, names: list[str], labels: DataFrame, label: str, *, key: str = "doc_id",
               rows: int = TRAIN_ROWS) -> RuleModel:
    """Fit on the labelled rows among ``labels``, a hash sample of about ``rows`` of them."""
    train = sampled(labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("double").alias("label"))
                    .where("label is not null"), "id", rows)
    found = stats.join(train, "id").select(*names, "label").toPandas()
    found = found.sort_values([*names, "label"])
    return fit(names, found[names].to_numpy(float), (found["label"].to_numpy(float) > 0).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", *,
                  label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """``key``, ``score`` (higher: label 1 likelier) and ``predicted`` of every row.

    The statistics see nothing but the text. Null counts as empty and gets the score of the empty
    text; repeated rows are scored each; labels without a document and null labels are not learnt
    from; without labels the score is 0.5. ``rows`` bounds what the driver fits on.
    """
    stats, names = with_statistics(docs, text, key)
    model = fit_labels(stats, names, labels, label, key=key, rows=rows)
    return stats.select(F.col("id").alias(key), model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels not held out; nulls and empty texts as in :func:`score_quality`."""
    held_out = remainder("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").where(~held_out)
    return score_quality(table(spark, sf_dir, "documents"), labels).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")
