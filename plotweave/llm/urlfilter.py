"""URL filter by cascades of Bloom filters (DataFrame functions only).

Every key that a url could be listed under (a suffix of its host of no more labels than the
longest listed host has, with a prefix of its path) is enumerated for the whole corpus once: the
key universe. A host of any number of labels thus gives few keys. Level 1 of a cascade encodes the listed
keys, level 2 the unlisted keys of the universe that level 1 lets through, level 3 the listed keys
that level 2 lets through, and so on until nothing is let through wrongly. Over the universe the
cascade is exact, and urls are judged by expressions over literal bit arrays, without a join. A
list whose filter is too long for a literal is met by an equi-join of the urls' keys instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import addressed, table
from plotweave.sources.workspace import staged

#: (verdict, rule): the host before the first slash and its subdomains, and a prefix of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
#: The list behind the rules: hosts that are blocked with their subdomains where no rule fits.
BLOCKED_HOSTS = ("adult-x.example.net", "ads-track.example.com", "casino-win.example.com",
                 "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com")
#: Bits for a key of a level, hash functions, and the bound of one level's literal; a longer list
#: is joined.
BITS_PER_KEY, HASHES, MAX_BITS = 12, 6, 1 << 24


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def labels(host: str) -> int:
    return host.count(".") + 1


def host_keys(host: Column, most: int) -> Column:
    """What is left of the host before each of its last dots, ``most`` labels at most, and the host
    itself if it has no more; longest first; none for the empty host."""
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.when((host == "") | F.lit(most < 1), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(-F.least(n, F.lit(max(most, 1))), F.lit(-1)),
                    lambda i: F.call_function("substring_index", host, F.lit("."), i)))


def rule_keys(hosts: Column, path: Column, lengths: Iterable[int]) -> Column:
    """Every host key with every prefix of the path that has one of the lengths, longest first."""
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.length(path) >= n)
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(
        prefixes, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))
    return F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))


def _bit(key: Column, level: int, i: Column, bits: int) -> Column:
    """The ``i``-th position of a key among ``bits``, by double hashing."""
    h = F.xxhash64(key, F.lit(level))
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return F.pmod(h.bitwiseAND(F.lit(0x7FFFFFFF)) + i * step, F.lit(bits))


def _level(keys: DataFrame, level: int, n: int) -> tuple[int, str]:
    """Bits of one Bloom filter, and its words as text."""
    bits = -(-max(1, n) * BITS_PER_KEY // 64) * 64
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)),
                               lambda i: _bit(F.col("key"), level, i, bits)))
    found = {r["word"]: r["bits"] for r in (
        keys.select(at.alias("at"))
        .select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())}
    return bits, ",".join(str(found.get(w, 0)) for w in range(bits // 64))


def _passes(key: Column, level: int, bits: int, words: str) -> Column:
    array = F.split(F.lit(words), ",").cast("array<bigint>")  # folded into one literal

    def set_(i: Column) -> Column:
        at = _bit(key, level, i, bits)
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
        return F.get(array, F.floor(at / 64).cast("int")).bitwiseAND(mask) != 0

    return F.forall(F.sequence(F.lit(0), F.lit(HASHES - 1)), set_)


def _named(spark: SparkSession, keys: Iterable[str]) -> DataFrame:
    """Strings as a table ``key``, made of a literal."""
    text = json.dumps(sorted(set(keys)))
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), "array<string>")).alias("key"))


class Cascade:
    """Exact membership of a universe's keys in a list, as a column expression."""

    def __init__(self, levels: list[tuple[int, str]], members: DataFrame | None = None, name: str = ""):
        self.levels, self.members, self.name = levels, members, name

    @classmethod
    def build(cls, universe: DataFrame, listed: Iterable[str], name: str = "__listed") -> Cascade:
        """``universe`` has one row per ``key``. What the driver gets is the bits of the levels.

        Where the first level would pass ``MAX_BITS``, there are none: the listed keys of the
        universe stay a table, and :meth:`join` brings each row's own as the column ``name``.
        """
        names = _named(universe.sparkSession, listed)
        known = staged(universe.join(names, "key", "left_semi"), "known")
        n = known.count()
        if n * BITS_PER_KEY > MAX_BITS:
            return cls([], known, name)
        others = universe.join(names, "key", "left_anti")
        levels: list[tuple[int, str]] = []
        inside, outside = known, others  # keys to encode next, and keys that must not pass
        while n:
            level = len(levels)
            levels.append(_level(inside, level, n))
            passed = staged(outside.where(_passes(F.col("key"), level, *levels[-1])), f"passed{level}")
            inside, outside = passed, inside
            n = inside.count()
        return cls(levels)

    def join(self, rows: DataFrame, keys: Column) -> DataFrame:
        """``rows`` (addressed) as they are, or with the listed ones of their keys."""
        if self.members is None:
            return rows
        own = rows.select("__file", "__row", F.explode(F.array_distinct(keys)).alias("key")).join(self.members, "key")
        found = own.groupBy("__file", "__row").agg(F.collect_list("key").alias(self.name))  # the row's keys at most
        return rows.join(found, ["__file", "__row"], "left")

    def contains(self, key: Column) -> Column:
        """A key that stops at level n is listed if n is even, counted from 1; one that passes
        all is listed if their number is odd."""
        if self.members is not None:
            return F.coalesce(F.array_contains(F.col(self.name), key), F.lit(False))
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(_passes(key, i, *self.levels[i]), out).otherwise(F.lit(i % 2 == 1))
        return out


def _longest(keys: Column, contains: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(keys, contains), F.lit(0))


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, blocked_hosts: Iterable[str] = BLOCKED_HOSTS,
    *, url: str = "url", key: str = "page_id",
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` of every row.

    Hosts are lower-cased in A-Z only. A null url, or one without ``://``, has an empty host and
    path. A rule fits its host and all subdomains if the path starts with the rule's; the longest
    rule wins. Where none fits, urls whose host or a parent of it is listed are blocked and all
    others allowed. Repeated rows are judged each; an empty table gives an empty result. A url of
    any length is read whole; ``rules`` and ``blocked_hosts`` may be of any number.
    """
    rules, blocked_hosts = list(rules), list(blocked_hosts)
    if len({r for _, r in rules}) < len(rules) or any("/" not in r for _, r in rules):
        raise ValueError("rules must differ and contain a slash after their host")
    lengths = sorted({len(r) - r.index("/") for _, r in rules})
    most = max([0, *(labels(r[:r.index("/")]) for _, r in rules), *map(labels, blocked_hosts)])
    rows = addressed(pages).select("__file", "__row", F.col(key), F.col(url).cast("string").alias("__url")).select(
        "__file", "__row", F.col(key), host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    hosts = host_keys(F.col("host"), most)
    keys = rule_keys(hosts, F.col("path"), lengths)
    universe = staged(rows.select("host", *[F.substring("path", 1, max(lengths, default=1)).alias("path")]).distinct()
                      .select(F.explode(F.concat(hosts, keys)).alias("key")).distinct(), "universe")
    allowed = Cascade.build(universe, [r for v, r in rules if v == "allow"], "__allowed")
    blocked = Cascade.build(universe, [*[r for v, r in rules if v == "block"], *blocked_hosts], "__blocked")
    every = F.concat(hosts, keys)
    return (
        blocked.join(allowed.join(rows, every), every).withColumn("__keys", keys)
        .withColumn("__allow", _longest(F.col("__keys"), allowed.contains))
        .withColumn("__block", _longest(F.col("__keys"), blocked.contains))
        .withColumn("__first", F.coalesce(F.length("__block"), F.lit(-1)) > F.coalesce(F.length("__allow"), F.lit(-1)))
        .select(
            F.col(key), "host", "path",
            F.when(F.col("__first"), F.col("__block")).otherwise(F.col("__allow")).alias("rule"),
            F.when(F.col("__first"), "block").when(F.col("__allow").isNotNull(), "allow")
            .when(F.exists(hosts, blocked.contains), "block").otherwise("allow").alias("verdict"))
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; null, malformed and very long urls as in :func:`judge_urls`."""
    return judge_urls(table(spark, sf_dir, "pages"))


ORACLE = f"""
WITH p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rule, rule_host, rule_path) AS (VALUES {', '.join(
    f"('{v}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for v, r in RULES)}),
b(blocked) AS (VALUES {', '.join(f"('{h}')" for h in BLOCKED_HOSTS)}),
f AS (SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM b
    WHERE p.host = b.blocked OR ends_with(p.host, '.' || b.blocked)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id
"""
