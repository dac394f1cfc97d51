"""The corpus operators against brute force, on samples and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from plotweave.llm import (
    chat, exact_dedup, hilbert, langid, mixing, packing, quality, queries, simhash, urlfilter, weighted,
)

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "The same text here.", "en", "a"), (2, "The  same\ttext here.", "en", "a"), (3, "The same text here.", None, "b"),
    (3, "The same text here.", None, "b"), (None, "no id at all, really", "en", None), (None, None, None, None),
    (4, None, "en", "a"), (5, "", "fr", "c"), (6, " \n\t ", "de", "a"), (7, LONG, "en", "a"), (8, LONG + "x", "en", "a"),
    (9, "über straße naïve \u6f22\u5b57 😀 \u0301x", "de", "é"), (10, "1234 5678 !!", "en", "a"), (-2**63, "least id", "en", "z"),
    (2**63 - 1, "greatest id", "en", "z"), (11, "one", "en", "b"), (12, "one two", "en", "b"), (13, "<|endoftext|> don't a\x1cb", "en", "b"),
    (14, "The same text here", "en", "a"), (15, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, "en", "d"),
]
CLASHING = ["n", "id", "t", "fp", "size", "part", "digest", "best", "kept", "score", "curve", "shard", "slot", "target", "copies",
            "component", "length", "rank", "own", "hash", "p", "word", "bits", "sha", "norm", "lang_pred", "place", "node"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, extreme ids and clashing columns."""
    df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in ROWS],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"extra {c}"))
    path = f"file://{tmp_path_factory.mktemp('odd')}/documents.parquet"
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


# --- 1 exact dedup ---------------------------------------------------------------------------


def dedup_classes(rows):
    out = defaultdict(list)
    for i, t, *_ in rows:
        out[strip(t)].append((-len(t or ""), i is None, i or 0, i))
    return {k: (len(v), min(v)[3]) for k, v in out.items()}


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(odd, digest_bytes):
    got = rows_of(exact_dedup.exact_dedup(odd, digest_bytes=digest_bytes))
    assert len(got) == len(ROWS)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in dedup_classes(ROWS).items()}
    assert {(r["text_sha256"], r["group_size"], r["keep_id"]) for r in got} == {(h, n, i) for h, (n, i) in sha.items()}
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(list(sha))


def test_exact_dedup_collisions_at_scale(docs, texts):
    got = rows_of(exact_dedup.exact_dedup(docs, digest_bytes=1))
    expected = dedup_classes(texts.items())
    assert all((r["group_size"], r["keep_id"]) == expected[strip(texts[r["doc_id"]])] for r in got)


@pytest.mark.parametrize("bits", [4, 27])
def test_dedup_with_and_without_a_bitmap(docs, texts, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "BITMAP_BITS", bits)
    expected = dedup_classes(texts.items())
    got = rows_of(exact_dedup.exact_dedup(docs))
    assert all((r["group_size"], r["keep_id"]) == expected[strip(texts[r["doc_id"]])] for r in got)


def test_dedup_in_small_batches(docs):
    a = exact_dedup.exact_dedup(docs, max_bytes=1).drop("__file", "__row")
    assert sorted(a.collect()) == sorted(exact_dedup.exact_dedup(docs).drop("__file", "__row").collect())


def test_dedup_of_a_view(odd):
    kept = exact_dedup.drop_copies(odd.where("doc_id is not null").withColumn("more", F.lit(1)))
    assert kept.columns == [*odd.columns, "more"]
    assert kept.count() == len(dedup_classes([r for r in ROWS if r[0] is not None]))


# --- 2 packing -------------------------------------------------------------------------------


def best_fit(lengths, capacity):
    import bisect
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        bins += i == len(rooms)
        room = capacity if i == len(rooms) else rooms.pop(i)
        bisect.insort(rooms, room - n)
    return bins


def test_plan_equals_one_by_one():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([5, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        plan = packing.plan_packing(Counter(lengths).items(), capacity)
        used = Counter()
        for n, _, count, first, each, _ in plan.tolist():
            for i in range(count):
                used[first + i // each] += n
        assert len(used) == best_fit(lengths, capacity) and all(v <= capacity for v in used.values())


def test_capacity_tree():
    tree, marked = packing.CapacityTree(100), {3, 50, 99, 100}
    for m in marked:
        tree.mark(m, True)
    for least in range(101):
        assert tree.tightest(least) == min(m for m in marked if m >= least)
    tree.mark(100, False)
    assert tree.tightest(100) is None


def test_tokens_equal_the_tokenizer():
    tokens, rng = packing.Tokens(packing.word_bpe()), random.Random(2)
    letters = [*"ab Zé'ßÀµªº²½ÿŸİıſKΣσς\u0301\u00a0\x1c\x85漢1٣_.,!<|>\n\x0b", "<|endoftext|>", "'s", "'LL"]
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(tokens.ids(t), "<u4").tolist() == tokens.encoder.encode(t, add_special_tokens=False).ids, repr(t)


def test_tokens_of_slices(monkeypatch):
    """Long texts are cut at white space and few words are remembered; the ids stay those of the text."""
    tokens, rng = packing.Tokens(packing.word_bpe()), random.Random(7)
    letters = [*"ab Zé'ßÿŸİKΣσς\u0301\u00a0\x85漢1٣_.,!<|> \n\x0b\t", "<|endoftext|>", "'s"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)] + [None, "", "x" * 500, " " * 90]
    expected = [tokens.encoder.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size, kept in ((1, 1), (7, 30), (50, 10**6)):
        monkeypatch.setattr(packing, "SLICE", size)
        monkeypatch.setattr(packing, "KEPT", kept)
        assert all("".join(packing.slices(t or "")) == (t or "") for t in texts)
        assert [np.frombuffer(tokens.ids(t), "<u4").tolist() for t in texts] == expected


def test_remembered_words_are_bounded(monkeypatch):
    tokens = packing.Tokens(packing.word_bpe())
    monkeypatch.setattr(packing, "KEPT", 100)
    for i in range(30):
        tokens.ids(" ".join(f"w{i}x{j} the " + "y" * 40 + f"{j}" for j in range(50)))
        assert len(tokens.known) <= 100 and len(tokens.known.older) <= 100 and max(map(len, tokens.known)) <= packing.LONGEST
    assert b"the" in tokens.known or b"the" in tokens.known.older


@pytest.mark.parametrize("capacity", [4096, 50])
def test_packing(odd, capacity):
    got = rows_of(packing.pack_documents(odd, packing.word_bpe(), capacity=capacity, with_ids=True))
    encoder = packing.Tokens(packing.word_bpe()).encoder
    expected = Counter()
    for i, t, *_ in ROWS:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            expected[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(sequences) == best_fit([r["length"] for r in got], capacity)


# --- 3 urls ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    r = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(df.select(*names).collect(), key=str) == sorted((x for x in r.fetchall()), key=str) or sorted(
        map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, r.fetchall()))


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "http://example.org/es/x?y", "http://notexample.org/en/12",
        "http://example.org/en/12#z", "http://x.example.org/en/1", "http://fr.com/fr/a", "http://a.com/de/", "http://a.com/de",
        "http://a.com?x=/de/", "http://www.free-bets.example.com/en/", "http://www.free-bets.example.com/fr/x",
        "http://ÄB.com/fr/", "ftp://a..com/fr/", "http://com/fr/://x.org/", "x://org", "x://org/", "http://org.net/", "http://a.org/\nq"]


def judge(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(r), r, v) for v, r in urlfilter.RULES if under(r[:r.index("/")]) and path.startswith(r[r.index("/"):])]
    listed = any(under(h) for h in urlfilter.BLOCKED_HOSTS)
    return (host, path, *(max(fits)[1:] if fits else (None, "block" if listed else "allow")))


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS)}
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, [], []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urlfilter.judge_urls(pages, [("allow", "org/"), ("block", "org/")])


def test_cascade_is_exact_with_poor_filters(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(urlfilter, "HASHES", 2)
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 3000, 7)]
    cascade = urlfilter.Cascade.build(universe, [*listed, "not in the universe"])
    assert len(cascade.levels) > 3
    assert sorted(r["key"] for r in universe.where(cascade.contains(F.col("key"))).collect()) == sorted(listed)


def test_lists_too_long_for_a_literal(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, key string")
    short = sorted(map(tuple, urlfilter.judge_urls(pages).collect()), key=str)
    for most in (0, 24, 40):  # both lists joined, or one of them
        monkeypatch.setattr(urlfilter, "MAX_BITS", most)
        assert sorted(map(tuple, urlfilter.judge_urls(pages).collect()), key=str) == short
    hosts = [f"h{i}.example" for i in range(3000)]
    monkeypatch.setattr(urlfilter, "MAX_BITS", 1 << 10)
    many = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.h"), "id", F.lit(".example/x")).alias("url"))
    got = urlfilter.judge_urls(many, [], hosts)
    assert {(r["page_id"], r["verdict"]) for r in got.collect()} == {(i, "block" if i < 3000 else "allow") for i in range(4000)}


def test_very_long_urls(spark):
    import time
    hosts = [".".join("a" * 50_000) + ".example.org", "x." * 300_000 + "free-bets.example.com", "b" * 10**6, "." * 200_000]
    urls = [f"http://{h}/{'es/' * n}" for h in hosts for n in (1, 100_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.monotonic()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages).collect()}
    assert time.monotonic() - began < 30 and got == {i: judge(u) for i, u in enumerate(urls)}


# --- 4 fingerprints --------------------------------------------------------------------------


def shingles(t, n=5):
    w = (t or "").encode().split()
    n = min(n, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def expected_pairs(order):
    out = Counter()
    for (i, t, *_), (_, u, *_) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        part = len(t) // 3
        out[i, len(t), hashlib.sha256((t[:len(t) - part] + u[:part]).encode()).hexdigest()] += 1
    return out


def test_one_id_with_a_third_of_the_rows(spark):
    """An id, or null, that many rows share is cut like the rest: no range is much above the mean."""
    text = F.concat(F.lit("w " * 300), F.col("id"))
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("doc_id"), text.alias("text"))
    got = weighted.compare_with_next(df, task_bytes=60_000, samples=8).select("doc_id", F.spark_partition_id().alias("p")).collect()
    counts = Counter(r["p"] for r in got)
    assert len(got) == 3000 and len(counts) > 20 and max(counts.values()) < 2.5 * 3000 / len(counts)
    assert Counter(r["doc_id"] for r in got) == Counter(7 if i % 3 == 0 else i if i % 3 == 1 else None for i in range(3000))


@pytest.mark.parametrize("task_bytes", [32 << 20, 20_000])
def test_next_and_edited(odd, task_bytes):
    got = rows_of(weighted.compare_with_next(odd, task_bytes=task_bytes))
    found = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert [r[0] for r in order[-2:]] == [None, None]  # rows of one id come in either order
    assert found in [expected_pairs(o) for o in (order, [*order[:-2], order[-1], order[-2]])]
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_likeness_follows_weighted_jaccard(docs, texts):
    got = {r["doc_id"]: r for r in rows_of(weighted.compare_with_next(docs))}
    order = sorted(texts, reverse=True)
    errors = []
    for i, j in zip(order, order[1:] + order[:1]):
        errors.append(got[i]["near_edited"] - jaccard(texts[i], weighted.edited(texts[i], texts[j])))
        assert got[i]["near_next"] == pytest.approx(jaccard(texts[i], texts[j]), abs=0.15)
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.05
    alone = {r["doc_id"]: r["fingerprint"] for r in rows_of(weighted.document_fingerprints(docs))}
    assert alone == {i: r["fingerprint"] for i, r in got.items()}


def test_heavy_weights():
    s, rng, errors = weighted.Sampler(1024), random.Random(3), []
    for _ in range(40):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(10)]
        a, b = (" ".join(words[:5] * rng.randint(1, 40) + words[5:] * rng.randint(1, 40)) for _ in range(2))
        errors.append(weighted.likeness(s.signature(a), s.signature(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.07


@pytest.mark.parametrize("n", [300, 20_000, 100_000])
def test_many_shingles_with_unequal_counts(n):
    s, text = weighted.Sampler(), " ".join(f"w{i}" for i in range(n))
    half = " ".join(f"w{i}" for i in range(n // 2))
    for a, b in ((text, f"{text} {text}"), (f"{text} {half} {half}", f"{half} {text}")):
        assert weighted.likeness(s.signature(a), s.signature(b)) == pytest.approx(jaccard(a, b), abs=0.1)


def test_bound_loses_no_sample(monkeypatch):
    s, rng = weighted.Sampler(), random.Random(5)
    lines = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(12)) for _ in range(150)]
    text = " ".join(x for x in lines for _ in range(rng.choice((1, 1, 2, 3, 40))))
    terms, counts = s.terms(text)
    k, j = (x.ravel() for x in np.indices((s.samples, len(terms))))
    third = (s.turn[:, None] * terms.astype(np.uint32)[None, :]).ravel()
    a, t = (x.reshape(s.samples, -1) for x in s._draw(k, terms[j], counts[j].astype(float), s._place(terms).ravel(), third))
    assert (t[:, counts == 1] == 0).all()
    best, rows = a.argmin(axis=1), np.arange(s.samples)
    mixed = weighted._mix(terms[best] + t[rows, best].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    assert (s.signature(text) == (mixed >> np.uint64(48)).astype(np.uint16)).all()
    monkeypatch.setattr(weighted, "HEAVY_CHUNK", 64)
    assert (s.signature(text) == (mixed >> np.uint64(48)).astype(np.uint16)).all()


def test_one_and_no_document(odd):
    one = odd.where("doc_id = 15")
    r = weighted.compare_with_next(one).first()
    assert r["near_next"] == 1.0 and weighted.compare_with_next(odd.limit(0)).count() == 0


# --- 5 quality -------------------------------------------------------------------------------


def test_quality(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = rows_of(quality.op5_quality_rules(spark, sf))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.95
    again = {r["doc_id"]: r["score"] for r in rows_of(quality.op5_quality_rules(spark, sf))}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-9) for r in got)


def test_quality_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1), (10, 0), (7, None), (999, 0), (1, 1)], "doc_id long, quality int")
    got = rows_of(quality.score_quality(odd, labels))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in rows_of(quality.score_quality(odd, labels.limit(0)))} == {0.5}
    assert quality.score_quality(odd.limit(0), labels).count() == 0


def slow_statistics(t):
    t = t or ""
    n = max(1, len(t))
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if x]
    count = lambda keep: sum(map(keep, t))
    import unicodedata
    letter = lambda c: unicodedata.category(c)[0] == "L"
    return {
        "log_words": np.log1p(len(w)), "word_length": sum(map(len, w)) / max(1, len(w)), "letters": count(letter) / n,
        "capitals": count(lambda c: unicodedata.category(c) == "Lu") / n, "digits": count(lambda c: c in "0123456789") / n,
        "symbols": count(lambda c: not letter(c) and unicodedata.category(c)[0] != "N"
                         and c not in " \t\n\x0b\f\r" and c not in ".,;:!?'\"()-") / n,
        "bangs": count(lambda c: c in "!?") / n, "stops": t.count(".") / n, "commas": t.count(",") / n,
        "distinct_words": len(set(w)) / max(1, len(w)), "log_lines": np.log1p(len(lines)),
        "distinct_lines": len(set(lines)) / max(1, len(lines)), "words_a_line": np.log1p(len(w) / max(1, len(lines))),
    }


def test_statistics_and_compiled_score_equal_brute_force(spark, odd, docs):
    for table in (odd, docs):
        stats, names = quality.with_statistics(table)
        got, texts_ = stats.collect(), defaultdict(list)
        for r in table.collect():
            texts_[r["doc_id"]].append(slow_statistics(r["text"]))
        assert all(any(all(r[c] == pytest.approx(x[c], abs=1e-9) for c in names) for x in texts_[r["id"]]) for r in got)
    rng = np.random.default_rng(1)
    x = np.array([[r[c] for c in names] for r in got])
    model = quality.fit(names, x, (x[:, 0] + 0.3 * rng.random(len(x)) > np.median(x[:, 0])).astype(float))
    assert len(model.rules) > 1
    for r in stats.select("*", model.score().alias("score")).collect():
        total = model.bias + sum(w for rule, w in zip(model.rules, model.weights)
                                 if all((r[n] > cut) == above for n, above, cut in rule))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_rules_separate():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.5)).astype(float)
    model = quality.fit(["a", "b", "c"], x, y)
    assert 0 < len(model.rules) < 60
    total = np.full(600, model.bias)
    for rule, w in zip(model.rules, model.weights):
        total += w * np.all([(x[:, "abc".index(n)] > c) if up else (x[:, "abc".index(n)] <= c) for n, up, c in rule], axis=0)
    assert np.mean((total > 0) == (y > 0)) > 0.97


# --- 6 mixing --------------------------------------------------------------------------------


def targets_of(sizes, weights=(1, 2, 3), limit=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, sum(sizes.values()), set(names)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > limit * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
            free.discard(s)


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("group", [4, 2000])
def test_mix(docs, group):
    got, sizes, sources = rows_of(mixing.mix(docs, group=group)), Counter(), {}
    for r in docs.collect():
        sizes[r["source"]] += words(r["text"])
        sources[r["doc_id"]] = (r["source"], words(r["text"]))
    expected, taken = targets_of(sizes), Counter()
    assert len(got) == len(sources)
    for r in got:
        s, n = sources[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s])
        assert r["taken"] == r["copies"] * n and r["copies"] <= 3
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(n for t, n in sources.values() if t == s) / 2 + 1e-6
    again = {r["doc_id"]: r["taken"] for r in rows_of(mixing.mix(docs.repartition(7), group=group))}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mix_of_one_repeated_row(spark):
    """A third of the rows are one row: they are dealt to many groups, and targets are met."""
    rows = [(1, "a b c", "x")] * 400 + [(i, "d " * (i % 9 + 1), "y") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got, taken = rows_of(mixing.mix(df, group=50)), Counter()
    expected = targets_of({"x": 1200, "y": sum(i % 9 + 1 for i in range(800))})
    for r in got:
        taken["x" if r["doc_id"] == 1 and r["size"] == 3 and r["source_size"] == 1200 else "y"] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 9 for s in expected)
    assert sorted(map(str, got)) != [] and len(got) == 1200


def test_mix_of_many_sources(spark):
    """As many sources as documents: targets by SQL's rule, without a task for all of them."""
    rows = [(i, "w " * (i * 7 % 40), f"host{i * 37 % 1000}" if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    expected = targets_of(dict(sizes))
    for r in rows_of(mixing.mix(df)):
        s = rows[r["doc_id"]][2]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s])


def test_mix_of_odd_tables(odd):
    got = rows_of(mixing.mix(odd))
    sizes = Counter()
    for _, t, _, s in ROWS:
        sizes[s] += words(t)
    expected = targets_of(dict(sizes))
    assert len(got) == len(ROWS) and {round(r["target"], 6) for r in got} == {round(x, 6) for x in expected.values()}
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd).columns == odd.columns


def test_settling_keeps_expectations():
    hits = np.zeros(6)
    sizes, share = [50, 40, 30, 20, 10, 5], [0.3, 0.7, 0.5, 0.2, 0.9, 0.4]
    for seed in range(3000):
        rows = [(0, i, seed * 10 + i, s, p) for i, (s, p) in enumerate(zip(sizes, share))]
        done, held = mixing.settle(rows, 0)
        for _, i, extra in done:
            hits[i] += extra
        words_ = sum(sizes[i] * extra for _, i, extra in done)
        if held:
            hits[held[1]] += held[4]
            words_ += held[3] * held[4]
        assert words_ == pytest.approx(sum(s * p for s, p in zip(sizes, share)))
    assert np.abs(hits / 3000 - share).max() < 0.04


# --- 7 language ------------------------------------------------------------------------------


def test_language(spark, docs):
    got = rows_of(langid.op7_language_id(spark, SF))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_tables(spark, odd, docs):
    model = langid.fit(docs, "text", "lang")
    got = Counter((r["doc_id"], r["__lang"] == "und") for r in rows_of(langid.predict(odd, model, carry=["doc_id"])))
    assert got == Counter((i, not re.search(r"[^\W\d_]", t or "")) for i, t, *_ in ROWS)
    assert langid.keep_identified(odd).columns == odd.columns
    signs = spark.createDataFrame([(1, "² ½ 5"), (2, "²a")], "doc_id long, text string")
    assert {r["doc_id"]: r["__lang"] == "und" for r in rows_of(langid.predict(signs, model, carry=["doc_id"]))} == {1: True, 2: False}
    nothing = langid.fit(odd.where("false"), "text", "lang")
    assert {r["__lang"] for r in rows_of(langid.predict(odd, nothing, carry=["doc_id"]))} == {"und"}


def score(model, word):
    return model.scores([word])[0]


def test_backoff_gets_shorter():
    model = langid.Model([("house", "en", 5), ("haus", "de", 5)])
    assert model.languages == ["de", "en"] and score(model, "house")[1] > score(model, "house")[0]
    assert score(model, "houses")[1] > score(model, "houses")[0] and score(model, "hauses")[0] > score(model, "hauses")[1]
    assert score(model, "漢").tolist() == [0, 0]


class SlowBackoff:
    """The word-first backoff by counting in dictionaries, a word and an n-gram at a time."""

    def __init__(self, rows):
        counts = defaultdict(Counter)
        for text, lang in rows:
            for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
                counts[w][lang] += 1
        self.languages = sorted({la for c in counts.values() for la in c})
        self.tables = {0: counts}
        for size in range(1, 6):
            self.tables[size] = defaultdict(Counter)
            for w, c in counts.items():
                for g in langid.ngrams(w, size):
                    self.tables[size][g].update(c)
        self.sums = {k: [sum(c[la] + 0.5 for c in t.values()) for la in self.languages] for k, t in self.tables.items()}

    def logs(self, kind, x):
        return np.log([(self.tables[kind][x][la] + 0.5) / s for la, s in zip(self.languages, self.sums[kind])])

    def word(self, w):
        if w in self.tables[0]:
            return self.logs(0, w)
        for size in range(5, 0, -1):
            known = [g for g in langid.ngrams(w, size) if g in self.tables[size]]
            if known:
                return np.mean([self.logs(size, g) for g in known], axis=0)
        return np.zeros(len(self.languages))

    def predict(self, text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        total = np.sum([self.word(w) for w in words], axis=0)
        return self.languages[int(total.argmax())], 1 / np.exp(total - total.max()).sum()


def test_language_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    slow = SlowBackoff([(t, la) for i, t, la in rows if la is not None and zlib.crc32(str(i).encode()) % 4 != 2])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows_of(langid.op7_language_id(spark, SF))}
    for i, t, _ in rows:
        lang, p = slow.predict(t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(p, abs=1e-3), i


def test_prediction_in_parts(monkeypatch):
    """What is looked up together changes nothing, however long a text is."""
    rng = random.Random(8)
    model = langid.Model([("".join(rng.choices("abcdeé", k=rng.randint(1, 6))), rng.choice(["x", "y", "z"]), 1) for _ in range(300)])
    texts = [None, "", "12", "²", *(" ".join("".join(rng.choices("abcdeéf ²1", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 60)))
                                    for _ in range(80)), "1 " * 400, "漢 " * 300, "ab" * 500]
    whole = list(model.predict(texts))
    for together in (1, 7, 100):
        monkeypatch.setattr(langid, "TOGETHER", together)
        got = list(model.predict(texts))
        assert [g[0] for g in got] == [w[0] for w in whole]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in whole], rel=1e-9)
    assert len(whole) == len(texts) and list(model.predict([])) == []


def test_prediction_decides(spark, odd, docs):
    """Documents go by the language they are written in; labels only teach."""
    held = {r["doc_id"]: (r["lang"], r["__lang"], r["__score"]) for r in rows_of(
        langid.predict(docs, langid.fit(docs, "text", "lang"), carry=["doc_id", "lang"]))}
    english = next(r for r in docs.collect() if r["lang"] == "en" and held[r["doc_id"]][1] == "en" and len(r["text"]) > 500)
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") == english["doc_id"], "de").otherwise(F.col("lang")))
    for wanted in (["en"], ["de", "fr"]):
        ids = {r["doc_id"] for r in langid.keep_identified(wrong, wanted=wanted).collect()}
        assert (english["doc_id"] in ids) == ("en" in wanted)
        assert ids == {i for i, (_, found, _) in held.items() if found in wanted}
    sure = {r["doc_id"] for r in langid.keep_identified(docs, least_score=0.9).collect()}
    assert sure == {i for i, (_, found, p) in held.items() if found != "und" and p >= 0.9}
    strange = spark.createDataFrame([(-1, "漢字 漢字。", None, None, 6)], docs.schema)
    for one in (docs, docs.where("lang = 'en'")):  # with one language there is no guess to beat
        assert langid.keep_identified(one.unionAll(strange)).where("doc_id = -1").count() == (one is not docs)
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = Counter(r["doc_id"] for r in langid.keep_identified(unlabelled, least_score=0.5).collect())
    assert kept == Counter(i for i, t, *_ in ROWS if re.search(r"[^\W\d_]", t or ""))


def test_model_keeps_every_pair_and_ngram(spark):
    letters = "translate(lpad(conv(cast(pmod(xxhash64({0}), 11881376) * 16000 + {0} as string), 10, 26), 9, '0'), '0123456789', 'qrstuvwxyz')"
    rows = spark.range(160_000).select(F.lower(F.expr(letters.format("id"))).alias("w"), (F.col("id") % 16).alias("doc_id"))
    docs = rows.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("w")).alias("text")).withColumn(
        "lang", F.when(F.col("doc_id") < 8, "a").otherwise("b"))
    expected = {(w, r["lang"]) for r in docs.collect() for w in r["text"].split()}
    model = langid.fit(docs, "text", "lang")
    assert len(expected) > 155_000 and set(model.words.to_pylist()) == {w for w, _ in expected}
    grams = {g for w, _ in expected for size in range(1, 6) for g in langid.ngrams(w, size)}
    assert len(grams) > 200_000 and set(model.grams.to_pylist()) == grams
    for w, lang in sorted(expected)[::5_000]:
        assert model.languages[int(score(model, w).argmax())] == lang


def test_backoff_reads_whole_runs(monkeypatch):
    model = langid.Model([("abcdef", "en", 5), ("uvwxyz", "de", 5)])
    run = "abcdef" * 11 + "uvwxyz" * 400
    places = {g: i for i, g in enumerate(model.grams.to_pylist())}
    found = [places[g] for g in langid.ngrams(run, 5) if g in places]
    expected = model.gram_logs[found].mean(axis=0, dtype=np.float64)
    assert next(model.predict([run]))[0] == "de"
    for together in (langid.TOGETHER, 7):
        monkeypatch.setattr(langid, "TOGETHER", together)
        assert score(model, run) == pytest.approx(expected, rel=1e-5)


# --- 8 simhash -------------------------------------------------------------------------------


def slow_print(t):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=3):
    """Smallest id by fingerprint, ids may be None."""
    fps = sorted(set(p for _, p in prints))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for i, p in prints:
        if i is not None:
            low[find(p)] = min(low.get(find(p), i), i)
    return {p: low.get(find(p)) for p in fps}


@pytest.mark.parametrize("tile", [4, 4096])
def test_simhash(docs, texts, tile):
    prints = [(i, slow_print(t)) for i, t in texts.items()]
    expected, by_id = components(prints), dict(prints)
    for r in rows_of(simhash.simhash_groups(docs, tile=tile)):
        p = by_id[r["doc_id"]]
        assert r["fingerprint"] == f"{p:016x}" and r["component_id"] == expected[p]


def test_simhash_of_odd_tables(odd):
    expected = components([(i, slow_print(t)) for i, t, *_ in ROWS])
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(simhash.simhash_groups(odd)))
    assert got == Counter((i, f"{slow_print(t):016x}", expected[slow_print(t)]) for i, t, *_ in ROWS)
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["component"] for r in rows_of(simhash.simhash_groups(odd))})
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_links_lose_nothing(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for b in base[:60]:
        for _ in range(6):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                b ^= 1 << bit
            fps.add(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from plotweave.operators.components import connected_components
    for tile in (3, 16, 4096):
        got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, tile=tile)).collect()}
        groups = defaultdict(set)
        for f in signed:
            groups[got.get(f, f)].add(f % (1 << 64))
        expected = components([(f, f) for f in fps])
        truth = defaultdict(set)
        for f in fps:
            truth[expected[f]].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_tile_pairs_of_one_bucket_go_to_many_tasks(spark):
    """All fingerprints share a bucket: its pairs of tiles aren't one task's."""
    df = spark.range(600).select((F.col("id") * 8).alias("fp"))
    from plotweave.operators.components import connected_components
    with_conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, tile=16)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_conf)
    expected = components([(i * 8, i * 8) for i in range(600)])
    assert all(got.get(f, f) == expected[f] for f in expected)


def test_tile_of_one_large_group():
    a = np.arange(4096, dtype=np.int64) & 7  # all within three bits
    a = np.unique(a)
    assert len(simhash.tile_links(a, a, 3, True)) == 7


# --- 9 sharding ------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (3, 1), (4, 2)])
def test_hilbert_visits_every_cell_by_single_steps(spark, n, bits):
    import itertools
    cells = [tuple(c) for c in itertools.product(range(1 << bits), repeat=n)]
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    got = sorted((r["h"], *(r[f"c{i}"] for i in range(n))) for r in df.withColumn(
        "h", hilbert.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).collect())
    assert [g[0] for g in got] == list(range(len(cells)))
    assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1 for a, b in zip(got, got[1:]))


def test_cells_equal_brute_force(spark, odd):
    rng = random.Random(9)
    values = [rng.choice([None, *range(30), *[7] * 20]) for _ in range(500)]
    names = [None if v is None else f"s{v:02d}" for v in values]
    df = spark.createDataFrame(list(zip(values, names)), "v long, s string")
    for bits in (1, 3, 5):
        whole = sorted(v for v in values if v is not None)
        cuts = sorted({whole[-(-k * len(whole) // (1 << bits)) - 1] for k in range(1, 1 << bits)} - {whole[-1]})
        got = df.select("v", hilbert.number_cell(df, "v", bits).alias("c")).distinct().collect()
        assert {(r["v"], r["c"]) for r in got} == {(v, sum(v > c for c in cuts) if v is not None else 0) for v in values}
        below, cells, n = 0, {}, Counter(names)
        for s in sorted(n, key=lambda x: (x is not None, x)):
            cells[s] = int((below + n[s] / 2) * (1 << bits) / 500)
            below += n[s]
        assert {r["value"]: r["cell"] for r in hilbert.text_cells(df, "s", bits).collect()} == cells


@pytest.mark.parametrize("shards", [1, 8, 40])
def test_shards(odd, shards):
    got = rows_of(hilbert.assign_shards(odd, shards))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(ROWS)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    flat = [r["curve"] for s in sorted(by) for r in sorted(by[s], key=lambda r: r["slot"])]
    assert flat == sorted(flat)
    assert hilbert.assign_shards(odd.limit(0)).count() == 0


def test_written_shards(odd, tmp_path):
    hilbert.write_shards(odd, f"file://{tmp_path}/out", 4)
    back = odd.sparkSession.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == len(ROWS)


# --- 10 chat ---------------------------------------------------------------------------------


def test_template_round_trip():
    t, rng = chat.Template(), random.Random(5)
    parts = ["\\", "### ", "</turn>", "a", "###", "</", ": ", "@", "\n", "### Assistant: "]
    for _ in range(2000):
        s, other = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(2))
        for role in ("user", "assistant", "", other):
            whole = t.head(role) + t.escape(s) + t.tail + t.after
            assert t.turn(whole + "### User: next") == (role, s, "### User: next")


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b</turn>\\"), (1, 1, "assistant", "b</turn>\\"), (2, None, None, None),
             (2, 0, "tool: x", "### User: "), (None, 3, "assistant", ""), (3, 1, "assistant", "second"), (3, 0, "user", "first"),
             (4, 0, "user", "no answer"), (5, 0, "system", "s"), (5, 1, "user", "\\### User: </turn> " * 60_000), (5, 2, "assistant", "### " * 400_000)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, valid string")
    formatted = chat.segments(df)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    groups = defaultdict(list)
    for c, t, r, x in turns:
        groups[c].append((t is None, t or 0, r or "", x or ""))
    assert set(got) == set(groups)
    for c, rows in groups.items():
        rows.sort()
        everything = "".join(f"{r}\n{x}\n" for *_, r, x in rows)
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        assert got[c]["n_turns"] == len(rows) and got[c]["turns_sha256"] == hashlib.sha256(everything.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r["valid"] for c, r in got.items()} == {1: False, 2: False, None: False, 3: True, 4: False, 5: True}
    text = "".join(r["text"] for r in formatted.where("conv_id = 3").orderBy("turn", "part").collect())
    assert text == "### User: first</turn>\n### Assistant: second</turn>\n" and got[3]["formatted_chars"] == len(text)
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline(spark, docs, texts):
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from plotweave.sources.workspace import staged
        now = staged(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        kept[name] = [r["doc_id"] for r in now.collect()]
    slow = SlowBackoff([(r["text"], r["lang"]) for r in docs.collect() if r["lang"] is not None])
    found = {i: slow.predict(t) for i, t in texts.items()}
    assert sorted(kept["language"]) == sorted(i for i, (la, p) in found.items() if la != "und" and p > 1 / len(slow.languages))
    assert sorted(kept["exact_copies"]) == sorted(i for _, i in dedup_classes([(i, texts[i]) for i in kept["language"]]).values())
    expected = components([(i, slow_print(texts[i])) for i in kept["exact_copies"]])
    assert sorted(kept["near_copies"]) == sorted(set(expected.values()))
    copies = Counter(kept["mixture"])
    assert max(copies.values()) <= 3 and set(copies) <= set(kept["near_copies"])
    packed = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies


def test_pipeline_of_odd_tables(spark, odd):
    now = odd
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() > 0
    now = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0


def test_addresses(spark, odd):
    from plotweave.llm.common import _plain_scan, addressed
    assert _plain_scan(odd.where("doc_id > 3").select("doc_id", "text")) and addressed(addressed(odd)).columns == addressed(odd).columns
    doubled = odd.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    assert not _plain_scan(doubled)
    a = addressed(doubled)
    assert a.select("__file", "__row").distinct().count() == a.count() == 2 * len(ROWS)
    assert exact_dedup.drop_copies(doubled).count() == len(dedup_classes(ROWS))


def test_search_among_cuts(spark):
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 7, 8, 100):
        cuts = sorted({(rng.random() < 0.8, rng.randint(-3, 3), rng.choice([-2**63, -5, 0, 9])) for _ in range(n)})
        values = [(rng.random() < 0.8, rng.randint(-4, 4), rng.choice([-2**63, -5, 0, 9, 2**63 - 1])) for _ in range(100)]
        df = spark.createDataFrame(values, "has boolean, id long, h long").select(F.struct("has", "id", "h").alias("v"))
        got = df.select("v", weighted._not_above(cuts, F.col("v")).alias("n")).collect()
        assert all(r["n"] == sum(c <= tuple(r["v"]) for c in cuts) for r in got)
