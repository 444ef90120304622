"""Phrase collocations, ranked search and nearest neighbours against SQL or brute force, on small tables."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from solframe.llm import collocations as C
from solframe.llm import learned_partitions as P
from solframe.llm import lexical_search as S
from solframe.llm.queries import QUERIES

from ..helpers import compare

SCHEMA = "doc_id long, text string, lang string, n int, a int, rank int, phrase string, term string, shard int, part int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, very long and broken texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"W{i % 61}{'.' if i % 13 == 0 else ''}" for i in range(40_000)) + " " + "x" * 300_000
    texts = [(1, "The cat, the cat sat; THE CAT"), (1, "The cat, the cat sat; THE CAT"), (2, None), (3, ""), (4, " \t\n.;"), (5, long), (6, long), (None, "the cat sat on"), (None, "the cat"), (7, "Ünï ünï\x85café über"), (8, "a b a b a b a b"), (9, "sat cat")]
    rows = [(d, t, (None, "en", "und", "")[i % 4], i, i, None, "x", None, i, 0) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# 11


def brute_collocations(rows, max_n=5, at_least=100, percent=100, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, max_n + 1) for i in range(len(ws) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= at_least}
    gone = {(lang, ws[i : i + m]) for (lang, ws), a in cand.items() for m in range(2, len(ws)) for i in range(len(ws) - m + 1) if 100 * a >= percent * f[lang, ws[i : i + m]]}
    out = {}
    for (lang, ws), a in cand.items():
        if (lang, ws) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1))


@pytest.mark.parametrize("sizes", [{}, {"numbered": 0}, {"chunk": 300, "rows": 200}, {"chunk": 300, "rows": 200, "numbered": 0}, {"percent": 60, "max_n": 3}, {"first": 3}])
def test_collocations_of_odd_texts(odd, sizes):
    got = sorted(map(tuple, C.collocations(odd, at_least=3, **sizes).collect()))
    want = {k: v for k, v in sizes.items() if k in ("percent", "max_n", "first")}
    assert got == brute_collocations([(r["text"], r["lang"]) for r in odd.collect()], at_least=3, **want)


@pytest.mark.parametrize("sizes", [{}, {"numbered": 0}, {"chunk": 2000, "rows": 3000}])
def test_collocations_equal_sql(spark, sizes):
    compare(spark, "/root/testdata/sf0.01", lambda s, d: C.collocations(s.read.parquet(f"{d}/documents.parquet"), **sizes), C.SQL)


def test_no_collocations(odd):
    assert C.collocations(odd.limit(0)).count() == 0 and C.collocations(odd.filter("doc_id = 2"), at_least=1).count() == 0


def test_stack_counts_prefixes_across_batches():
    rows = sorted([b"\1\2\3", b"\1\2", b"\1\2\4", b"\1\3", b"\2\2\2", b"\2\2"], reverse=True)
    for cut in range(1, len(rows)):
        stack, total = C.Stack(3, 1, 2), Counter()
        for some in (rows[:cut], rows[cut:]):
            for phrases, n in stack.push(pa.array(some, pa.binary()), np.full(len(some), 2)):
                total.update(dict(zip(phrases, n.tolist())))
        for phrases, n in stack.rest():
            total.update(dict(zip(phrases, n.tolist())))
        assert total == {b"\1\2": 6, b"\1\2\3": 2, b"\1\2\4": 2, b"\1\3": 2, b"\2\2": 4, b"\2\2\2": 2}


def test_a_hot_word_is_spread(spark):
    docs = spark.range(400).selectExpr("concat('the of w', id % 40, ' v', id % 7) as text", "'en' as lang")
    rows = [(r["text"], "en") for r in docs.collect()]
    assert sorted(map(tuple, C.collocations(docs, at_least=2, rows=50, chunk=64).collect())) == brute_collocations(rows, at_least=2)


# 12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_search(docs, items, top=10):
    docs = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in queries.items():
        found = []
        for d, c, n in docs:
            m = 25 + (75 * n * n_docs) // max(total, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "shard": 20}, {"block": 3, "shard": 50_000, "query_rows": 2}, {"top": 2, "shard": 1}])
def test_search_of_odd_texts(spark, odd, sizes):
    items = spark.createDataFrame([(1, "the THE cat", 0), (2, None, 0), (3, "", 0), (None, "sat", 0), (1, "sat w3", 0), (4, "w1 w2 w60 café x" + "x" * 299_999, 0), (5, "nowhere", 0), (6, "w1 w1 w5", 0)], "item_id long, text string, score int")
    got = sorted(map(tuple, S.ranked_search(odd, items, **sizes).collect()), key=repr)
    assert got == brute_search([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()], sizes.get("top", 10))


def test_search_with_nothing(spark, odd):
    items = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert S.ranked_search(odd.limit(0), items).count() == 0 and S.ranked_search(odd, items.limit(0)).count() == 0


def test_search_equals_sql(spark):
    where = "/root/testdata/sf0.01"
    compare(spark, where, QUERIES["op12_ranked_search"], S.SQL)
    compare(spark, where, lambda s, d: S.ranked_search(s.read.parquet(f"{d}/documents.parquet"), s.read.parquet(f"{d}/benchmark.parquet"), block=16, shard=20_000, query_rows=300), S.SQL)


def test_blocks_below_the_threshold_stay_compressed(spark):
    """Rare strong matches come first, so later blocks of the common term are skipped on their maxima."""
    texts = [f"gold gold gold common{' common' * (i < 20)}" if i < 20 else f"common filler{i} " + "pad " * 30 for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index, n, total = S.build_index(docs, block=64)
    shard = S.Shard(index.toArrow())
    weights = {}
    for term in ("gold", "common"):
        h = int(S.term_hashes([term.encode()])[0].view(np.int64)[0])
        weights[h] = math.floor(1000 * math.log((2 * n + 2) / (2 * shard.lists[h][0] + 1)))
    common = list(weights)[1]
    shard.search(list(weights.items()), 10)
    opened = {b for t, b in shard.places if t == common}
    assert len(shard.lists[common][1]) == -(-5000 // 64) and len(opened) < 5


# 13


def brute_nearest(rows, every=100, top=10, dim=None):
    good = [(i, np.asarray(v, float)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            near = sorted(((float(np.sqrt(((w - v) ** 2).sum())), j is None, j or 0, j) for b, (j, w) in enumerate(good) if b != a), key=lambda x: x[:3])
            out.append((i, [(d, j) for d, _, _, j in near[:top]]))
    return out


def by_query(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    return found


def test_nearest_of_odd_vectors(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (100, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (200, [None, 1.0]), (7, [3.0, 4.0]), (300, [0.5, 0.5]), (None, [0.4, 0.5]), (None, [0.4, 0.5]), (8, [1.0, 2.0, 3.0]), (-100, [1e30, -1e30]), (9, [1.0, 0.0])]
    table = spark.createDataFrame([(i, x, "q", 0, 0.5) for i, x in v], "vec_id long, embedding array<double>, query string, rank int, score double")
    got = by_query(P.nearest_neighbours(table))
    want = brute_nearest(v, dim=2)
    assert set(got) == {q for q, _ in want} == {0, 300, -100}
    for q, near in want:
        assert [(s, j) for s, j, _ in got[q]] == near and [r for *_, r in got[q]] == list(range(1, len(near) + 1))
    assert P.nearest_neighbours(table.limit(0)).count() == 0 and P.nearest_neighbours(table.filter("vec_id = 3")).count() == 0
    lone = by_query(P.nearest_neighbours(table.filter("vec_id in (0, 7)")))
    assert [(j, r) for _, j, r in lone[0]] == [(7, 1)]


def test_parts_are_balanced_and_the_router_learns_them():
    random = np.random.default_rng(3)
    centres = random.standard_normal((8, 16)) * 6
    points = np.concatenate([c + random.standard_normal((150, 16)) for c in centres])[random.permutation(1200)]
    graph = P.neighbours(points, points, P.DEGREE, True)
    part = P.balanced_parts(points, graph, 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(P.SLACK * 150) and (part[graph] == part[:, None]).mean() > 0.9
    router = P.fit(points, 8)
    assert router.probes <= 3


@pytest.mark.parametrize("sizes", [{}, {"part": 16, "rows": 40, "queries": 3, "every": 20}])
def test_recall_and_exact_scores(spark, sf, sizes):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()]
    got, want = by_query(P.nearest_neighbours(table, **sizes)), brute_nearest(rows, sizes.get("every", 100), dim=64)
    assert set(got) == {q for q, _ in want} and all(len(v) == 10 and [r for *_, r in v] == list(range(1, 11)) for v in got.values())
    vectors = {i: np.asarray(v, float) for i, v in rows}
    assert all(s == np.sqrt(((vectors[q] - vectors[j]) ** 2).sum()) and q != j for q, near in got.items() for s, j, _ in near)
    assert all([s for s, *_ in v] == sorted(s for s, *_ in v) for v in got.values())
    recall = np.mean([len({j for _, j, _ in got[q]} & {j for _, j in near}) / 10 for q, near in want])
    assert recall >= 0.9


def test_a_third_of_all_rows_alike(spark):
    """One vector a third of all rows: its part is met in blocks, and ties go to the smallest ids."""
    random = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else random.standard_normal(4).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = by_query(P.nearest_neighbours(table, part=64, rows=100, queries=4))
    want = brute_nearest(rows, dim=4)
    assert [j for _, j, _ in got[0]] == [3, 6, 9, 12, 15, 18, 21, 24, 27, 30]
    recall = np.mean([len({j for _, j, _ in got[q]} & {j for _, j in near}) / 10 for q, near in want])
    assert recall >= 0.9
