"""Vector searches and URL filters against brute force, with ties, repeats, bad vectors and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import url_filter
from corvane.llm import vectors as vectors_module
from corvane.llm import vectors as searches
from corvane.llm.url_filter import build_cascade, judge_urls
from corvane.llm.vectors import BitSliced, nearest_neighbours, top_products

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, dim))).astype(np.float32)
    x[:40] = x[0]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    bad = [(9000, None, 0), (9100, [], 0), (9200, [float("nan")] * dim, 0), (9300, [None] * dim, 0), (9400, [0.0] * dim, 0), (None, [1.0] * dim, 0), (9500, [float("inf")] * dim, 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    return df.select("*", F.lit("x").alias("vec"), F.lit("y").alias("id"), F.lit(1).alias("block")), x.astype(float)


def test_nearest_neighbours(spark):
    df, x = vectors(spark)
    rows = nearest_neighbours(df).toPandas()
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        own = rows[rows.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id], atol=1e-12)
        assert sorted(zip(own.score, own.vec_id, strict=True)) == list(zip(own.score, own.vec_id, strict=True))
        hit += len(set(order) & set(own.vec_id))
        if q == 0:
            assert own.vec_id.tolist() == list(range(1, 11))
    assert hit >= 54 and set(rows.query_id) == set(range(0, 600, 100))


def test_few_vectors_are_all_found(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 90.0], 0), (2, [-50.0, 0.0], 0), (100, [1.0, 0.0], 0)], SCHEMA)
    found = sorted((r.query_id, r.rank, r.vec_id) for r in nearest_neighbours(df).collect())
    assert found == [(0, 1, 100), (0, 2, 2), (0, 3, 1), (100, 1, 0), (100, 2, 2), (100, 3, 1)]


def test_split_buckets_and_queries_find_the_same(spark, monkeypatch):
    """Buckets in parts, several to a group and queries in turns give the rows of one group; negative zeros, doubles and other lengths too."""
    df, _ = vectors(spark, 300)
    odd = [(i, [0.1, v] if i % 3 else [0.5], 0) for i, v in zip(range(10000, 10400, 20), [0.0, -0.0, 2.5, 7.0] * 5, strict=True)]
    df = df.select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, SCHEMA).select("vec_id", "embedding"))
    both = [df, df.withColumn("embedding", F.col("embedding").cast("array<double>"))]
    want = [sorted(map(tuple, nearest_neighbours(d, 20).collect())) for d in both]
    assert [r[:3] for r in want[0]] == [r[:3] for r in want[1]] and np.allclose([r[3] for r in want[0]], [r[3] for r in want[1]], atol=1e-6)
    by_length = {i: len(v) for i, v, _ in odd}
    short = [r for r in want[0] if r[0] >= 10000]
    assert {r[0] for r in short} == set(by_length) and all(by_length[r[0]] == by_length[r[2]] for r in short)
    assert len(short) == sum(min(10, list(by_length.values()).count(n) - 1) for n in by_length.values())
    monkeypatch.setattr(vectors_module, "BUCKET_ROWS", 10)
    monkeypatch.setattr(vectors_module, "GROUP_QUERIES", 2)
    assert sorted(map(tuple, nearest_neighbours(both[0], 20).collect())) == want[0]


def test_empty_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nearest_neighbours(none).count() == 0 and top_products(none).count() == 0
    assert nearest_neighbours(none).columns == ["query_id", "rank", "vec_id", "score"]


def test_top_products(spark):
    df, x = vectors(spark, 400)
    x = np.append(np.floor(256 * x), np.zeros((1, 16)), axis=0).astype(int)
    ids = [*range(400), 9400]
    rows = top_products(df).toPandas()
    for q in [*range(0, 400, 50), 9400]:
        score = x @ x[ids.index(q)]
        want = sorted((-int(s), i) for s, i in zip(score, ids, strict=True) if i != q)[:5]
        own = rows[rows.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(own.score, own.vec_id, strict=True)] == want


def test_top_products_in_batches_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=4 + i % 2).tolist(), 0) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = top_products(df, every=7).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(searches, "QUERY_BYTES", 1000)
    monkeypatch.setattr(searches, "BLOCK_QUERIES", 9)
    assert top_products(df, every=7).orderBy("query_id", "rank").collect() == whole and len(whole) == 500


def test_top_products_ranks_repeated_rows_one_by_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.standard_normal(8)], 0) for i in range(101)]
    rows += [(7, [9 * v for v in rows[0][1]], 0)] * 10 + [rows[50]]  # row 7 leads query 0; query 50 is stated twice
    own = top_products(spark.createDataFrame(rows, SCHEMA).coalesce(1)).toPandas()
    x = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v, _ in rows]
    for q in (0, 50, 100):
        pairs = sorted((-int(a @ b), j) for i, a in x if i == q for j, b in x if j != q)[:5]
        got = own[own.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == [1, 2, 3, 4, 5] and [(-s, i) for s, i in zip(got.score, got.vec_id, strict=True)] == pairs


@pytest.mark.parametrize("seed", range(4))
def test_bit_sliced_block(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (130, 5))
    ids = rng.permutation(1000)[:130]
    index = BitSliced(ids, x)
    for k in (1, 5, 200):
        q = rng.integers(-9, 9, 5)
        want = sorted((-int(v @ q), int(i)) for v, i in zip(x, ids, strict=True) if i != ids[0])[:k]
        assert sorted((-s, i) for i, s in index.top(int(ids[0]), q, k)) == want


URLS = [
    ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://x.net/a#b", "x.net", "/a", "net/", "block"), ("http://foo.net", "foo.net", "", None, "allow"),
    ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"), ("http://bexample.com/de/1", "bexample.com", "/de/1", None, "allow"), ("http://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"),
    ("http://m.spam-farm.example.org/en/", "m.spam-farm.example.org", "/en/", None, "block"), ("http://spam-farm.example.org/fr/1", "spam-farm.example.org", "/fr/1", "org/fr/", "allow"),
    (None, "", "", None, "allow"), ("nonsense", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://?x", "", "", None, "allow"), ("ftp://h.com/p://q", "h.com", "/p://q", None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    pages = pages.select("*", F.lit("x").alias("id"), F.lit("x").alias("listed"))
    rows = judge_urls(pages).orderBy("page_id").collect()
    assert [tuple(r)[1:5] for r in rows] == [u[1:] for u in URLS]
    assert judge_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 3)  # many false positives, so many levels
    keys = url_filter._hashed(spark.range(4000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("k"), (F.col("id") % 3 == 0).alias("listed")), F.col("k"), 3).cache()
    cascade = build_cascade(keys, 3)
    rows = keys.toPandas()
    assert len(cascade.levels) > 3
    assert (cascade.listed(rows.shard.to_numpy(), rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.listed.to_numpy()).all()


def test_shards_follow_both_sides(spark, monkeypatch):
    """Few listed hosts and many others: the even levels hold the others' mistakes, and no filter grows with them."""
    assert url_filter.shards_for(0, 10**12) == url_filter.shards_for(10, 10**6) == 1
    assert url_filter.shards_for(10**6, 10**10) > 50 and url_filter.shards_for(5 * 10**6, 0) > 5
    made = []
    keep = url_filter._encode
    monkeypatch.setattr(url_filter, "_encode", lambda *args: made.append(keep(*args)) or made[-1])
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 100)
    monkeypatch.setattr(url_filter, "SHARDS_AT_ONCE", 2)
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 4)
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".example/")).alias("url"))
    keys = spark.range(0, 6000, 300).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example")).alias("host"))
    got = {r.page_id for r in judge_urls(pages, listed=keys).filter("listed").collect()}
    assert got == set(range(0, 6000, 300))
    assert 5 < len({s for level in made for s in level}) <= url_filter.shards_for(20, 5980)
    assert max(len(x) for level in made for x in level.values()) <= 2 * 100 * 4 // 8


def test_hosts_of_a_table_are_listed(spark):
    """Keys beside the labels, with nulls, repeats and hosts that no page has; common and empty hosts, repeated ids and clashing columns."""
    urls = ["http://a.example/x", "https://B.example/", "ftp://c.example", None, "nothing", "http://a.example/y", "http://casino-win.example/"]
    pages = spark.createDataFrame([(i % 5, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, listed string")
    keys = spark.createDataFrame([("b.example",), ("b.example",), (None,), ("z.example",), ("",)], "host string")
    rows = judge_urls(pages, listed=keys).collect()
    assert sorted((r.host, r.listed) for r in rows) == [("", True), ("", True), ("a.example", False), ("a.example", False), ("b.example", True), ("c.example", False), ("casino-win.example", True)]
    assert judge_urls(pages, listed=keys.limit(0)).filter("listed").count() == 1
