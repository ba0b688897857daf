"""Source divergence against a dense sum over every kept term, with nulls, empty and long texts, repeats and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import divergence

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, documents=3, ranks=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        n[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = [t for t, c in docs[lang].items() if c >= documents]
        groups = {s: c for (x, s), c in n.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s, own in p.items():
            value = {o: sum((own[t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in p if o != s}
            above = {t: (own[t] - q[t]) ** 2 // q[t] for t in kept if groups[s][t] and own[t] > q[t]}
            for part, values, limit in (("pair", value, None), ("term", above, ranks)):
                order = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:limit]
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(order)}
    return out


def made(n=150):
    rng = random.Random(5)
    words = ["the", "The", "ÉTÉ", "été", "漢字", "a1b", "x_y", "naïve", "end.", "K", "ß"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(12)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 20, 83])]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", "de", None]), rng.choice(["a", "b", "ü", None, "hot", "hot"]), 1) for i in range(n)]
    rows += [(1, rows[1][1], "en", "a", 1), (None, "the the", "en", "a", None), (900, None, None, None, None), (901, "", "fr", "b", 0), (902, "... 12 34", "fr", "c", 9), (903, "word " * 50_000, "en", "long", 9)]
    return rows


@pytest.mark.parametrize("held", [divergence.HELD, 3])
def test_equals_the_dense_sum(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = made()
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("term", "n", "p", "q", "other", "value")])
    out = divergence.source_divergence(docs)
    assert {tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()} == brute(rows)
    assert out.count() == len(brute(rows))


def test_limits_and_ties(spark):
    rows = [(i, "aa bb cc dd" if i % 2 else "ee ff gg hh", "en", f"s{i % 2}", 1) for i in range(12)]
    out = divergence.source_divergence(spark.createDataFrame(rows, DOC), documents=6, ranks=2)
    assert {tuple(r) for r in out.collect()} == brute(rows, 6, 2)
    assert [r.item for r in out.filter("source = 's1' and part = 'term'").orderBy("rank").collect()] == ["aa", "bb"]
    none = divergence.source_divergence(spark.createDataFrame(rows, DOC), documents=7)
    assert {(r.part, r.value) for r in none.collect()} == {("pair", 0)}


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOC)).count() == 0


def test_large_counts_do_not_wrap(spark):
    share = spark.range(1).select(F.lit(20_000_000_000).alias("n"), F.lit(30_000_000_000).alias("total"), F.lit(5).alias("v"))
    assert share.select(divergence._share("n", "total", "v")).first()[0] == 1 + 10**9 * 20_000_000_001 // 30_000_000_005
