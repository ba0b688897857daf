"""Two-level scans against plain Python."""

import random

import pytest

from corvane.operators import scans


def data(n=400):
    rng = random.Random(2)
    return [(i, rng.choice([None, "a", "a", "a", "b"]), rng.randrange(9), rng.choice([None, None, None, f"v{i}"])) for i in rng.sample(range(10 * n), n)]


KIND = "k long, g string, x long, v string"


@pytest.mark.parametrize("within", [[], ["g"]])
def test_places_and_sums(spark, within):
    rows = data()
    df = spark.createDataFrame(rows, KIND).repartition(5)
    key = (lambda r: r[1]) if within else (lambda r: 0)
    want, places, sums, last = {}, {}, {}, {}
    sizes = {g: sum(key(r) == g for r in rows) for g in {key(r) for r in rows}}
    for r in sorted(rows):
        g = key(r)
        last[g] = r[3] or last.get(g)
        want[r[0]] = (places.get(g, 0), sizes[g], sums.get(g, 0), last[g])
        places[g], sums[g] = places.get(g, 0) + 1, sums.get(g, 0) + r[2]
    got = {r.k: (r.at, r.size) for r in scans.numbered(df, ["k"], within, size="size").collect()}
    assert got == {k: w[:2] for k, w in want.items()}
    got = {r.k: (r.total, r.seen) for r in scans.running(df, ["k"], {"total": "x"}, {"seen": "v"}, within).collect()}
    assert got == {k: w[2:] for k, w in want.items()}


def test_no_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert scans.numbered(empty, ["k"]).count() == 0 and scans.running(empty, ["k"], {"t": "x"}, {"s": "v"}, ["g"]).count() == 0
