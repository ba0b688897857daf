"""Merkle manifests against a tree built in plain Python, with nulls, empty and long texts, repeats, many groups and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def tree(nodes, width):
    """The last node, and each leaf's (left, right) from below."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = p // width * width
            paths[i].append((nodes[run:p], nodes[p + 1 : run + width]))
        nodes, place = [h(*nodes[i : i + width]) for i in range(0, len(nodes), width)], [p // width for p in place]
    return nodes[0], paths


def brute(rows, width=16):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, out = {}, Counter()
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in groups[s]), key=lambda x: x[:3])
        built[s] = own, *tree([x[2] for x in own], width)
    root, tops = tree([built[s][1] for s in order], width) if order else (None, [])
    for s, top in zip(order, tops, strict=True):
        own, subroot, paths = built[s]
        for (_, _, digest, r), path in zip(own, paths, strict=True):
            doc_id, text = r[0], r[1]
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None
            at = leaf(r, text.translate(lower)) if changed else digest
            for left, right in [*path, *top]:
                at = h(*left, at, *right)
            out[doc_id, digest, subroot, root, h(*(d for a, b in [*path, *top] for d in (*a, *b))), at, at == root] += 1
    return out


def check(spark, rows, width=16):
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("key", "at", "digest", "path", "children", "id")])
    out = merkle.merkle_manifest(docs, width=width)
    assert Counter(tuple(r) for r in out.collect()) == brute(rows, width)
    return out


@pytest.mark.parametrize("width", [2, 16])
def test_equals_a_plain_tree(spark, width):
    rng = random.Random(8)
    text = lambda: rng.choice([None, "", "Some Text", "no capitals", "ÉA été 漢", "x" * 30_000])
    rows = [(i, text(), rng.choice(["en", None]), rng.choice(["hot", "hot", "b", "", None, "ü", "z"]), rng.choice([None, 3])) for i in rng.sample(range(3000), 290)]
    rows += [(9000, "One", "en", "alone", 1), (None, "Null Id", "en", "hot", 1), (None, None, None, None, None), (9001, "Same", "en", "b", 1), (9001, "Same", "en", "b", 1), (9001, "Other", "en", "b", 1)]
    rows += [(10_000 + i, f"T{i}", "en", f"s{i}", 1) for i in range(20)]
    out = check(spark, rows, width)
    bad = out.filter("not verified")
    assert bad.count() and bad.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 33])
def test_sizes_of_one_group(spark, n):
    check(spark, [(i, f"Text {i}", "en", "s", i) for i in range(n)])


def test_one_row_and_none(spark):
    row = check(spark, [(1, "Only", "en", "s", 4)]).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h()
    assert merkle.merkle_manifest(spark.createDataFrame([], DOC)).count() == 0


def test_any_change_is_found(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    out = merkle.merkle_manifest(docs, F.col("doc_id") == 7, lambda t: F.concat(t, F.lit(" ")))
    assert [r.doc_id for r in out.filter("not verified").collect()] == [7]
