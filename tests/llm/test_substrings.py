"""Passages of words that an earlier document has, against a table of all windows in plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import common, substrings

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length):
    least, out = {}, Counter()
    words = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    for doc, w in words:
        for i in range(len(w) - length + 1 if doc is not None else 0):
            key = tuple(w[i : i + length])
            least[key] = min(least.get(key, doc), doc)
    for doc, w in words:
        gone = set()
        for i in range(len(w) - length + 1 if doc is not None else 0):
            if least[tuple(w[i : i + length])] < doc:
                gone |= set(range(i, i + length))
        out[doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    return out


def made(length, seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "a", "été", "x y", "漢字", "end.", *(f"w{i}" for i in range(30))])
    say = lambda n: rng.choice([" ", "\n", " \t "]).join(word() for _ in range(n))
    passages = [say(length + rng.randrange(-2, 12)) for _ in range(4)]
    rows = []
    for i in rng.sample(range(1000), 70):
        parts = [say(rng.randrange(2 * length))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(passages), say(rng.randrange(length))]
        rows.append((i, " ".join(parts), "en", "s", 1))
    rows += [(2000 + k, rows[k][1], "en", "s", 1) for k in range(6)]  # exact copies
    rows += [(2100 + k, "  " + rows[k][1].replace("\n", " "), "en", "s", 1) for k in range(6)]  # the same words, other spaces
    rows += [(3000, passages[0], "en", "s", 1), (3000, passages[0] + " and more", "en", "s", 1), (3000, passages[0], "en", "s", 1)]
    rows += [(None, passages[1], "en", "s", 1), (3001, None, None, None, None), (3002, "", "en", "s", 0), (3003, " \t\n", "en", "s", 0)]
    rows += [(3004, "na " * 400, "en", "s", 1), (3005, "na " * 300, "en", "s", 1), (3006, say(length - 1), "en", "s", 1), (3007, say(6000) + " " + passages[2], "en", "s", 1)]
    return rows


@pytest.mark.parametrize("length, hot, heavy", [(12, 2_000, 1_000), (12, 1, 2), (20, 2, 1_000)])
def test_equals_all_windows(spark, monkeypatch, length, hot, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    monkeypatch.setattr(substrings, "TREE_WORDS", 500)
    rows = made(length)
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("id", "key", "digest", "spans", "ref", "base", "c1")])
    out = substrings.substring_dedup(docs, length, hot=hot)
    assert Counter(tuple(r) for r in out.collect()) == brute(rows, length)


def test_passage_in_many_unlike_texts(spark, monkeypatch):
    """One passage of 60 words in 600 otherwise unlike texts: its groups are split until none holds more than a few strings a task."""
    rng = random.Random(6)
    common = " ".join(f"c{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(40)) + f" {common} " + " ".join(f"v{i}x{k}" for k in range(40)), "en", "s", 1) for i in range(600)]
    seen, resolved = [], substrings._resolved
    monkeypatch.setattr(substrings, "_resolved", lambda rows, texts, length, level, hot, scratch: seen.append(level) or resolved(rows, texts, length, level, hot, scratch))
    out = {r.doc_id: r for r in substrings.substring_dedup(spark.createDataFrame(rows, DOC).repartition(4), hot=50).collect()}
    assert max(seen) == 2, "split twice: by a longer prefix, then into windows"
    assert out[0].n_removed == 0 and all(out[i].n_removed == 60 for i in range(1, 600))


def test_empty_table(spark):
    assert substrings.substring_dedup(spark.createDataFrame([], DOC)).count() == 0


def test_nodes_are_equal_strings():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 2, 500)
    for length in (1, 2, 3, 7, 8, 13):
        starts = np.arange(len(text) - length + 1)
        node = substrings.deep_nodes(text, starts, length)
        strings = [tuple(text[i : i + length]) for i in starts]
        assert len({*zip(strings, node.tolist(), strict=True)}) == len({*strings}) == len({*node.tolist()})
