"""Items, samples, reports, packed rows and counters against plain Python and hand-worked cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import checkers as C
from corvane.functions import text as T
from corvane.operators import chat, corpus, items, reports
from corvane.plans.items import every_predicate


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i * 3, f"r{i}") for i in range(500)], "k long, name string").repartition(4)


def test_samples_follow_the_generators(rows):
    want = random.Random(1234).sample(range(500), 60)
    got = items.sampled(rows, items.sample_places(500, 60, 1234), "k").orderBy("ordinal").collect()
    assert [r.name for r in got] == [f"r{i}" for i in want]
    left = items.held_out(rows, items.sample_places(500, 200, 42), "k").collect()
    assert {r.name for r in left} == {f"r{i}" for i in set(range(500)) - set(random.Random(42).sample(range(500), 200))}
    got = items.shuffled_sample(rows, 500, 50, "k").orderBy("ordinal").collect()
    assert [r.name for r in got] == [f"r{i}" for i in np.random.default_rng(42).permutation(500)[:50]]
    assert [r.name for r in items.shuffled_sample(rows, 500, 500, "k").orderBy("ordinal").collect()] == [f"r{i}" for i in range(500)]
    assert items.numbered(rows.limit(0), "k").count() == 0


def test_predictions_that_are_missing(spark):
    asked = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["b"])], "request_id long, golds array<string>")
    said = spark.createDataFrame([(1, "a"), (2, "x")], "request_id long, text string")
    scored = items.scored_or_zero(asked, said, F.col("text").isin("a", "b").cast("double"), F.col("golds"))
    assert sorted((r.request_id, r.score) for r in scored.collect()) == [(1, 1.0), (2, 0.0), (3, 0.0)]
    with pytest.raises(Exception, match="no prediction for 3"):
        items.predicted(asked, said).collect()
    assert items.predicted(asked.filter("request_id < 3"), said).count() == 2


def test_scores_of_choices(spark):
    docs = spark.createDataFrame([(1, ["aa", "b", "cccc"], 0), (2, [], 0), (3, ["x", "y"], 1)], "d long, choices array<string>, gold int")
    scores = spark.createDataFrame([(1, 0, -1.0), (1, 2, -3.0), (1, 1, -2.0), (3, 1, -0.5)], "d long, choice_id int, score double")
    got = {r.d: list(r.scores) for r in items.gathered_scores(docs, scores, "d", "choices").collect()}
    assert got == {1: [-1.0, -2.0, -3.0], 2: [], 3: [0.0, -0.5]}
    rows = items.gathered_scores(docs.filter("d <> 2"), scores, "d", "choices")
    out = items.choice_accuracies(rows, F.col("scores"), F.transform("choices", lambda c: F.concat(F.lit(" "), c)), F.col("gold")).first()
    assert (out.acc, out.acc_norm, out.total) == (0.5, 0.5, 2)
    assert items.choice_accuracies(rows.limit(0), F.col("scores"), F.col("choices"), F.col("gold")).first().acc == 0.0


def test_pool_without_the_own_group(spark):
    pool = spark.createDataFrame([(2, "g", "b"), (1, None, "a"), (3, "h", "c")], "o long, grp string, t string")
    out = items.other_shots(spark.createDataFrame([("g",), ("z",), (None,)], "grp string"), pool, "grp", "o", "t").collect()
    assert sorted((str(r.grp), list(r.shots)) for r in out) == [("None", ["b", "c"]), ("g", ["a", "c"]), ("z", ["a", "b", "c"])]
    with pytest.raises(Exception, match="a pool of more than 2"):
        items.other_shots(pool.select("grp"), pool, "grp", "o", "t", max_pool=2).collect()


def test_packed_rows_equal_plain_python(spark):
    rng = random.Random(9)
    texts = [[rng.randrange(1, 50) for _ in range(rng.randrange(1, 33))] for _ in range(80)]
    masks = [[rng.randrange(2) for _ in t] for t in texts]
    rows = spark.createDataFrame([(i, t, m, len(t)) for i, (t, m) in enumerate(zip(texts, masks, strict=True))], "row_id long, ids array<int>, loss_mask array<int>, len int")
    placed = chat.pack_best_fit(rows, 32)
    bins = {}
    for r in placed.orderBy("bin", "offset").collect():
        bins.setdefault(r.bin, []).append(r.row_id)
    for r in chat.packed_rows(placed, rows, 32).collect():
        own = bins[r.bin]
        ids, mask = ([x for i in own for x in of[i]] for of in (texts, masks))
        segment, position = [k for k, i in enumerate(own) for _ in texts[i]], [p for i in own for p in range(len(texts[i]))]
        pad = 32 - len(ids)
        assert r.input_ids == ids + [0] * pad and r.loss_mask == mask + [0] * pad and r.segment_ids == segment + [-1] * pad and r.positions == position + [0] * pad
        assert r.labels == (ids + [0] * pad)[1:] + [0]
        assert r.label_mask == [int(i + 1 < len(ids) and segment[i] == segment[i + 1] and mask[i + 1] == 1) for i in range(32)]
    stats = chat.packing_statistics(placed, rows, 32).first()
    assert (stats.n_docs, stats.n_bins, stats.n_tokens) == (80, len(bins), sum(map(len, texts))) and stats.utilisation == pytest.approx(stats.n_tokens / len(bins) / 32)
    with pytest.raises(Exception, match="a bin has 16"):
        chat.pack_best_fit(rows, 16).collect()


def test_keyed_places_are_a_bijection(spark):
    for n in (1, 2, 5, 64, 1000, 1025):
        places = [r[0] for r in spark.range(n).select(corpus.keyed_place(F.col("id"), n, 7)).collect()]
        assert sorted(places) == list(range(n))
    assert places != list(range(n))


def test_shards_that_are_not_whole(spark):
    rows = spark.range(25).select(F.floor(F.col("id") / 10).alias("shard_id"), (F.col("id") % 10).alias("row_in_shard"))
    assert corpus.underfilled(rows, 25, 10).count() == 0 and corpus.check_whole(rows, 25, 10) is rows
    lost = rows.filter("shard_id <> 1 or row_in_shard <> 4")
    assert [tuple(r) for r in corpus.underfilled(lost, 25, 10).collect()] == [(1, 9, 10)]
    doubled = lost.union(rows.filter("shard_id = 1 and row_in_shard = 5"))
    with pytest.raises(ValueError, match="shard 1"):
        corpus.check_whole(doubled, 25, 10)


def test_manifests():
    source = {"shuffle_policy": "none at repack", "file_order": "x", "packing": "y", "file_shuffle_seed": 3, "num_shards": 4}
    out = corpus.shuffled_manifest(corpus.check_unshuffled(source), 42, "from")
    assert out["globally_preshuffled"] and out["shuffle_seed"] == 42 and out["num_shards"] == 4 and "packing" not in out and "file_shuffle_seed" not in out
    with pytest.raises(ValueError, match="not in file order"):
        corpus.check_unshuffled({"shuffle_policy": "global"})
    assert corpus.remaining(1000, 100, 2, 30) == 770 and corpus.max_steps(50_000_000, 64, 8, 4096) == 23


def test_report(spark):
    benches = [("a", "A", "em", 0.5), ("b", "B", "f1", 0.25)]
    latest = spark.createDataFrame([("x", "a", {"em": 0.51}), ("x", "b", {"micro_acc": 0.2}), ("y", "a", {"other": 1.0}), ("z", "a", {"em": 0.9})], "label string, task string, metrics map<string, double>")
    grid = reports.label_grid(latest, spark.createDataFrame([("x",), ("y",)], "label string"), spark.createDataFrame(benches, "task string, header string, primary string, target double"))
    text = reports.comparison_report("Runs", grid, ["x", "y"], benches, {"a": 0.4, "b": None})
    assert "| ckpt | A | B |" in text and "| **target** | **0.500** | **0.250** |" in text and "| *our repro* | *0.4000* | — |" in text
    assert "| x | 0.5100 | 0.2000 |\n| y | — | — |" in text and "2/4 cells filled." in text


def test_labels_of_checkpoints(spark):
    paths = ["gs://b/midtrained/run1/step_100/", "gs://b/org--model--rev-2", "gs://b/midtrained/midtrain_x", "org/model@rev", "rev", "step_3"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(reports.checkpoint_label(F.col("p")).alias("l"), *reports.split_revision(F.col("p"))).collect()
    assert [r.l for r in got] == ["midtrain_run1_step_100", "model--rev-2", "midtrain_x", "rev", "rev", "step_3"]
    assert [(r.model, r.revision) for r in got][3:] == [("org/model", "rev"), ("rev", None), ("step_3", None)]
    labels = ["stage1_240k", "stage1_final", "midtrained_1907k", "stage2_ingr2", "main", "stage1_240k_v2", "midtrained_final", "mains"]
    kept = spark.createDataFrame([(x,) for x in labels], "l string").select(reports.canonical(F.col("l")).alias("k")).collect()
    assert [r.k for r in kept] == [True] * 5 + [False] * 3


def test_sentences_by_hand(spark):
    cases = {
        "He met Dr. Smith at 3.14 p.m. today.": ["He met Dr. Smith at 3.14 p.m. today."],
        "We use U.S. They stay. See example.com now": ["We use U.S.", "They stay.", "See example.com now"],
        "She works at Acme Inc. He does not.": ["She works at Acme Inc", "He does not."],
        'He said "Go." Then left!': ['He said "Go".', "Then left!"],
        "Wait... what? No": ["Wait...", "what?", "No"],
        "A Ph.D. and J. Doe": ["A Ph.D. and J. Doe"],
        "one\ntwo. three": ["one two.", "three"],
        "": [],
        "Really?! Yes": ["Really?", "!", "Yes"],
    }
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", T.sentences(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == list(cases.values())


def test_names_in_code():
    assert [C.camel_case(x) for x in ("", "a", "myValue2", "MyValue", "my_value", "myHTTP", "é", "x1Y")] == [True, True, True, False, False, False, True, True]
    assert C.variable_names("a = b + f(c)\nfor d in e: pass") == ["a", "b", "c", "d", "e", "f"] and C.variable_names("a = = 1") is None


def test_every_predicate_takes_any_text(spark):
    """Strict and loose forms over nulls, empties, one-word, many-line and non-Latin texts: a value for each, and loose wherever strict."""
    texts = [None, "", " ", "the", "The water.\n\nThe house!\n* one\n- two", "ÉTÉ à Paris? «Oui.»\n\n***\nP.S. fin the.", "漢字 カナ 🙂 2024-01-02", "a, b, c\n1, 2, 3", '{"a": [1]}', "x" * 3000]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "i int, text string, lang string")
    strict, loose = (rows.select("i", *every_predicate(F.col("text"), f)).orderBy("i").collect() for f in (C.strict, C.loose))
    for a, b in zip(strict, loose, strict=True):
        a, b = a.asDict(), b.asDict()
        assert None not in a.values() and None not in b.values()
        assert [k for k in a if k != "i" and a[k] and not b[k]] == []
        if not (texts[a["i"]] or "").strip():
            assert not any(v for k, v in a.items() if k != "i")
