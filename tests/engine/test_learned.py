"""Abbreviations, sentence counts and language profiles that are learned, against hand-marked texts and plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions import checkers as C
from corvane.operators import languages, sentences

#: Texts with their sentences, counted by hand.
MARKED = [
    ("Dr. Brown met Mrs. Lee. They talked.", 2),
    ("We saw Dr. Lee at St. Mary. It rained.", 2),
    ("He has tools, e.g. saws and approx. ten nails. The saws are old.", 2),
    ("Was it Dr. Brown? No! It was Mrs. Green.", 3),
    ('"It rained." He said so.', 2),
    ("The firm J. Brown opened. the rest followed", 2),
    ("It rained... and then it stopped.", 1),
    ("See page 3. of the book.", 1),
    ("They live near approx. 5.5 km away. He walks.", 2),
    ("no marks at all", 1),
    ("", 0),
    (None, 0),
    ("   \n ", 0),
]
LEARNED = ["The man met Dr. Lee and Mrs. Lee, who said it is approx. ten km, e.g. by car, and he said that they saw it rained. No one talked."] * 90 + [
    "The man was there and they were happy. He was with them in the house. It rained at night.",
    "They talked that night in the house and it rained on the car while they were happy and he said so.",
    "The car was there and no house was near, so they said. It was night and they talked as it rained.",
] * 90


def test_abbreviations_and_sentence_counts(spark):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(LEARNED + [t for t, _ in MARKED])], "doc_id long, text string")
    statistics = sentences.word_statistics(corpus).cache()
    names = {r.name for r in sentences.abbreviations(statistics).collect()}
    assert {"dr", "mrs", "e.g", "approx"} <= names and not names & {"happy", "house", "night", "rained", "talked", "car"}
    asked = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MARKED)] + [(None, "One. Two.")], "doc_id long, text string")
    got = {r.doc_id: r.n_sentences for r in sentences.sentence_counts(asked, statistics).collect()}
    assert got == {**{i: n for i, (_, n) in enumerate(MARKED)}, None: 2}
    assert sentences.sentence_counts(asked.limit(0), statistics).count() == 0
    nothing = sentences.word_statistics(asked.limit(0))
    assert {r.doc_id: r.n_sentences for r in sentences.sentence_counts(asked, nothing).collect()}[9] == 1


def test_scores_by_the_formula(spark):
    rows = [("dr", 40, 0, 0, 0), ("e.g", 9, 1, 9, 0), ("house", 50, 70, 9, 0), ("end", 5, 0, 5, 0)]
    statistics = spark.createDataFrame(rows, "name string, n_stop long, n_plain long, n_small long, n_inside long")
    stops, words = sum(r[1] for r in rows), sum(r[1] + r[2] for r in rows)
    for r in sentences.abbreviations(statistics, -math.inf).collect():
        log = lambda p: r.n_stop * math.log(p) + (r.n_plain * math.log(1 - p) if r.n_plain else 0)
        inner = r.name.count(".")
        letters = len(r.name) - inner
        want = 2 * (log(0.99) - log(stops / words)) * math.exp(-letters) * (inner + 1) * letters**-r.n_plain
        assert r.score == pytest.approx(want)


@pytest.fixture(scope="module")
def learned(spark):
    texts = [("en", "the man and the house with this thing that there was"), ("de", "der Mann und das Haus mit dem Ding das dort war"), ("fr", "l'homme et la maison avec cette chose qui était là"), (None, "zzz"), ("es", None)]
    return texts, languages.profiles(spark.createDataFrame(texts, "lang string, text string")).cache()


def test_profiles_by_plain_python(learned):
    texts, rows = learned
    want = set()
    for lang, text in texts:
        if lang and text:
            seen = Counter()
            for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower()):
                seen.update(f" {w} "[i : i + k] for k in (1, 2, 3) for i in range(len(w) + 3 - k))
            want |= {(lang, g, i) for i, g in enumerate(sorted(seen, key=lambda g: (-seen[g], g))[:300])}
    assert {tuple(r) for r in rows.collect()} == want


def test_detected_languages_serve_the_predicate(spark, learned):
    asked = spark.createDataFrame([(1, "this house and that man"), (2, "dieser Mann und das Haus"), (3, "cette maison et l'homme"), (4, "123 !"), (5, None), (6, "")], "k int, text string")
    found = asked.withColumn("detected", languages.detector(learned[1])(F.col("text")))
    rows = found.select("k", "detected", C.strict("type:translate", F.col("text"), {"language": "de", "detected": F.col("detected")}).alias("fits")).collect()
    assert {r.k: r.detected for r in rows} == {1: "en", 2: "de", 3: "fr", 4: None, 5: None, 6: None}
    assert {r.k for r in rows if r.fits} == {2, 4}
    none = languages.detector(learned[1].limit(0))
    assert asked.select(none(F.col("text")).alias("d")).filter("d is not null").count() == 0


def test_profiles_are_learned_once_and_texts_sent_whole(spark, monkeypatch):
    """The detector asks for its profiles in one query; texts reach it without their words taken apart."""
    from pyspark.sql import functions as F

    from corvane.operators import languages

    docs = spark.createDataFrame([("a", "the water and the house"), ("b", "el agua y la casa"), (None, "x")], "lang string, text string")
    learned = languages.profiles(docs)
    monkeypatch.setattr(type(learned), "count", lambda self: pytest.fail("profiles were counted first"))
    language = languages.detector(learned)
    rows = spark.createDataFrame([("THE house and",), ("la CASA",), ("123 ,",), (None,)], "text string")
    assert [r[0] for r in rows.select(language(F.col("text"))).collect()] == ["a", "b", None, None]
