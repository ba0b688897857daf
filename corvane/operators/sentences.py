"""Sentence counts with abbreviations learned from the corpus: likelihood ratios over grouped counts, no word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import BROADCAST_BYTES, written

WORD = r"[^\x20\x09-\x0D]+"
#: Signs that open or close a word without being part of it, and signs that end one.
OPENING, CLOSING, ENDING = r"""["'(\[{“‘«]""", r"""["')\]}”’»]""", r"[.!?,;:…]"
#: Smallest score of an abbreviation, and the chance of a full stop after one (Kiss and Strunk, 2006).
THRESHOLD, STOPPED = 0.3, 0.99


def _core(word: Column) -> Column:
    return F.regexp_replace(word, f"^{OPENING}+|{CLOSING}+$", "")


def _name(word: Column) -> Column:
    """A word in lower case without the signs around it; all whole numbers have one name."""
    return F.regexp_replace(F.lower(F.regexp_replace(_core(word), f"{ENDING}+$", "")), "^[0-9]+$", "0")


def _one_stop(word: Column) -> Column:
    return _core(word).rlike(r"(?:^|[^.])\.$")


def _capital(word: Column) -> Column:
    first = F.substring(_core(word), 1, 1)
    return first != F.lower(first)


def word_places(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """A row for each word: ``keep``, before, word, after (null at the text's ends); null texts have none."""
    words = F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))
    places = docs.select(*keep, words.alias("__words")).select(*keep, F.explode(F.transform("__words", lambda w, i: F.struct(F.get("__words", i - 1).alias("before"), w.alias("word"), F.get("__words", i + 1).alias("after")))).alias("__p"))
    return places.select(*keep, "__p.before", "__p.word", "__p.after")


def word_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Of each word's name: n_stop and n_plain (with and without one full stop behind it), n_small, and n_inside (capitals not behind an end of a sentence).

    One grouped sum over all words, combined before the shuffle, so a common word is one row a task.
    """
    ended = F.coalesce(_core(F.col("before")).rlike(r"[.!?…]$"), F.lit(True))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    places = word_places(docs, text_col).select(_name(F.col("word")).alias("name"), _one_stop(F.col("word")).alias("stop"), _capital(F.col("word")).alias("capital"), ended.alias("ended"))
    return places.filter("name <> ''").groupBy("name").agg(one(F.col("stop")).alias("n_stop"), one(~F.col("stop")).alias("n_plain"), one(~F.col("capital")).alias("n_small"), one(F.col("capital") & ~F.col("ended")).alias("n_inside"))


def abbreviations(statistics: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Names of ``word_statistics`` whose full stop belongs to them: name, n_stop, n_plain, score.

    The score is Dunning's likelihood ratio of "the stop nearly always follows" to "it follows as after any word", weighted by
    shortness, by full stops inside, and against names that also stand without one.
    """
    stops, words = statistics.agg(F.sum("n_stop"), F.sum(F.col("n_stop") + F.col("n_plain"))).first()
    rate = F.lit((stops or 0) / (words or 1))
    chance = lambda p: F.col("n_stop") * F.log(p) + F.when(F.col("n_plain") > 0, F.col("n_plain") * F.log(1 - p)).otherwise(0.0)
    inner = F.length("name") - F.length(F.replace("name", F.lit("."), F.lit("")))
    letters = F.length("name") - inner
    ratio = 2 * (chance(F.lit(STOPPED)) - chance(rate))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("n_plain").cast("double"))
    return statistics.filter((F.col("n_stop") > 0) & (letters > 0)).select("name", "n_stop", "n_plain", score.alias("score")).filter(F.col("score") >= threshold)


def _light(rows: DataFrame) -> DataFrame:
    """``rows`` (name), written, and broadcast if they are few."""
    rows = written(rows, "names")
    size = rows.agg(F.sum(F.length("name") * 4 + 64)).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def sentence_counts(docs: DataFrame, statistics: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, n_sentences of each id: ends of sentences inside its texts, and one more; 0 for null and wordless texts.

    ``!``, ``?`` and a full stop end a sentence.  The full stop of a learned abbreviation, an initial or a whole number, and a row of stops, do
    only before a capitalized word that the corpus also has in small letters and never capitalizes inside sentences.
    Texts are cut at words alone, so a mark inside a word ends nothing.  Rows of one id are counted together; null is an id.
    ``statistics`` may come from another, larger corpus; it is read twice, so hand it over written.
    """
    short = _light(abbreviations(statistics, threshold).select("name"))
    opening = _light(statistics.filter("n_small > 0 and n_inside = 0").select("name"))
    core = _core(F.col("word"))
    ends = word_places(docs, text_col, id_col).filter(F.col("after").isNotNull() & core.rlike(r"[.!?…]$"))
    ends = ends.select(F.col(id_col).alias("id"), _name(F.col("word")).alias("name"), _name(F.col("after")).alias("next"), _capital(F.col("after")).alias("capital"), core.rlike(r"[!?]$").alias("hard"), (~_one_stop(F.col("word"))).alias("row"))
    ends = ends.groupBy("id", "name", "next", "capital", "hard", "row").agg(F.count(F.lit(1)).alias("n"))
    is_short = F.col("s.name").isNotNull() | F.col("x.row") | F.col("x.name").rlike(r"^(?:\p{L}|0)$")
    judged = ends.alias("x").join(short.alias("s"), F.col("x.name") == F.col("s.name"), "left").select("x.*", (is_short & ~F.col("x.hard")).alias("short"))
    sure, asked = judged.filter("not short"), judged.filter("short and capital")
    sure = sure.select("id", "n").unionByName(asked.alias("x").join(opening.alias("o"), F.col("x.next") == F.col("o.name"), "left_semi").select("id", "n"))
    own = docs.select(F.col(id_col).alias("id"), F.when(F.regexp_like(text_col, F.lit(WORD)), 1).otherwise(0).cast("long").alias("n"))
    return own.unionByName(sure).groupBy("id").agg(F.sum("n").alias("n_sentences")).withColumnRenamed("id", id_col)
