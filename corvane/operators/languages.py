"""Languages of responses by rank-order profiles of letter sequences, learned from labelled texts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import BROADCAST_BYTES

LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(LETTERS)
LONGEST, RANKS = 3, 300


@lru_cache(maxsize=50_000)
def _grams(word: str, longest: int) -> tuple[str, ...]:
    padded = f" {word} "
    return tuple(padded[i : i + k] for k in range(1, longest + 1) for i in range(len(padded) - k + 1))


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, ranks: int = RANKS) -> DataFrame:
    """lang, gram, place (from 0): each language's most frequent sequences of 1 to ``longest`` letters in words with a blank on both sides.

    All labelled texts are counted; words first, by grouped sums, and then the sequences of each different word, so a
    frequent word is taken apart once.  Ties go to the smaller sequence.  Rows without language are left out.
    """
    words = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(letter_words(F.col(text_col))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit(" "), "w", F.lit(" "))
    grams = lambda k: F.when(F.length(padded) >= k, F.transform(F.sequence(F.lit(1), F.length(padded) - k + 1), lambda i: F.substring(padded, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    counted = words.select("lang", F.explode(F.concat(*[grams(k) for k in range(1, longest + 1)])).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A bare limit on the rank lets Spark keep each task's first rows only.
    placed = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    return placed.filter(F.col("rank") <= ranks).select("lang", "gram", (F.col("rank") - 1).alias("place"))


def detector(learned: DataFrame, longest: int = LONGEST, ranks: int = RANKS) -> Callable[[Column], Column]:
    """A function from a text column to its language: the profile with the smallest sum of differences in place.

    A sequence that a profile lacks counts as ``ranks`` places off; equal sums go to the first language by name; texts without letters are null.
    The profiles (at most ``ranks`` rows a language) go to each task, and raise if they are more than a broadcast may hold.
    """
    most = BROADCAST_BYTES // (8 + 16 * longest)
    rows = learned.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many languages to hand their profiles to each task")
    places: dict[str, dict[str, int]] = {}
    for r in rows:
        places.setdefault(r.lang, {})[r.gram] = r.place

    def nearest(text: str | None) -> str | None:
        seen: defaultdict[str, int] = defaultdict(int)
        for word, n in Counter(_WORD.findall(text or "")).items():
            for g in _grams(word, longest):
                seen[g] += n
        # Ties stand at the last rank kept: only what is as frequent as that is put in order.
        least = sorted(seen.values(), reverse=True)[ranks - 1] if len(seen) > ranks else 0
        own = sorted((g for g, n in seen.items() if n >= least), key=lambda g: (-seen[g], g))[:ranks]
        off = {lang: sum(abs(there[g] - i) if g in there else ranks for i, g in enumerate(own)) for lang, there in places.items()}
        return min(off, key=lambda lang: (off[lang], lang)) if own and off else None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([nearest(t) for t in texts], dtype=object)

    return lambda text: run(F.lower(text))
