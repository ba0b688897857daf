"""Language ID by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, few, giving_back, released, unused
from corvane.llm.grams import code_points, gram_hashes

SIZES, BITS = (1, 2, 3), 15
#: Labelled texts of each language that the likelihoods are learned from, at most (expected, chosen by hash).
FIT_ROWS = 2_000
#: Tasks that count the grams of these texts, at most: their tables of a language meet in one group.
FIT_TASKS = 8
UNKNOWN = "und"
#: Log-likelihood of a gram of each size under no known language.
UNKNOWN_GRAM = (-5.0, -8.0, -9.5)
#: Neighbouring grams overlap: so many grams count as one piece of evidence, and evidence is bounded.
OVERLAP, MOST_EVIDENCE = 4.0, 200.0
#: Chance that a declared language, or the language usual for an address suffix, is the text's.
DECLARED_TRUST, SUFFIX_TRUST = 0.85, 0.7
UNKNOWN_PRIOR = 1e-3
#: Pseudo-counts with which a level of the prior leans on the level above it: domain on all, host on domain.
SMOOTHING = (20.0, 10.0)
#: Languages usual for country suffixes.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en"}


_LETTER = np.array([chr(i).isalpha() for i in range(0x3000)])


def words_alone(text: str) -> np.ndarray:
    """Code points of the words, one space around each: no digits, signs, or words with digits."""
    points = code_points(text)
    gap, digit = points <= 32, (points >= 48) & (points <= 57)
    keep = _LETTER[np.minimum(points, 0x2FFF)] | (points >= 0x3000)
    if digit.any():
        word = np.cumsum(gap)
        bad = np.zeros(word[-1] + 1, bool)
        bad[word[digit]] = True
        keep &= ~bad[word]
    spaced = np.full(len(points) + 2, 32, np.uint32)
    spaced[1:-1][keep] = points[keep]
    letters = spaced != 32
    return spaced[letters | np.append(letters[1:], False)] if letters.any() else spaced[:0]


@dataclass
class Likelihoods:
    languages: list[str]
    table: np.ndarray  # [gram size, hash, language], the last language being UNKNOWN

    def of(self, text: str | None) -> np.ndarray | None:
        """Bounded log-likelihoods; None for texts without words."""
        points = words_alone((text or "").lower())
        if len(points) < 2:
            return None
        total, n = np.zeros(self.table.shape[2]), 0
        for table, hashes in zip(self.table, gram_hashes(points, SIZES, BITS), strict=True):
            total += table[hashes].sum(0, dtype=np.float64)
            n += len(hashes)
        total -= total.max()
        return total * min(1 / OVERLAP, MOST_EVIDENCE / n)


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, data): counts of hashed grams, a row for each language and task; the texts are few, and so are the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros((len(SIZES), 1 << BITS), np.int64))
                for row, hashes in zip(own, gram_hashes(words_alone(text.lower()), SIZES, BITS), strict=True):
                    row += np.bincount(hashes, minlength=1 << BITS)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x.tobytes() for x in counts.values()], pa.binary())], ["lang", "data"])

    return sample.coalesce(FIT_TASKS).mapInArrow(released(run), "lang string, data binary")


def learn(docs: DataFrame) -> Likelihoods:
    """Multinomial gram likelihoods from a bounded share of each language's rows (text, lang), each text once; null languages and texts are left out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = known.groupBy("lang").count().select("lang", F.least(F.lit(1.0), FIT_ROWS / F.col("count")).alias("share"))
    chosen = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = known.join(F.broadcast(sizes), "lang").filter(chosen).select("text", "lang").distinct()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "data": [sum(np.frombuffer(x, np.int64) for x in pdf["data"]).tobytes()]})

    rows = sorted(_gram_counts(sample).groupBy("lang").applyInPandas(added, "lang string, data binary").collect())
    table = np.empty((len(SIZES), 1 << BITS, len(rows) + 1), np.float32)
    for k, r in enumerate(rows):
        counts = np.frombuffer(r.data, np.int64).reshape(len(SIZES), -1) + 0.2
        table[:, :, k] = np.log(counts / counts.sum(1, keepdims=True))
    table[:, :, -1] = np.array(UNKNOWN_GRAM)[:, None]
    return Likelihoods([*(r.lang for r in rows), UNKNOWN], table)


def _normal(logs: Column) -> Column:
    """Probabilities of an array of logarithms."""
    top = F.array_max(logs)
    up = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))


def with_language(docs: DataFrame, likelihoods: Likelihoods, text: Column, host: Column, domain: Column, declared: Column, suffix: Column, label: str, keep: list[str], lang_col: str = "lang", posterior_col: str = "posterior") -> DataFrame:
    """The columns ``keep`` of ``docs``, lang_col and posterior_col; one row per input row.

    Text likelihoods are computed once and written with the rows; grouped sums of
    their probabilities give counts for all rows, each domain and each host, which smooth one
    another from the top down, without the row's own share.  Null hosts and domains count as empty.
    Of languages that are equally likely the first by name counts.
    """
    spark, names = docs.sparkSession, likelihoods.languages
    held = spark.sparkContext.broadcast(likelihoods)
    n = len(names)

    @F.pandas_udf("array<double>")
    @giving_back
    def logs(texts: pd.Series) -> pd.Series:
        of = held.value.of
        return pd.Series([of(x) for x in texts], dtype=object)

    flat = F.array(*[F.lit(0.0)] * n)
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), logs(text).alias("logs"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(domain, F.lit("")).alias("domain"), declared.alias("declared"), suffix.alias("suffix"))
    rows = cut(rows, f"language-{label}")
    soft = F.when(F.col("logs").isNotNull(), _normal(F.coalesce("logs", flat)))
    sums = lambda prefix: [F.coalesce(F.sum(soft[k]), F.lit(0.0)).alias(f"{prefix}{k}") for k in range(n)]
    hosts = cut(rows.groupBy("domain", "host").agg(*sums("h")), f"hosts-{label}")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"h{k}").alias(f"d{k}") for k in range(n)])
    total = hosts.agg(*[F.coalesce(F.sum(f"h{k}"), F.lit(0.0)).alias(f"t{k}") for k in range(n)]).first()
    priors = hosts.join(domains, "domain").select("domain", "host", F.array(*[f"h{k}" for k in range(n)]).alias("h"), F.array(*[f"d{k}" for k in range(n)]).alias("d"))
    priors = few(cut(priors, f"priors-{label}"), "domain", "host", width=32 + 16 * n)
    names_known, seen = np.array(names[:-1]), np.array([float(x) for x in total])
    start = np.append(np.full(n - 1, (1 - UNKNOWN_PRIOR) / max(1, n - 1)), UNKNOWN_PRIOR)

    def given(said: pd.Series, trust: float) -> np.ndarray:
        """Chance of what was said under each language; 1 where nothing known was said."""
        out = np.ones((len(said), n))
        for k, name in enumerate(names_known):
            rows = (said == name).to_numpy(bool)
            out[rows] = (1 - trust) / max(1, n - 1)
            out[rows, k] = trust
        return out

    @giving_back
    def fuse(logs: pd.Series, host: pd.Series, domain: pd.Series, declared: pd.Series, suffix: pd.Series) -> pd.DataFrame:
        wordless = logs.isna().to_numpy()
        table = lambda xs: np.array([np.zeros(n) if x is None else np.asarray(x, float) for x in xs]).reshape(-1, n)
        x = table(logs)
        own = np.exp(x - x.max(1, keepdims=True, initial=-np.inf))
        own = own / own.sum(1, keepdims=True) * ~wordless[:, None]
        prior = np.broadcast_to(start, x.shape)
        for counts, weight in ((seen, 50.0), (table(domain), SMOOTHING[0]), (table(host), SMOOTHING[1])):
            counts = np.maximum(counts - own, 0)
            prior = (counts + weight * prior) / (counts.sum(1, keepdims=True) + weight)
        x = x + np.log(prior + 1e-12) + np.log(given(declared, DECLARED_TRUST)) + np.log(given(suffix, SUFFIX_TRUST))
        p = np.exp(x - x.max(1, keepdims=True, initial=-np.inf))
        p /= p.sum(1, keepdims=True)
        said = np.array(names, object)[p.argmax(1)] if len(p) else np.zeros(0, object)
        return pd.DataFrame({"lang": np.where(wordless, UNKNOWN, said), "posterior": np.where(wordless, None, p.max(1, initial=0))}).astype({"posterior": float})

    fused = F.pandas_udf(fuse, "lang string, posterior double").asNondeterministic()  # evaluated once, also under a filter
    out = rows.join(priors, ["domain", "host"], "left").select("row", fused("logs", "h", "d", "declared", "suffix").alias("found"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.col("found.lang").alias(lang_col), F.col("found.posterior").alias(posterior_col))


def known_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Likelihoods:
    return learn(docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")))


def document_languages(docs: DataFrame, likelihoods: Likelihoods, text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, out_cols: tuple[str, str] = ("detected", "posterior")) -> DataFrame:
    """The columns ``keep`` (all) of documents, their language and its posterior: evidence is the text, and the source as host.

    Labels only serve to learn the likelihoods.  Texts that are null or hold no letter are ``und`` with a null posterior.
    Null sources form one host; repeated rows count as often as they stand; an empty table stays empty.
    """
    none = F.lit(None).cast("string")
    return with_language(docs, likelihoods, docs[text_col], docs[source_col], F.lit("documents"), none, none, "documents", keep or docs.columns, *out_cols)


def in_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of documents in a known language, with their own columns, whatever these are named."""
    lang, posterior = unused(docs, "found_lang"), unused(docs, "found_posterior")
    found = document_languages(docs, known_languages(docs), out_cols=(lang, posterior))
    return found.filter(F.col(lang) != UNKNOWN).drop(lang, posterior)


def page_text(html: Column) -> Column:
    """The visible text of a page."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<div class=\"ad\">.*?</div>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w{1,8};", " ")


def page_languages(pages: DataFrame, likelihoods: Likelihoods, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, site, declared, detected and posterior of pages, from all four kinds of evidence; other columns are not read.

    A null url is an empty site; a null page has no text and is ``und``.
    """
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_col], F.lit("")), "://([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(pages[html_col], F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1))
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    domain = F.when(F.size(F.split(host, r"\.")) >= 2, domain).otherwise(host)
    suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[F.substring_index(host, ".", -1)]
    rows = pages.select(pages[id_col].alias(id_col), F.when(declared != "", declared).alias("declared"), host.alias("site"), page_text(pages[html_col]).alias("text"), domain.alias("under"), suffix.alias("usual"))
    return with_language(rows, likelihoods, rows["text"], rows["site"], rows["under"], rows["declared"], rows["usual"], "pages", [id_col, "site", "declared"], "detected")


def language_id(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """All documents and all pages: kind, doc_id, page_id, host, declared, detected, posterior, kept.

    Likelihoods are learned once, from the documents' labels; without any, every text is ``und``.  A row is
    kept if its language is a known one.  Each input row gives one row; ids may be null or repeated; columns of other
    names are not read; either table may be empty.
    """
    likelihoods = known_languages(docs)
    found = document_languages(docs, likelihoods, keep=["doc_id", "source"])
    sites = page_languages(pages, likelihoods)
    kept = (F.col("detected") != UNKNOWN).alias("kept")
    none = lambda kind: F.lit(None).cast(kind)
    a = found.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), none("long").alias("page_id"), F.col("source").alias("host"), none("string").alias("declared"), "detected", "posterior", kept)
    b = sites.select(F.lit("page").alias("kind"), none("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("site").alias("host"), "declared", "detected", "posterior", kept)
    return a.unionByName(b)
