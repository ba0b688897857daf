"""Divergence of sources within a language: exact sums over all kept terms, from supports alone."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import Scratch, few, released

#: A term is a run of ASCII letters and non-ASCII characters; every other byte is a gap, and A-Z become a-z.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms (of one group each) that a task counts before it hands them on.
HELD = 300_000
#: Documents of a language that a kept term occurs in at least, and ranks of the term part.
DOCUMENTS, RANKS = 3, 200
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a task's share; a group's own row has the empty term."""
    groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

    def handed() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in groups.items():
            for column, values in zip(columns, ([lang] * (len(n) + 1), [source] * (len(n) + 1), [b"", *n], [0, *n.values()], [0, *(docs[t] for t in n)]), strict=True):
                column.extend(values)
        kinds = [pa.binary()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            terms = text.translate(_TERM).split()
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held > HELD:
                yield handed()
                groups.clear()
                held = 0
    if groups:
        yield handed()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it); each (lang, source) also has a row of the empty term, with zeros.

    Null values are empty, and every row counts as a document of its own.
    """
    own = [F.coalesce(docs[c].cast("string"), F.lit("")).cast("binary").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*own).mapInArrow(released(_counted), _COUNTS.replace("string", "binary"))
    return rows.groupBy(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term"))).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, v: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + v)), in decimals, which hold any count; null without terms."""
    return F.expr(f"1 + (CAST({n} + 1 AS DECIMAL(20, 0)) * CAST(1000000000 AS DECIMAL(10, 0))) DIV CAST(nullif({total} + {v}, 0) AS DECIMAL(20, 0))")


def _price(p: str, q: str) -> str:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1, so that a long holds the square."""
    return f"(({p} - {q}) * ({p} - {q}) DIV {q})"


def source_divergence(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How far a language's sources differ in their terms: lang, source, part, item, value, rank.

    Part ``pair`` prices every other source of the language over all kept terms, part ``term`` the ``ranks`` terms that the source
    has most more often than its language.  A pair's sum is taken by inclusion and exclusion over supports: each group's histogram of
    counts, against the other's price of a count of zero, gives the terms that one of the two has; a join of postings
    corrects those that both have; what neither has costs a constant.  No group is ever filled up with zeros.

    The postings of a term are one row a source, so that a term's pairs are at most the pairs of sources, which the result holds anyway.
    Null values are empty; every row is a document, repeated ids and rows too; texts are read whole; a language without kept
    terms has pairs of value 0; ties go to the item first in UTF-8 order; other columns are not read; an empty table gives no rows.
    Sums that a long cannot hold raise.  The intermediate tables stay in the shared folder, as the result reads them.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.cut(term_counts(docs, lang_col, source_col, text_col), "divergence-counts")
    by_term = Window.partitionBy("lang", "term")
    postings = counts.filter("term <> ''").withColumns({"lang_n": F.sum("n").over(by_term), "lang_docs": F.sum("docs").over(by_term), "one": F.row_number().over(by_term.orderBy("source")) == 1})
    postings = scratch.cut(postings.filter(F.col("lang_docs") >= documents).select("lang", "term", "source", "n", "lang_n", "one"), "divergence-postings")

    langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("one").cast("long")).alias("v"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = counts.filter("term = ''").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0)
    groups = scratch.cut(groups.withColumn("p0", _share("0", "total", "v")), "divergence-groups")
    facts = few(groups, "lang", "source", width=40)

    shares = postings.join(facts, ["lang", "source"]).select("lang", "source", "term", "p0", _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q"))
    others = few(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0")), "lang", "other", width=8)

    zero = groups.join(others, "lang").filter("source <> other").select("lang", "source", "other", F.expr(f"coalesce((v - support) * {_price('p0', 'other_p0')}, 0)").alias("value"))
    less = groups.join(others, "lang").filter("source <> other").select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.expr(f"coalesce(-support * {_price('other_p0', 'p0')}, 0)").alias("value"))
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("h"))
    sides = histogram.join(others, "lang").filter("source <> other")
    mine = sides.select("lang", "source", "other", F.expr(f"h * {_price('p', 'other_p0')}").alias("value"))
    theirs = sides.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.expr(f"h * {_price('other_p0', 'p')}").alias("value"))
    a, b = (shares.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"{x}p"), F.col("p0").alias(f"{x}0")) for s, x in (("source", "a"), ("other", "b")))
    both = a.join(b, ["lang", "term"]).filter("source <> other")
    both = both.select("lang", "source", "other", F.expr(f"{_price('ap', 'bp')} - {_price('ap', 'b0')} - {_price('a0', 'bp')} + {_price('a0', 'b0')}").alias("value"))
    parts = [x.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")) for x in (zero, less, mine, theirs, both)]
    pairs = parts[0]
    for x in parts[1:]:
        pairs = pairs.unionByName(x)
    pairs = pairs.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_price("p", "q")).alias("value"))
    return pairs.unionByName(above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= ranks))


#: The same by brute force: every group has every kept term, with zeros.
DIVERGENCE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 g AS (SELECT DISTINCT lang, source FROM d),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
 o AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
 f AS (SELECT g.lang, g.source, k.term, CAST(coalesce(o.n, 0) AS HUGEINT) AS n, k.n AS lang_n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
 s AS (SELECT f.*, l.total, l.v, sum(f.n) OVER (PARTITION BY f.lang, f.source) AS own FROM f JOIN l ON l.lang = f.lang),
 p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // CAST(own + v AS HUGEINT) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 1)) // CAST(total + v AS HUGEINT) AS q FROM s),
 x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
 z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM y)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 200"""
