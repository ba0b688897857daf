"""Queries of what is learned from the corpus (abbreviations and sentence counts, language profiles), of answers by subtask in whole texts, and of a written permutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import checkers as C
from corvane.functions import text as T
from corvane.operators import corpus, languages, sentences
from corvane.operators.scans import numbered
from corvane.plans.registry import query, table
from corvane.sources import writers
from corvane.sources.shared import shared_path, written

_CORE = r"""regexp_replace({0}, '^["''(\[{{“‘«]+|["'')\]}}”’»]+$', '', 'g')"""
_NAME = rf"regexp_replace(lower(regexp_replace({_CORE}, '[.!?,;:…]+$', '')), '^[0-9]+$', '0')"
_STOP = rf"regexp_matches({_CORE}, '(^|[^.])\.$')"
_CAPITAL = rf"substr({_CORE}, 1, 1) <> lower(substr({_CORE}, 1, 1))"


def _on(template: str, column: str) -> str:
    return template.format(column)


_STATISTICS = rf"""w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(list_prepend(NULL, ws[:-2])) AS before, unnest(ws) AS word, unnest(list_append(ws[2:], NULL)) AS after FROM w),
t AS (SELECT {_on(_NAME, "word")} AS name, {_on(_STOP, "word")} AS stop, {_on(_CAPITAL, "word")} AS capital, coalesce(regexp_matches({_on(_CORE, "before")}, '[.!?…]$'), true) AS ended FROM p),
st AS (SELECT name, count(*) FILTER (stop) AS n_stop, count(*) FILTER (NOT stop) AS n_plain, count(*) FILTER (NOT capital) AS n_small, count(*) FILTER (capital AND NOT ended) AS n_inside FROM t WHERE name <> '' GROUP BY 1),
r AS (SELECT sum(n_stop) / sum(n_stop + n_plain) AS rate FROM st),
l AS (SELECT name, n_stop, n_plain, length(replace(name, '.', '')) AS letters, length(name) - length(replace(name, '.', '')) AS inside,
 2 * (n_stop * ln(0.99) + n_plain * ln(1 - 0.99) - n_stop * ln(rate) - n_plain * ln(1 - rate)) AS ratio FROM st, r WHERE n_stop > 0),
a AS (SELECT name, n_stop, n_plain FROM l WHERE letters > 0 AND ratio * exp(-letters) * (inside + 1) * pow(CAST(letters AS DOUBLE), -n_plain) >= 0.3)"""


def _statistics(spark, sf_dir):
    return written(sentences.word_statistics(table(spark, sf_dir, "documents")), "words")


@query("abbreviations", f"WITH {_STATISTICS} SELECT name, n_stop, n_plain FROM a")
def abbreviations(spark, sf_dir):
    """What the documents themselves show to be abbreviations."""
    return sentences.abbreviations(_statistics(spark, sf_dir)).select("name", "n_stop", "n_plain")


@query(
    "learned_sentences",
    rf"""WITH {_STATISTICS}, e AS (SELECT doc_id, {_on(_NAME, "word")} AS name, {_on(_NAME, "after")} AS next, {_on(_CAPITAL, "after")} AS capital, regexp_matches({_on(_CORE, "word")}, '[!?]$') AS hard, NOT {_on(_STOP, "word")} AS stops
 FROM p WHERE after IS NOT NULL AND regexp_matches({_on(_CORE, "word")}, '[.!?…]$')),
j AS (SELECT doc_id, NOT hard AND (name IN (SELECT name FROM a) OR stops OR regexp_matches(name, '^(\p{{L}}|0)$')) AS short, capital AND next IN (SELECT name FROM st WHERE n_small > 0 AND n_inside = 0) AS opens FROM e),
c AS (SELECT doc_id, count(*) AS n FROM j WHERE NOT short OR opens GROUP BY 1),
k AS (SELECT doc_id, CAST(CASE WHEN coalesce(len(ws), 0) > 0 THEN 1 ELSE 0 END + coalesce(n, 0) AS BIGINT) AS n_sentences FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_sentences, coalesce(trim(text, chr(10) || ' ') <> '' AND n_sentences >= 20, false) AS at_least_20 FROM k JOIN documents USING (doc_id)""",
)
def learned_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = sentences.sentence_counts(docs, _statistics(spark, sf_dir))
    many = C.strict("length_constraints:number_sentences", F.col("text"), {"num_sentences": 20, "relation": "at least", "counted": F.col("n_sentences")})
    return counts.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "n_sentences", many.alias("at_least_20"))


@query(
    "response_languages",
    r"""WITH d AS (SELECT doc_id, lang, doc_id % 5 = 0 AS held_out, regexp_extract_all(lower(text), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, ' ' || unnest(ws) || ' ' AS w FROM d), wn AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2),
x AS (SELECT doc_id, w, n, unnest([1, 2, 3]) AS k FROM wn), y AS (SELECT doc_id, w, n, k, unnest(range(1, length(w) - k + 2)) AS i FROM x),
g AS (SELECT doc_id, substr(w, i, k) AS gram, sum(n) AS n FROM y GROUP BY 1, 2),
own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS place FROM g QUALIFY place <= 300),
lg AS (SELECT lang, gram, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2),
pr AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM lg QUALIFY place <= 300),
s AS (SELECT o.doc_id, l.lang, sum(CASE WHEN pr.place IS NULL THEN 300 ELSE abs(pr.place - o.place) END) AS off FROM own o CROSS JOIN (SELECT DISTINCT lang FROM pr) l LEFT JOIN pr ON pr.lang = l.lang AND pr.gram = o.gram GROUP BY 1, 2),
b AS (SELECT doc_id, lang AS detected FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY off, lang) = 1)
SELECT doc_id, held_out, detected, coalesce(trim(text, chr(10) || ' ') <> '' AND coalesce(detected = 'en', true), false) AS in_english FROM d JOIN documents USING (doc_id) LEFT JOIN b USING (doc_id)""",
)
def response_languages(spark, sf_dir):
    """Profiles are learned without every fifth document, all documents are judged, and the predicate asks for English."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.col("doc_id") % 5 == 0)
    language = languages.detector(languages.profiles(docs.filter("not held_out")))
    found = docs.withColumn("detected", language(F.col("text")))
    return found.select("doc_id", "held_out", "detected", C.strict("language:response_language", F.col("text"), {"language": "en", "detected": F.col("detected")}).alias("in_english"))


#: The subtasks with an answer in each one's form, beside those of several choices.
SUBTASKS = {
    "boolean_expressions": "True",
    "causal_judgement": "No",
    "date_understanding": "(C)",
    "disambiguation_qa": "B",
    "dyck_languages": "] ) }",
    "formal_fallacies": "invalid",
    "geometric_shapes": "(K)",
    "hyperbaton": "(A)",
    "logical_deduction_five_objects": "(E)",
    "logical_deduction_seven_objects": "(G)",
    "logical_deduction_three_objects": "(B)",
    "movie_recommendation": "(D)",
    "multistep_arithmetic_two": "-17",
    "navigate": "Yes",
    "object_counting": "12",
    "penguins_in_a_table": "**(B)**",
    "reasoning_about_colored_objects": "$(F)$",
    "ruin_names": "`(C)`",
    "salient_translation_error_detection": "(E)",
    "snarks": "(A)",
    "sports_understanding": "no",
    "temporal_sequences": "(D)",
    "tracking_shuffled_objects_five_objects": "(E)",
    "tracking_shuffled_objects_seven_objects": "(G)",
    "tracking_shuffled_objects_three_objects": "(C)",
    "web_of_lies": "yes",
    "word_sorting": "apple pear plum",
}
_PHRASES = ("So the answer is %s.", "thus the ANSWER IS %s", "Answer: %s, I think", "my answer would then be %s", "%s it is")


def _bbh_sql() -> str:
    name = "CASE doc_id % 27 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(SUBTASKS)) + " END"
    answer = "CASE doc_id % 27 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(SUBTASKS.values())) + " END"
    phrase = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{p.split('%s')[0]}' || answer || '{p.split('%s')[1]}'" for i, p in enumerate(_PHRASES)) + " ELSE '' END"
    found = []
    for k in SUBTASKS:
        pattern = T.BBH_ANSWERS.get(k, T.BBH_CHOICE)
        last = lambda p, t="t": f"regexp_extract_all({t}, '{p}', 1)[-1]"
        tries = [last((x % pattern).replace("(?id)", "(?i)")) for x in T.BBH_TEMPLATES]
        if k not in T.BBH_ANSWERS:
            tries.append(last(r"\b([A-Z])\b", r"regexp_replace(t, '[^\x00-\x7F]', 'x', 'g')"))
        found.append(rf"WHEN '{k}' THEN coalesce({', '.join([*tries, last(f'(?i)({pattern})')])}, '')")
    out = f"trim(CASE subtask {' '.join(found)} END)"
    choice = "subtask NOT IN (" + ", ".join(f"'{k}'" for k in T.BBH_ANSWERS) + ")"
    return rf"""WITH n AS (SELECT doc_id, text, {name} AS subtask, {answer} AS answer FROM documents), x AS (SELECT doc_id, subtask, text || chr(10) || {phrase} AS t FROM n),
f AS (SELECT doc_id, subtask, {out} AS found FROM x), s AS (SELECT doc_id, subtask, CASE WHEN {choice} THEN regexp_replace(found, '^\((.*)\)$', '\1') ELSE found END AS bare, {choice} AS choice FROM f)
SELECT doc_id, subtask, CASE WHEN choice AND bare <> '' THEN '(' || bare || ')' ELSE bare END AS answer FROM s"""


@query("subtask_answers", _bbh_sql())
def subtask_answers(spark, sf_dir):
    """All 27 subtasks over whole documents that end in an answer, in five wordings or none."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", pick(list(SUBTASKS)).alias("subtask"), pick(list(SUBTASKS.values())).alias("answer"))
    wording = F.coalesce(*[F.when(F.col("doc_id") % 6 == i, F.concat(F.lit(p.split("%s")[0]), "answer", F.lit(p.split("%s")[1]))) for i, p in enumerate(_PHRASES)], F.lit(""))
    return docs.select("doc_id", "subtask", T.bbh_answers(F.concat("text", F.lit("\n"), wording), F.col("subtask")).alias("answer"))


@query(
    "source_places",
    "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS src_pos, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS out_pos FROM orders) SELECT src_pos, out_pos, out_pos // 500 AS out_shard, out_pos % 500 AS out_row FROM o",
)
def source_places(spark, sf_dir):
    """Where each order lands when orders are written by date, 500 to a shard; the permutation is written and read as a table."""
    orders = numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"], out="src_pos")
    placed = numbered(orders, ["o_orderdate", "o_orderkey"], out="out_pos").select(F.col("src_pos").cast("long"), F.col("out_pos").cast("long"))
    order = spark.read.parquet(writers.write_permutation(placed, shared_path(spark, "permutation"), 42))
    return corpus.source_places(order, 500)
