"""Queries of benchmark items, samples, reports, packed rows and counters over the test tables, each with its SQL where SQL has one."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from corvane.functions import checkers as C
from corvane.functions import text as T
from corvane.operators import chat, corpus, items, reports, results, scoring
from corvane.operators.scans import numbered
from corvane.plans.registry import _PACKED_SQL, _TOKENS_SQL, _packed, _tokens, _total, query, table
from corvane.sources.shared import shared_path
from corvane.streaming.counters import in_row_order, running_counters, write_all

# ------------------------------------------------------------------ choices, scores, prompts

_CHOICES = "part_choices AS (SELECT p_partkey, CAST(p_size % 3 AS INT) AS gold, [p_brand, p_type, p_name] AS choices FROM part), "
_SCORED = _CHOICES + "x AS (SELECT p_partkey, gold, choices, CAST(unnest([0, 1, 2]) AS INT) AS choice_id FROM part_choices), s AS (SELECT p_partkey, gold, choice_id, choices[choice_id + 1] AS choice, -CAST((p_partkey * (choice_id + 3)) % 17 AS DOUBLE) - 0.5 * choice_id AS score FROM x)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).cast("int").alias("gold"), F.array("p_brand", "p_type", "p_name").alias("choices"))


def _scored(spark, sf_dir):
    docs = _items(spark, sf_dir)
    score = -((F.col("p_partkey") * (F.col("choice_id") + 3)) % 17).cast("double") - 0.5 * F.col("choice_id")
    return docs, items.choice_rows(docs, "choices").withColumn("score", score)


@query("choice_rows", f"WITH {_SCORED} SELECT p_partkey, gold, choice_id, choice, score FROM s")
def choice_rows(spark, sf_dir):
    return _scored(spark, sf_dir)[1].select("p_partkey", "gold", "choice_id", "choice", "score")


@query(
    "choice_norms",
    f"""WITH {_SCORED}, n AS (SELECT *, score / length(' ' || choice) AS norm FROM s),
b AS (SELECT p_partkey, any_value(gold) AS gold, arg_min(choice_id, -score * 1000 + choice_id) AS plain, list(norm ORDER BY choice_id) AS norms FROM n GROUP BY 1)
SELECT sum(CASE WHEN plain = gold THEN 1 ELSE 0 END) / count(*) AS acc, sum(CASE WHEN list_position(norms, list_max(norms)) - 1 = gold THEN 1 ELSE 0 END) / count(*) AS acc_norm,
 CAST(sum(CASE WHEN plain = gold THEN 1 ELSE 0 END) AS BIGINT) AS correct, CAST(sum(CASE WHEN list_position(norms, list_max(norms)) - 1 = gold THEN 1 ELSE 0 END) AS BIGINT) AS correct_norm, count(*) AS total FROM b""",
)
def choice_norms(spark, sf_dir):
    docs, scores = _scored(spark, sf_dir)
    rows = items.gathered_scores(docs, scores, "p_partkey", "choices")
    return items.choice_accuracies(rows, F.col("scores"), F.transform("choices", lambda c: F.concat(F.lit(" "), c)), F.col("gold"))


@query(
    "task_prompts",
    r"""SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'Answer:' AS qa, 'Q: ' || p_name || chr(10) || 'A: Let''s think step by step.' AS bbh, 'Problem:' || chr(10) || p_name || chr(10) || chr(10) || 'Solution:' AS math,
 'Passage: ' || p_type || chr(10) || 'Question: ' || p_name || chr(10) || 'Answer:' AS drop_, 'Q: ' || p_name || ' A:' AS popqa, 'Q: ' || p_name || chr(10) || 'A:' AS truthfulqa, ' ' || p_brand AS answer, ' so ' || p_brand AS bbh_answer,
 'Question: one?' || chr(10) || 'Answer: 1, uno' || chr(10) || chr(10) || 'Question: two?' || chr(10) || 'Answer: 2' || chr(10) || chr(10) || 'Question: ' || p_name || chr(10) || 'Answer:' AS shots FROM part""",
)
def task_prompts(spark, sf_dir):
    q, passage = F.col("p_name"), F.col("p_type")
    shots = [("one?", ["1", "uno"]), ("two?", "2"), ("three?", "3")]
    solution = F.concat(F.lit("Let's think step by step.so "), "p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", items.task_question("qa", q).alias("qa"), items.task_question("bbh", q).alias("bbh"), items.task_question("math", q).alias("math"), items.task_question("drop", passage, q).alias("drop_"), items.task_question("popqa", q).alias("popqa"),
        items.task_question("truthfulqa", q).alias("truthfulqa"), items.task_answer(F.col("p_brand")).alias("answer"), items.task_answer(solution, "bbh").alias("bbh_answer"), items.shots_prompt(q, shots, 2).alias("shots"),
    )


@query("lettered_items", "SELECT p_partkey, p_name AS question, array_to_string([p_brand, p_type, p_name], '|') AS choices, CAST(p_size % 3 AS INT) AS answer_idx, substr('ABC', CAST(p_size % 3 AS INT) + 1, 1) AS answer_text FROM part")
def lettered_items(spark, sf_dir):
    rows = items.lettered(table(spark, sf_dir, "part"), F.col("p_name"), F.array("p_brand", "p_type", "p_name"), F.col("p_size") % 3)
    return rows.select("p_partkey", "question", F.array_join("choices_text", "|").alias("choices"), "answer_idx", "answer_text")


@query(
    "left_cuts",
    f"""WITH f AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(coalesce(list_sum(t[greatest(len(t) - 100, 0) + 1 : ]), 0) AS BIGINT) AS id_sum, least(len(t), 100) - 1 AS last_idx, greatest(len(t) * 3 // 4 - greatest(len(t) - 100, 0), 0) AS target_start FROM f""",
)
def left_cuts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", _tokens(F.col("text")).alias("t"))
    ids, last = items.left_cut(F.col("t"), 100)
    context = F.slice("t", F.lit(1), F.floor(F.size("t") * 3 / 4).cast("int"))
    return rows.select("doc_id", ids, last, items.shifted_start(F.col("t"), context, 100)).select("doc_id", _total(F.col("ids")).alias("id_sum"), "last_idx", "target_start")


@query(
    "letter_logits",
    "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 1)) AS v FROM embeddings) SELECT vec_id, list_position([v[3], v[1], v[6], v[2]], list_max([v[3], v[1], v[6], v[2]])) - 1 AS best, round(v[1] * 1 + v[3] * 1, 6) + 0.0 AS masked FROM s",
)
def letter_logits(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    mask = F.transform("v", lambda _, i: F.when((i == 0) | (i == 2), 1).otherwise(0))
    return rows.select("vec_id", scoring.first_best(items.gathered(F.col("v"), [2, 0, 5, 1])).alias("best"), (F.round(items.continuation_score(F.col("v"), mask), 6) + 0.0).alias("masked"))


@query(
    "other_shots",
    "SELECT c_custkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS shots FROM customer JOIN nation ON c_nationkey <> n_nationkey GROUP BY 1",
)
def other_shots(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    out = items.other_shots(people, table(spark, sf_dir, "nation").withColumn("place", F.col("n_nationkey")), "n_nationkey", "place", "n_name")
    return out.select("c_custkey", F.array_join("shots", ",").alias("shots"))


@query("answered_shots", "SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 3")
def answered_shots(spark, sf_dir):
    golds = F.when(F.col("toxic") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return items.answered_shots(table(spark, sf_dir, "labels"), golds, "doc_id").select("doc_id")


@query("references", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, p_name, p_type, lower(p_type)])), '|') AS refs FROM part")
def references(spark, sf_dir):
    refs = items.references(F.array("p_brand", "p_type", "p_name"), F.array(F.col("p_type"), F.lower("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(refs), "|").alias("refs"))


# ------------------------------------------------------------------ predictions


@query("predicted", "SELECT o_orderkey, o_custkey, n_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def predicted(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(found.select("o_orderkey"), "o_orderkey", "left_semi")
    return items.predicted(asked, found, "o_orderkey")


@query("scored_or_zero", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL OR d.doc_id % 4 = 0 THEN 0.0 ELSE l.quality * 0.5 END AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def scored_or_zero(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("g"))).alias("golds"))
    return items.scored_or_zero(asked, table(spark, sf_dir, "labels"), F.col("quality") * 0.5, F.col("golds"), "doc_id").select("doc_id", "score")


@query("strict_and_normal", "SELECT sum(CASE WHEN lower(p_type) = lower(p_name) OR p_partkey % 5 = 0 THEN 1 ELSE 0 END) / count(*) AS exact_match, CAST(sum(CASE WHEN p_partkey % 5 = 0 AND upper(p_name) = p_name THEN 1 ELSE 0 END) AS BIGINT) AS correct_strict, count(*) AS total FROM part")
def strict_and_normal(spark, sf_dir):
    pred = F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_type"))
    return items.strict_and_normal(table(spark, sf_dir, "part"), pred, F.col("p_name"), T.exact_match(pred, F.col("p_name"), ignore_case=True))


@query("bbh_predictions", r"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'so ' || o_custkey WHEN 1 THEN '' ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS answer FROM orders")
def bbh_predictions(spark, sf_dir):
    key, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    said = F.when(k == 0, F.concat(F.lit("Think.\nthe answer is so "), key, F.lit("..\nthe answer is no."))).when(k == 1, F.lit("none of it")).otherwise(F.concat(F.lit("the answer is "), key, F.lit(".5.")))
    return table(spark, sf_dir, "orders").select("o_orderkey", items.bbh_prediction(said).alias("answer"))


@query("category_rows", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def category_rows(spark, sf_dir):
    return items.of_categories(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "3-MEDIUM"]).select("o_orderkey")


# ------------------------------------------------------------------ seeded samples (the generators' order has no SQL)


@query("sample_in_order")
def sample_in_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return items.sampled(rows, items.sample_places(rows.count(), 1000, 1234), "o_orderkey")


@query("sample_held_out")
def sample_held_out(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return items.held_out(rows, items.sample_places(rows.count(), 200, 42), "o_orderkey")


@query("shuffled_sample")
def shuffled_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return items.shuffled_sample(rows, rows.count(), 500, "o_orderkey")


# ------------------------------------------------------------------ reports

_BENCHES = [("click", "Click", "exact_match", 0.5), ("view", "View", "f1", 0.4), ("error", "Error", "macro_acc", 0.25), ("none", "None", "f1", 0.1)]
_LABELS = ["run1", "run5", "run7", "run999999"]
_LATEST_SQL = """latest AS (SELECT 'run' || user_id AS label, event_type AS task, arg_max(round(value / 100, 4), event_id) AS v, max(event_id) AS e FROM events GROUP BY ALL),
benches AS (SELECT * FROM (VALUES ('click', 'Click', 0.5), ('view', 'View', 0.4), ('error', 'Error', 0.25), ('none', 'None', 0.1)) t(task, header, target))"""


def _latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("label"), F.col("event_type").alias("task"), F.round(F.col("value") / 100, 4).alias("v"), "event_id", F.lit(0).alias("o"))
    own = results.latest(rows, ["label", "task"], "event_id", "o")
    name = F.when(F.col("task") == "click", "exact_match").when(F.col("task") == "view", "f1").otherwise("micro_acc")
    return own.select("label", "task", F.create_map(name, "v").alias("metrics"), F.col("v").alias("value"))


@query(
    "label_grid",
    f"WITH {_LATEST_SQL}, labels_ AS (SELECT unnest({_LABELS}) AS label) SELECT l.label, b.task, b.header, CAST(b.target AS DOUBLE) AS target, v AS value, coalesce(printf('%.4f', v), '—') AS shown FROM labels_ l CROSS JOIN benches b LEFT JOIN latest x ON x.label = l.label AND x.task = b.task",
)
def label_grid(spark, sf_dir):
    benches = spark.createDataFrame(_BENCHES, "task string, header string, primary string, target double")
    return reports.label_grid(_latest(spark, sf_dir), spark.createDataFrame([(x,) for x in _LABELS], "label string"), benches)


@query("target_differences", f"WITH {_LATEST_SQL} SELECT x.label, x.task, b.header, v AS value, CAST(b.target AS DOUBLE) AS target, round((v - b.target) * 100, 6) AS points FROM latest x JOIN benches b USING (task)")
def target_differences(spark, sf_dir):
    card = spark.createDataFrame(_BENCHES, "task string, header string, primary string, target double")
    return reports.target_differences(_latest(spark, sf_dir), card).withColumn("points", F.round("points", 6))


@query("task_labels", f"WITH {_LATEST_SQL} SELECT task, count(*) AS n_labels, round(sum(v), 6) AS total FROM latest GROUP BY 1")
def task_labels(spark, sf_dir):
    found = reports.task_labels(_latest(spark, sf_dir))
    return found.select("task", F.size("by_label").cast("long").alias("n_labels"), F.round(F.aggregate(F.map_values("by_label"), F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query(
    "step_pairs",
    "WITH m AS (SELECT user_id, max(round(value / 100, 4)) AS v FROM events GROUP BY 1), s AS (SELECT unnest(range(6)) AS place) SELECT CAST(place AS INT) AS place, place || 'k' AS step, a.v AS \"before\", b.v AS \"after\", coalesce(printf('%+.1f', (b.v - a.v) * 100), '—') AS delta FROM s LEFT JOIN m a ON a.user_id = place AND a.user_id % 2 = 0 LEFT JOIN m b ON b.user_id = place AND b.user_id % 3 = 0",
)
def step_pairs(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.round(F.col("value") / 100, 4)).alias("value"))
    name = lambda prefix: F.concat(F.lit(prefix), F.col("user_id").cast("string"), F.lit("k"))
    rows = m.filter("user_id % 2 = 0").select(name("stage1_").alias("label"), "value").union(m.filter("user_id % 3 = 0").select(name("midtrained_"), "value"))
    return reports.step_pairs(rows, [f"{i}k" for i in range(6)], "stage1_", "midtrained_")


@query("canonical_labels", "SELECT n_nationkey, n_nationkey % 5 IN (0, 2, 3) AS kept FROM nation")
def canonical_labels(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    label = F.when(k == 0, "stage1_1200k").when(k == 1, "stage1_1200k_fp32").when(k == 2, "midtrained_finalk").when(k == 3, "stage2_ingr3").otherwise("cache_test")
    return table(spark, sf_dir, "nation").select("n_nationkey", reports.canonical(label).alias("kept"))


@query(
    "checkpoint_labels",
    "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN n_name || '_step_10' WHEN 1 THEN 'b--' || n_name WHEN 2 THEN 'midtrain_' || n_name WHEN 3 THEN n_name ELSE n_name END AS label, CASE n_nationkey % 5 WHEN 3 THEN n_name END AS revision FROM nation",
)
def checkpoint_labels(spark, sf_dir):
    k, name = F.col("n_nationkey") % 5, F.col("n_name")
    of = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    path = F.when(k == 0, of("gs://x/", "/step_10/")).when(k == 1, of("gs://x/a--b--", "")).when(k == 2, of("gs://x/midtrained/", "//")).when(k == 3, of("org/model@", "")).otherwise(name)
    return table(spark, sf_dir, "nation").select("n_nationkey", reports.checkpoint_label(path).alias("label"), reports.split_revision(path)[1])


@query("results_rows", "SELECT 'run' || user_id AS label, printf('%.4f', max(value)) AS f1, '—' AS em, 'gs://' || user_id AS model_path FROM events WHERE event_type = 'view' GROUP BY user_id HAVING max(value) IS NOT NULL")
def results_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("v"))
    user = F.col("user_id").cast("string")
    return reports.results_table(rows.select(F.concat(F.lit("run"), user).alias("label"), F.create_map(F.lit("f1"), "v").alias("metrics"), F.concat(F.lit("gs://"), user).alias("model_path")), "f1", ["em"])


@query("summary_union", "SELECT user_id AS label, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT c_custkey FROM customer) GROUP BY 1")
def summary_union(spark, sf_dir):
    a = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("user_id").alias("label"), "value")
    return reports.all_summaries(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label"))).groupBy("label").agg(F.count("*").alias("n"))


@query("key_conflicts", "SELECT DISTINCT a.n_nationkey AS name, b.n_nationkey AS key FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def key_conflicts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    m = n.select(F.col("n_nationkey").alias("key"), "n_regionkey")
    return reports.without_exceptions(n, n.select(F.col("n_nationkey").alias("name"), "n_regionkey").join(m, "n_regionkey"), "n_nationkey")


# ------------------------------------------------------------------ packed rows, steps, shards


def _packable(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("row_id"), _tokens(F.col("text")).alias("ids"))
    part = F.explode(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / 512).cast("int")))
    rows = rows.filter(F.size("ids") > 0).select("source", "row_id", "ids", part.alias("part"))
    rows = rows.select("source", (F.col("row_id") * 1000 + F.col("part")).alias("row_id"), F.slice("ids", F.col("part") * 512 + 1, F.lit(512)).alias("ids"))
    return rows.withColumns({"loss_mask": F.transform("ids", lambda x: (x > 3).cast("int")), "len": F.size("ids")})


_PIECES_SQL = f"""t AS (SELECT source, doc_id, {_TOKENS_SQL} AS ids FROM documents), p AS (SELECT source, unnest(range(0, len(ids), 512)) AS a, ids FROM t), q AS (SELECT source, ids[a + 1 : a + 512] AS ids FROM p)"""


@query(
    "packed_rows",
    f"WITH {_PIECES_SQL} SELECT source, CAST(sum(list_sum(ids)) AS BIGINT) AS id_sum, CAST(sum(len(list_filter(ids, lambda x: x > 3))) AS BIGINT) AS n_learned, CAST(sum(len(ids) * (len(ids) - 1) // 2) AS BIGINT) AS position_sum, CAST(sum(len(ids) - 1) AS BIGINT) AS n_pairs, CAST(sum(len(list_filter(ids[2:], lambda x: x > 3))) AS BIGINT) AS n_learned_pairs FROM q GROUP BY 1",
)
def packed_rows(spark, sf_dir):
    """Sums over all packed rows, which no choice of bins changes."""
    rows = _packable(spark, sf_dir)
    packed = chat.packed_rows(chat.pack_best_fit(rows, 2048, group_col="source"), rows, 2048, group_col="source")
    s = lambda c: F.sum(_total(F.col(c)))
    inside = F.zip_with("segment_ids", F.concat(F.slice("segment_ids", 2, 2047), F.array(F.lit(-2))), lambda a, b: ((a == b) & (a >= 0)).cast("int"))
    return packed.withColumn("inside", inside).groupBy("source").agg(s("input_ids").alias("id_sum"), s("loss_mask").alias("n_learned"), s("positions").alias("position_sum"), s("inside").alias("n_pairs"), s("label_mask").alias("n_learned_pairs"))


@query("packing_statistics", f"WITH {_PIECES_SQL} SELECT source, count(*) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens, true AS few_bins FROM q GROUP BY 1")
def packing_statistics(spark, sf_dir):
    """Documents and tokens, and that best fit needs at most 11/9 of the least number of bins, and one."""
    rows = _packable(spark, sf_dir)
    found = chat.packing_statistics(chat.pack_best_fit(rows, 2048, group_col="source"), rows, 2048, group_col="source")
    return found.select("source", "n_docs", "n_tokens", (F.col("n_bins") <= F.ceil(F.col("n_tokens") / 2048) * 11 / 9 + 1).alias("few_bins"))


@query(
    "drop_counts",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
t AS (SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'A' WHEN 'user' THEN 'U' ELSE 'S' END, '' ORDER BY k) AS roles FROM c GROUP BY 1)
SELECT count(*) AS n, CAST(sum(CASE WHEN contains(roles, 'A') THEN 0 ELSE 1 END) AS BIGINT) AS n_dropped, CAST(0 AS BIGINT) AS n_truncated FROM t""",
)
def drop_counts(spark, sf_dir):
    chats = chat.messages(table(spark, sf_dir, "conversations")).select("conv_id", chat.render(F.col("messages")).alias("text"))
    return chat.drop_counts(chat.tokenize_chats(chats, lambda t: (list(t.encode("utf-32-le")[::4]), list(range(len(t)))), 1 << 24, None))


@query("micro_batches", f"WITH {_PACKED_SQL} SELECT CAST(global_seq % 16 // 4 AS INT) AS micro_batch, CAST(global_seq % 16 % 4 AS INT) AS slot, count(*) AS n FROM r WHERE global_seq // 16 < (SELECT count(*) // 16 FROM r) GROUP BY 1, 2")
def micro_batches(spark, sf_dir):
    rows = _packed(spark, sf_dir)
    return corpus.micro_batches(corpus.batches(rows, rows.count(), 16), 4, 4).groupBy("micro_batch", "slot").agg(F.count("*").alias("n"))


@query("cycled_batches", f"WITH {_PACKED_SQL}, full_ones AS (SELECT (count(*) - 700) // 16 AS full_ FROM r), c AS (SELECT unnest([0, 1, 2]) AS cycle) SELECT CAST(cycle AS INT) AS cycle, cycle * full_ + (global_seq - 700) // 16 AS batch_id, CAST((global_seq - 700) % 16 AS INT) AS pos_in_batch, global_seq FROM r, full_ones, c WHERE global_seq >= 700 AND (global_seq - 700) // 16 < full_")
def cycled_batches(spark, sf_dir):
    return corpus.cycled(_packed(spark, sf_dir), 700, 3, 16).select("cycle", "batch_id", "pos_in_batch", "global_seq")


@query("step_counters", "SELECT o_orderkey AS step, 4096 + o_orderkey * 512 * 4096 AS total_tokens, greatest(CAST(ceil(o_custkey * 1.5 / 32) AS BIGINT), 1) AS n_steps FROM orders")
def step_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), corpus.epoch_steps(F.lit(1.5), F.col("o_custkey"), 32).alias("n_steps"))
    return corpus.running_tokens(rows, "step", 512, 4096, 4096)


@query("logged_throughput", "WITH w AS (SELECT user_id, event_id, event_id - lag(event_id) OVER v AS steps, (epoch_us(ts) - lag(epoch_us(ts)) OVER v) / 1e6 AS seconds FROM events WINDOW v AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, steps, round(seconds, 6) AS seconds, round(CASE WHEN seconds > 0 THEN steps * 8 / seconds END, 6) AS tokens_per_second FROM w")
def logged_throughput(spark, sf_dir):
    out = corpus.throughput(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", 8)
    return out.select("event_id", "steps", F.round("seconds", 6).alias("seconds"), F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("streamed_throughput", "WITH w AS (SELECT user_id, event_id, event_id - lag(event_id) OVER v AS steps, (epoch_us(ts) - lag(epoch_us(ts)) OVER v) / 1e6 AS seconds FROM events WINDOW v AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, event_id * 8 AS total_tokens, steps, round(seconds, 6) AS seconds, round(CASE WHEN seconds > 0 THEN steps * 8 / seconds END, 6) AS tokens_per_second FROM w")
def streamed_throughput(spark, sf_dir):
    """The same from a stream of all events in their order, with the runs' counters as state."""
    log = numbered(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["event_id"], out="seq")
    n, out = log.count(), shared_path(spark, "counters")
    write_all(running_counters(in_row_order(log, n, n // 3 + 1, "seq"), "user_id", "event_id", "ts", 8), out, f"{out}-state")
    rows = spark.read.parquet(out)
    return rows.select(F.col("step").alias("event_id"), "total_tokens", "steps", F.round("seconds", 6).alias("seconds"), F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("underfilled_shards", f"WITH {_PACKED_SQL} SELECT global_seq // 500 AS shard_id, count(*) AS filled, least(500, (SELECT count(*) FROM r) - 500 * (global_seq // 500)) AS expected FROM r WHERE global_seq % 1000 <> 3 GROUP BY 1 HAVING count(*) <> 500 AND count(*) <> (SELECT count(*) FROM r) % 500")
def underfilled_shards(spark, sf_dir):
    """Rows that are missing, found by shard."""
    rows, (shard, row) = _packed(spark, sf_dir), corpus.shard_place(F.col("global_seq"), 500)
    return corpus.underfilled(rows.filter("global_seq % 1000 <> 3").select(shard, row), rows.count(), 500)


@query("keyed_shuffle", f"WITH {_PACKED_SQL}, n AS (SELECT count(*) AS n FROM r) SELECT unnest(range(n)) AS place FROM n")
def keyed_shuffle(spark, sf_dir):
    """Each row's place by a keyed bijection: all places, each once."""
    rows = _packed(spark, sf_dir).select("global_seq")
    return rows.select(corpus.keyed_place(F.col("global_seq"), rows.count(), 42).alias("place"))


@query("decayed_parameters", "SELECT l_orderkey, l_linenumber, l_suppkey <> 7 AS decays FROM lineitem")
def decayed_parameters(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", corpus.decayed(F.array("l_suppkey", "l_partkey"), 7).alias("decays"))


# ------------------------------------------------------------------ predicates over all documents

#: Arguments by parameter name, for applying every registered predicate to all documents.
ARGUMENTS = {
    "num_sentences": 5, "relation": "at least", "num_words": 200, "num_paragraphs": 1, "nth_paragraph": 1, "first_word": "the", "num_placeholders": 1, "postscript_marker": "P.S.", "num_bullets": 1, "num_highlights": 1, "section_spliter": "Section",
    "num_sections": 1, "keywords": ["the", "que"], "keyword": "the", "frequency": 3, "forbidden_words": ["idiot"], "letter": "e", "let_frequency": 40, "let_relation": "at least", "prompt_to_repeat": "the", "end_phrase": "the.", "capital_frequency": 5,
    "capital_relation": "at least", "min_words": 100, "max_words": 300, "N": 3, "percentage": 50, "stop_list": ["the", "a", "of", "and"], "small_n": 3, "reference_text": "the water of the house", "options": "yes/no", "word": "the", "sep": "|", "prev_response": "the water",
    "charc": "q", "keyword1": "the", "keyword2": "and", "keyword3": "of", "keyword4": "a", "keyword5": "in", "n": 1, "m": 1, "n_start": 1, "n_end": 2, "language": "en", "verbs": ["go", "write"],
}


def every_predicate(v, evaluate) -> list:
    """A column for each registered id, named by it."""
    out = []
    for name, f in sorted(C.REGISTRY.items()):
        names = [k for k, p in list(inspect.signature(f).parameters.items())[1:] if p.default is p.empty]
        arguments = {k: F.col("lang") if k == "detected" else ARGUMENTS[k] for k in names}
        out.append(evaluate(name, v, arguments).alias(name.replace(":", "_").replace("-", "_")))
    return out


@query("checkers_all")
def checkers_all(spark, sf_dir):
    """Every registered predicate, strictly, over all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", *every_predicate(F.col("text"), C.strict))


@query("named_countries", "SELECT n_nationkey, n_nationkey % 2 = 0 AS kept FROM nation")
def named_countries(spark, sf_dir):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("From France, via "), "n_name", F.lit(", to Peru."))).otherwise(F.concat(F.lit("Francesca and "), "n_name", F.lit(" and Peru, Peru")))
    return table(spark, sf_dir, "nation").select("n_nationkey", C.named_countries(text, ["France", "Peru", "Italy"], 2).alias("kept"))


@query("camel_case_variables", "SELECT n_nationkey, n_nationkey % 3 = 0 AS kept FROM nation")
def camel_case_variables(spark, sf_dir):
    k = F.col("n_nationkey")
    code = F.when(k % 3 == 0, F.concat(F.lit("myValue = len(otherList)\nfor i in range(x"), k.cast("string"), F.lit("):\n    print(i)"))).when(k % 3 == 1, F.lit("my_value = 1")).otherwise(F.lit("x = = 1"))
    return table(spark, sf_dir, "nation").select("n_nationkey", C.camel_case_variables(code).alias("kept"))


@query("reversed_words", "SELECT n_nationkey, n_nationkey % 2 = 0 AS kept FROM nation")
def reversed_words(spark, sf_dir):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.lit("Eht retaw, si 'tew' eht esuoh.")).otherwise(F.lit("the water is wet"))
    words = F.array(*map(F.lit, ["the", "water", "is", "wet", "house"]))
    return table(spark, sf_dir, "nation").select("n_nationkey", C.reversed_words(text, words).alias("kept"))
