"""Queries of sources, sinks and the remaining scores and text forms over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import benchmarks as B
from corvane.functions import checkers as C
from corvane.functions import math_text as M
from corvane.functions import text as T
from corvane.operators import chat, corpus, reports, scoring
from corvane.plans.items import _BENCHES
from corvane.plans.registry import _CHECKS, _PACKED_SQL, _TOKENS_SQL, _packed, _shared, _tokens, _total, query, table
from corvane.sources import arrays, readers, writers
from corvane.sources.shared import written

# ------------------------------------------------------------------ sources and sinks


@query("manifest_file", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS file_idx, o_orderstatus AS source, 'https://' || o_orderkey || '.npy' AS url FROM orders")
def manifest_file(spark, sf_dir):
    """A manifest of all orders, written as text in several files and read by lines."""
    path = _shared(spark, "manifest")
    text = F.concat(F.lit("#SOURCE: "), "o_orderstatus", F.lit(" (x)\n\n# note\ns3://"), F.col("o_orderkey").cast("string"), F.lit(".npy"))
    table(spark, sf_dir, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select(text.alias("value")).write.text(path)
    return corpus.manifest(readers.manifest_lines(spark, path))


@query("token_file_scan", f"WITH {_PACKED_SQL} SELECT global_seq // 500 AS shard_id, count(*) AS n_rows, CAST(sum(list_sum(tokens)) AS BIGINT) AS token_sum, CAST(sum((global_seq % 500 + 1) * tokens[64]) AS BIGINT) AS places, true AS in_ranges FROM r GROUP BY 1")
def token_file_scan(spark, sf_dir):
    """All packed rows as an array file a shard, read back by byte ranges, several a file."""
    path, packed = _shared(spark, "tokens"), written(_packed(spark, sf_dir).select("global_seq", "tokens"), "packed")
    n = packed.count()
    arrays.write_array_shards(packed.select("tokens", *corpus.shard_place(F.col("global_seq"), 500)), path, -(-n // 500))
    rows = arrays.array_files(spark, path, suffix=".npy", range_bytes=64 * 4 * 200).withColumn("part", F.spark_partition_id())
    own = rows.withColumn("shard_id", F.regexp_extract("path", r"shard_(\d+)\.npy$", 1).cast("long")).groupBy("shard_id")
    out = own.agg(F.count("*").alias("n_rows"), F.sum(_total(F.col("tokens"))).alias("token_sum"), F.sum((F.col("at") + 1) * F.element_at("tokens", -1)).alias("places"), F.count_distinct("part").alias("parts"))
    return out.select("shard_id", "n_rows", "token_sum", "places", (F.col("parts") == F.ceil(F.col("n_rows") / 200)).alias("in_ranges"))


@query("json_scans", "SELECT c_custkey AS k, c_name AS name FROM customer")
def json_scans(spark, sf_dir):
    """JSON lines of all customers with blank ones between, and the same as an array a nation, joined."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), "c_nationkey")
    lines, lists = _shared(spark, "lines"), _shared(spark, "arrays")
    own = F.struct("k", "name")
    rows.select(F.concat(F.to_json(own), F.lit("\n")).alias("value")).write.text(lines)
    rows.groupBy("c_nationkey").agg(F.to_json(F.collect_list(own)).alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(lists)
    a, b = (f(spark, p, "k long, name string") for f, p in ((readers.json_lines, lines), (readers.json_document, lists)))
    return a.filter("k is not null").join(b.select("k", F.col("name").alias("other")), "k").filter("name = other").select("k", "name")


@query("summary_files", "SELECT 'task' || n_regionkey AS task, n_name AS label, n_nationkey * 0.01 AS em, n_nationkey AS n FROM nation WHERE n_nationkey % 2 = 0")
def summary_files(spark, sf_dir):
    """Summaries written one a file, some malformed; listed, read and named."""
    folder = _shared(spark, "summaries")
    for r in table(spark, sf_dir, "nation").collect():
        if r.n_nationkey % 2 == 0:
            writers.write_summary(spark, folder, "20240102T030405Z", f"task{r.n_regionkey}", r.n_name, "gs://m", r.n_nationkey, 5, {"em": r.n_nationkey * 0.01})
        else:
            writers.put_text(spark, f"{folder}/20240102T030405Z_task_{r.n_name}.json", "{not json")
    names = readers.listing(spark, folder, ".json", ("_task",)).select("name")
    rows = readers.summaries(spark, folder, "task string, label string, n long, metrics map<string, double>").filter("task is not null")
    return rows.join(names, rows["file_name"] == names["name"], "left_semi").select("task", "label", F.round(F.col("metrics")["em"], 6).alias("em"), "n")


@query("padded_files", f"WITH f AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents) SELECT doc_id, least(len(t), 64) AS n_real, CAST(coalesce(list_sum(t[1:64]), 0) AS BIGINT) AS id_sum FROM f")
def padded_files(spark, sf_dir):
    """Padded rows written with lengths; masks made anew on reading."""
    t = F.slice(_tokens(F.col("text")), 1, 64)
    ids, attention, _ = chat.padded(t, F.transform(t, lambda _: F.lit(1)), 64)
    path = _shared(spark, "padded")
    writers.write_padded(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", ids, attention), path)
    return readers.padded_rows(spark, path).select("doc_id", _total(F.col("attention_mask")).alias("n_real"), _total(F.col("input_ids")).alias("id_sum"))


@query("cached_tables", "SELECT n_nationkey, n_name FROM nation")
def cached_tables(spark, sf_dir):
    """Made once, found in the second tier, then in the first."""
    near, far = _shared(spark, "near"), _shared(spark, "far")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    writers.cached_in_tiers(spark, [far], lambda: nation)

    def never():
        raise AssertionError("the table is there")

    writers.cached_in_tiers(spark, [near, far], never)
    return writers.cached_in_tiers(spark, [near], never)


@query("shuffle_audit", f"WITH {_PACKED_SQL} SELECT count(*) AS n, count(*) AS n_places, count(*) AS n_sources, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS place_sum FROM r")
def shuffle_audit(spark, sf_dir):
    """The written order of a shuffle names each place and each source once."""
    n = _packed(spark, sf_dir).count()
    path = writers.write_permutation(corpus.permutation(spark, n, 42), _shared(spark, "audit"), 42)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("out_pos").alias("n_places"), F.count_distinct("src_pos").alias("n_sources"), F.sum("out_pos").alias("place_sum"))


@query("named_dataset", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def named_dataset(spark, sf_dir):
    specs = readers.Registry({"orders": {"path": f"{sf_dir}/orders.parquet", "splits": "o_orderstatus", "split": "O"}})
    return readers.dataset(spark, specs, "orders", "F").select("o_orderkey")


@query("resumed_rows", f"WITH {_PACKED_SQL} SELECT global_seq FROM r WHERE global_seq >= 1234")
def resumed_rows(spark, sf_dir):
    rows = _packed(spark, sf_dir).select("global_seq")
    return readers.from_row(rows, 1234, rows.count())


# ------------------------------------------------------------------ scores and text forms

_SCORES_SQL = "s AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 1)) AS v FROM embeddings)"


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double"), 1)).alias("v"))


@query("true_mass_means", f"WITH {_SCORES_SQL} SELECT avg(CASE WHEN list_position(v[1:6], list_max(v[1:6])) - 1 IN (0, 2) THEN 1.0 ELSE 0 END) AS mc1, round(avg((exp(v[1]) + exp(v[3])) / list_sum(list_transform(v[1:6], lambda x: exp(x)))), 9) AS mc2, count(*) AS n FROM s")
def true_mass_means(spark, sf_dir):
    mc1, mc2 = scoring.true_mass(F.slice("v", 1, 6), F.array(F.lit(0), F.lit(2)))
    rows = _scores(spark, sf_dir).select(mc1, mc2)
    return scoring.true_mass_means(rows, F.col("mc1"), F.col("mc2")).withColumn("mc2", F.round("mc2", 9))


@query("leading_mass", f"WITH {_SCORES_SQL} SELECT vec_id, round((exp(v[1]) + exp(v[2])) / list_sum(list_transform(v[1:5], lambda x: exp(x))), 9) AS mass FROM s")
def leading_mass(spark, sf_dir):
    return _scores(spark, sf_dir).select("vec_id", F.round(scoring.leading_mass(F.slice("v", 1, 5), F.lit(2)), 9).alias("mass"))


@query("masked_z_loss", f"WITH {_SCORES_SQL}, z AS (SELECT label % 3 AS part, v[label + 1] AS x, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS lse, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 1 END AS m FROM s) SELECT part, round(sum((lse - x + 1e-5 * lse * lse) * m) / greatest(sum(m), 1), 9) AS loss FROM z GROUP BY 1")
def masked_z_loss(spark, sf_dir):
    rows = _scores(spark, sf_dir).select((F.col("label") % 3).alias("part"), scoring.z_loss(F.col("v"), F.col("label")).alias("loss"), F.when(F.col("vec_id") % 4 == 0, 0).otherwise(1).alias("m"))
    return rows.groupBy("part").agg(F.round(scoring.masked_mean(F.col("loss"), F.col("m")), 9).alias("loss"))


_SOME = ["no_comma", "letter", "existence", "frequency"]


@query(
    "instruction_levels",
    f"WITH f AS (SELECT [{', '.join(f'coalesce(({_CHECKS[k][2]}), false)' for k in _SOME)}] AS l FROM (SELECT text AS v FROM documents)) SELECT avg(CASE WHEN list_bool_and(l) THEN 1.0 ELSE 0 END) AS prompt_level_strict_acc, CAST(sum(len(list_filter(l, lambda x: x))) AS DOUBLE) / sum(len(l)) AS inst_level_strict_acc, avg(CASE WHEN l[1] THEN 1.0 ELSE 0 END) AS prompt_level_loose_acc, CAST(sum(CASE WHEN l[1] THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS inst_level_loose_acc FROM f",
)
def instruction_levels(spark, sf_dir):
    flags = [C.strict(_CHECKS[k][0], F.col("text"), _CHECKS[k][1]) for k in _SOME]
    rows = table(spark, sf_dir, "documents").select(F.array(*flags).alias("strict"), F.array(flags[0]).alias("loose"))
    return scoring.instruction_accuracies(rows, F.col("strict"), F.col("loose"))


@query("reproduced", "WITH l AS (SELECT event_type AS task, max(event_id) AS e FROM events WHERE user_id BETWEEN 10 AND 19 GROUP BY 1) SELECT b.task, 'run' || x.user_id AS label, round(x.value / 100, 4) AS value FROM (VALUES ('click'), ('view'), ('error'), ('none')) b(task) LEFT JOIN l USING (task) LEFT JOIN events x ON x.event_id = l.e")
def reproduced(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("user_id between 10 and 19")
    name = F.when(F.col("event_type") == "click", "exact_match").when(F.col("event_type") == "view", "f1").otherwise("micro_acc")
    latest = rows.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("label"), F.col("event_type").alias("task"), F.col("event_id").alias("ts"), F.create_map(name, F.round(F.col("value") / 100, 4)).alias("metrics"))
    return reports.reproduced(latest, spark.createDataFrame(_BENCHES, "task string, header string, primary string, target double"), "run1")


@query("exact_matches", r"SELECT p_partkey, lower(regexp_replace(p_brand, '[!-/:-@\[-`{-~]', '', 'g')) = lower(regexp_replace(replace(p_brand || ' ' || p_size, ' ' || p_size, CASE WHEN p_size % 2 = 0 THEN '!' ELSE 'x' END), '[!-/:-@\[-`{-~]', '', 'g')) AS same FROM part")
def exact_matches(spark, sf_dir):
    pred = F.concat(F.upper("p_brand"), F.lit(" units"))
    gold = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "!").otherwise("x"))
    return table(spark, sf_dir, "part").select("p_partkey", T.exact_match(pred, gold, drop=(" units",), ignore_case=True, ignore_punct=True).alias("same"))


@query("bbh_golds", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'item ' || o_custkey ELSE 'no phrase ' || o_custkey END AS gold FROM orders")
def bbh_golds(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Think. So the answer is item "), key, F.lit(".."))).otherwise(F.concat(F.lit("no phrase "), key))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.bbh_gold(text).alias("gold"))


@query("drop_answers", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey || ' yards' WHEN 1 THEN 'team ' || o_custkey ELSE 'just ' || o_custkey END AS answer FROM orders")
def drop_answers(spark, sf_dir):
    key, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Well. The ANSWER IS: "), key, F.lit(" yards. More"))).when(k == 1, F.concat(F.lit("Therefore, team "), key, F.lit("\nend"))).otherwise(F.concat(F.lit("  just "), key, F.lit("\nrest")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.drop_answer(text).alias("answer"))


@query("final_answers", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS answer FROM orders")
def final_answers(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("So.\nFinal Answer: The final answer is "), key, F.lit(". I hope it is correct."))).otherwise(F.concat(F.lit("The answer is "), key))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.strip(T.first_match(text, M._FINAL, 1)).alias("answer"))


@query("span_golds", "SELECT p_partkey, array_to_string(list_filter([p_brand || ' ' || p_type, p_name], lambda x: x <> ''), '|') AS golds FROM part")
def span_golds(spark, sf_dir):
    spans = F.array(F.array("p_brand", "p_type"), F.array("p_name"), F.array(F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(B.list_span_answers(spans), "|").alias("golds"))


@query("sentence_counts", "SELECT n_nationkey, 3 AS n, 'Dr. ' || n_name || ' left.' AS first FROM nation")
def sentence_counts(spark, sf_dir):
    text = F.concat(F.lit("Dr. "), "n_name", F.lit(" left. It cost 3.50 at example.com! Why?"))
    found = T.sentences(text)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(found).alias("n"), found[0].alias("first"))
