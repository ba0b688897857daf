"""All queries of the engine's operators over the test tables, by name, each with its SQL where SQL has one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import checkers as C
from corvane.functions import text as T
from corvane.operators import chat, corpus, results, scoring
from corvane.sources import readers
from corvane.sources.shared import shared_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Tables whose queries spend their time on texts or on many expressions a row.
_HEAVY = ("documents", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return readers.spread(rows) if name in _HEAVY else rows


# Tokens of a document, for queries: its words' lengths.
_TOKENS_SQL = r"list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x: CAST(length(x) AS INT))"


def _tokens(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: F.length(x))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, b: a + b)


# ---------------------------------------------------------------- corpus


@query(
    "manifest",
    """WITH l AS (SELECT doc_id AS n, CASE WHEN doc_id % 7 = 3 THEN '#SOURCE: ' || source || ' extra' WHEN doc_id % 3 = 0 THEN 's3://corpus/' || doc_id || '.npy' ELSE '# note' END AS line FROM documents),
s AS (SELECT n, line, last_value(CASE WHEN line LIKE '#SOURCE:%' THEN regexp_extract(line, '#SOURCE:\\s*(\\S+)', 1) END IGNORE NULLS) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS src FROM l)
SELECT row_number() OVER (ORDER BY n) - 1 AS file_idx, coalesce(src, 'unknown') AS source, replace(line, 's3://', 'https://') AS url FROM s WHERE line LIKE 's3://%'""",
)
def manifest(spark, sf_dir):
    line = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("#SOURCE: "), "source", F.lit(" extra"))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("s3://corpus/"), F.col("doc_id").cast("string"), F.lit(".npy"))).otherwise(F.lit("# note"))
    return corpus.manifest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), line.alias("line")))


def _packed(spark, sf_dir, length=64, max_tokens=None):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_idx"), _tokens(F.col("text")).alias("tokens"))
    return corpus.pack_fixed(docs, length, max_tokens)


_PACKED_SQL = f"""f AS (SELECT doc_id AS file_idx, {_TOKENS_SQL} AS tokens FROM documents),
p AS (SELECT file_idx, CAST(unnest(range(len(tokens) // 64)) AS INT) AS seq_in_file, tokens FROM f WHERE len(tokens) >= 64),
r AS (SELECT file_idx, seq_in_file, row_number() OVER (ORDER BY file_idx, seq_in_file) - 1 AS global_seq, tokens[seq_in_file * 64 + 1 : seq_in_file * 64 + 64] AS tokens FROM p)"""


@query("fixed_packing", f"WITH {_PACKED_SQL} SELECT file_idx, seq_in_file, global_seq, CAST(list_sum(tokens) AS BIGINT) AS token_sum FROM r")
def fixed_packing(spark, sf_dir):
    return _packed(spark, sf_dir).select("file_idx", "seq_in_file", "global_seq", _total(F.col("tokens")).alias("token_sum"))


@query("shards", f"WITH {_PACKED_SQL} SELECT global_seq // 500 AS shard_id, count(*) AS n_rows, max(global_seq % 500) AS last_row FROM r GROUP BY 1")
def shards(spark, sf_dir):
    shard, row = corpus.shard_place(F.col("global_seq"), 500)
    return _packed(spark, sf_dir).select(shard, row).groupBy("shard_id").agg(F.count("*").alias("n_rows"), F.max("row_in_shard").alias("last_row"))


@query("global_shuffle")
def global_shuffle(spark, sf_dir):
    """The rows of the baked shards, as they stand in their files."""
    rows = written(_packed(spark, sf_dir), "packed")
    n = rows.count()
    baked = corpus.bake(corpus.shuffle_globally(rows, n, 42, 500), shared_path(spark, "baked"), n, 500)
    return baked.select("out_pos", "global_seq", "shard_id", "row_in_shard")


@query("baked_shards", f"WITH {_PACKED_SQL} SELECT s AS shard_id, least(500, n - 500 * s) AS n_rows, true AS in_order FROM (SELECT count(*) AS n, unnest(range((count(*) + 499) // 500)) AS s FROM r)")
def baked_shards(spark, sf_dir):
    """Every shard is filled, and its file's rows stand in their order."""
    rows = written(_packed(spark, sf_dir).select("global_seq"), "packed")
    n = rows.count()
    baked = corpus.bake(corpus.shuffle_globally(rows, n, 42, 500), shared_path(spark, "baked"), n, 500, 7)
    place = baked.select("shard_id", "row_in_shard", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    step = F.lag("at").over(Window.partitionBy("file").orderBy("row_in_shard"))
    return place.withColumn("rises", F.coalesce(F.col("at") == step + 1, F.lit(True))).groupBy("shard_id").agg(F.count("*").alias("n_rows"), F.min("rises").alias("in_order"))


@query(
    "periodic_runs",
    f"""WITH f AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents),
q AS (SELECT doc_id, t, unnest(range(1, 14)) AS p FROM f), e AS (SELECT doc_id, p, t, unnest(range(p, len(t))) AS i FROM q WHERE len(t) >= 3 * p),
s AS (SELECT doc_id, p, i, t[i + 1] = t[i + 1 - p] AS same FROM e),
g AS (SELECT doc_id, p, i, same, i - row_number() OVER (PARTITION BY doc_id, p, same ORDER BY i) AS island FROM s),
c AS (SELECT doc_id, p, min(i) - p AS a, max(i) + 1 AS b FROM g WHERE same GROUP BY doc_id, p, island)
SELECT doc_id, CAST(a AS INT) AS start, CAST(b AS INT) AS "end", CAST(p AS INT) AS period, CAST((b - a) // p AS INT) AS times FROM c WHERE (b - a) // p > 2""",
)
def periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", _tokens(F.col("text")).alias("tokens"))
    return corpus.periodic_runs(docs, "doc_id")


@query(
    "repetition_filter",
    f"""WITH f AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents),
q AS (SELECT doc_id, t, unnest(range(1, 5)) AS p FROM f), e AS (SELECT doc_id, p, t, unnest(range(p, len(t))) AS i FROM q WHERE len(t) >= 3 * p),
s AS (SELECT doc_id, p, i, t[i + 1] = t[i + 1 - p] AS same FROM e),
g AS (SELECT doc_id, p, i, same, i - row_number() OVER (PARTITION BY doc_id, p, same ORDER BY i) AS island FROM s),
c AS (SELECT doc_id, p, count(*) AS run FROM g WHERE same GROUP BY doc_id, p, island)
SELECT d.doc_id, NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.run >= 4 * p) AS kept FROM documents d""",
)
def repetition_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("tokens", _tokens(F.col("text")))
    return docs.select("doc_id", (~corpus.repeats_too_much(F.col("tokens"), 4, 1, 5)).alias("kept"))


@query("batches", f"WITH {_PACKED_SQL} SELECT global_seq // 16 AS batch_id, count(*) AS n, min(global_seq) AS first_seq FROM r WHERE global_seq // 16 < (SELECT count(*) // 16 FROM r) GROUP BY 1")
def batch_sizes(spark, sf_dir):
    rows = _packed(spark, sf_dir)
    return corpus.batches(rows, rows.count(), 16).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("global_seq").alias("first_seq"))


@query("resume_row", "WITH v AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_type <> 'error') SELECT event_id + 1 AS resume_at FROM v WHERE k = 500")
def resume_row(spark, sf_dir):
    return corpus.resume_row(table(spark, sf_dir, "events").filter("event_type <> 'error'"), 500, "event_id")


@query("resumed_stream", f"WITH {_PACKED_SQL} SELECT global_seq, file_idx FROM r WHERE global_seq >= 700")
def resumed_stream(spark, sf_dir):
    return _packed(spark, sf_dir).filter("global_seq >= 700").select("global_seq", "file_idx")


@query("epoch_batches")
def epoch_batches(spark, sf_dir):
    """Two epochs of all packed rows in seeded batches: the tokens of each step."""
    rows = written(_packed(spark, sf_dir), "packed")
    n = rows.count()
    order = corpus.epoch_order(spark, n, 16, 2 * (n // 16), 7)
    tokens = rows.select(F.col("global_seq").alias("row_id"), _total(F.col("tokens")).alias("total"))
    return order.join(tokens, "row_id").groupBy("step").agg(F.count("*").alias("n"), F.sum("total").alias("token_sum"), F.sum((F.col("slot") + 1) * F.col("row_id")).alias("places"))


# ---------------------------------------------------------------- chats


@query(
    "chat_render",
    r"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
t AS (SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '<|system|>' || chr(10) || coalesce(text, '') || chr(10) WHEN 'user' THEN '<|user|>' || chr(10) || coalesce(text, '') || chr(10)
 WHEN 'assistant' THEN '<|assistant|>' || chr(10) || coalesce(text, '') || '<|endoftext|>' || CASE WHEN back > 1 THEN chr(10) ELSE '' END ELSE '' END, '' ORDER BY turn) AS s FROM c GROUP BY conv_id)
SELECT conv_id, length('<|endoftext|>' || s) AS n_chars, sha256('<|endoftext|>' || s) AS digest FROM t""",
)
def chat_render(spark, sf_dir):
    chats = chat.messages(table(spark, sf_dir, "conversations")).select("conv_id", chat.render(F.col("messages")).alias("s"))
    return chats.select("conv_id", F.length("s").cast("long").alias("n_chars"), F.sha2("s", 256).alias("digest"))


@query("chat_tokens")
def chat_tokens(spark, sf_dir):
    """Bytes as tokens: any tokenizer with character offsets fits here."""
    chats = chat.messages(table(spark, sf_dir, "conversations")).select("conv_id", chat.render(F.col("messages")).alias("text"))

    def encode(text: str) -> tuple[list[int], list[int]]:
        return [ord(c) % 1000 for c in text], list(range(len(text)))

    out = chat.tokenize_chats(chats, encode, 4096, None)
    return out.filter("not dropped").select("conv_id", F.size("ids").alias("n"), _total(F.col("loss_mask")).alias("n_learned"), "truncated")


@query(
    "padded_rows",
    f"""WITH f AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents)
SELECT doc_id, least(len(t), 128) AS n_real, 128 AS n_padded, CAST(coalesce(list_sum(t[1:128]), 0) AS BIGINT) AS token_sum, len(t) > 128 AS truncated FROM f""",
)
def padded_rows(spark, sf_dir):
    t = _tokens(F.col("text"))
    ids, attention, _ = chat.padded(F.slice("t", 1, 128), F.transform(F.slice("t", 1, 128), lambda _: F.lit(1)), 128)
    rows = table(spark, sf_dir, "documents").withColumn("t", t).select("doc_id", "t", ids, attention)
    return rows.select("doc_id", _total(F.col("attention_mask")).alias("n_real"), F.size("input_ids").alias("n_padded"), _total(F.col("input_ids")).alias("token_sum"), (F.size("t") > 128).alias("truncated"))


@query(
    "best_fit_packing",
    f"""WITH RECURSIVE f AS (SELECT doc_id, len({_TOKENS_SQL}) AS n FROM documents),
p AS (SELECT doc_id || '-' || piece AS row_id, least(n - piece * 2048, 2048) AS len FROM (SELECT doc_id, n, unnest(range((n + 2047) // 2048)) AS piece FROM f)),
o AS (SELECT row_number() OVER (ORDER BY len DESC, row_id) AS k, row_id, len FROM p), a AS (SELECT list(len ORDER BY k) AS lens FROM o),
s AS (SELECT 0 AS k, CAST([] AS BIGINT[]) AS rooms, CAST(0 AS BIGINT) AS bin, CAST(0 AS BIGINT) AS off
 UNION ALL SELECT k + 1, CASE WHEN b IS NULL THEN list_append(rooms, 2048 - l) ELSE list_concat(list_append(rooms[1:b], rooms[b + 1] - l), rooms[b + 2:]) END, coalesce(b, len(rooms)), CASE WHEN b IS NULL THEN 0 ELSE 2048 - rooms[b + 1] END
 FROM (SELECT s.k, s.rooms, a.lens[s.k + 1] AS l, list_min(list_filter(list_transform(range(len(s.rooms)), lambda i: CASE WHEN s.rooms[i + 1] > 0 AND s.rooms[i + 1] >= a.lens[s.k + 1] THEN s.rooms[i + 1] * 1000000000 + i END), lambda x: x IS NOT NULL)) % 1000000000 AS b FROM s, a WHERE s.k < len(a.lens)))
SELECT row_id, bin, CAST(off AS INT) AS "offset", CAST(row_number() OVER (PARTITION BY bin ORDER BY k) - 1 AS INT) AS segment FROM s JOIN o USING (k)""",
)
def best_fit_packing(spark, sf_dir):
    """All documents as one group, in pieces of at most a bin: a longer one gives several."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(_tokens(F.col("text"))).alias("n")).filter("n > 0")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 2048).cast("int"))))
    pieces = rows.select(F.concat_ws("-", "doc_id", "piece").alias("row_id"), F.least(F.col("n") - F.col("piece") * 2048, F.lit(2048)).alias("len"))
    return chat.pack_best_fit(pieces, 2048)


@query(
    "next_targets",
    f"""WITH f AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents), e AS (SELECT doc_id, t, unnest(range(len(t))) AS i FROM f)
SELECT doc_id, CAST(sum(coalesce(t[i + 2], 0)) AS BIGINT) AS target_sum, CAST(sum(CASE WHEN i + 1 < len(t) AND i // 10 = (i + 1) // 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM e GROUP BY doc_id""",
)
def next_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    targets, valid = chat.next_targets(F.col("t"), F.transform("t", lambda _, i: F.floor(i / 10).cast("int")))
    return rows.select("doc_id", targets, valid).select("doc_id", _total(F.col("targets")).alias("target_sum"), _total(F.col("valid")).alias("n_valid"))


@query(
    "context_split",
    f"""WITH f AS (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents)
SELECT doc_id, least(len(t), 100) AS n_ids, CAST(coalesce(list_sum(t[greatest(len(t) - 100, 0) + 1 : ]), 0) AS BIGINT) AS id_sum, least(least(len(t) // 2, 100), least(len(t), 100)) AS target_start FROM f""",
)
def context_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _tokens(F.col("text")).alias("t"))
    half = F.slice("t", F.lit(1), F.floor(F.size("t") / 2).cast("int"))
    ids, start = chat.split_context(F.col("t"), half, 100)
    return rows.select("doc_id", ids, start).select("doc_id", F.size("ids").alias("n_ids"), _total(F.col("ids")).alias("id_sum"), "target_start")


@query(
    "choice_prompts",
    """SELECT p_partkey, p_name || chr(10) || ' A. ' || p_brand || chr(10) || ' B. ' || p_type || chr(10) || ' C. ' || p_size || chr(10) || 'Answer:' AS prompt FROM part""",
)
def choice_prompts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", chat.choice_prompt(F.col("p_name"), F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("prompt"))


@query(
    "few_shot",
    """WITH s AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
p AS (SELECT c_nationkey, string_agg('Q: ' || c_name, chr(10) || chr(10) ORDER BY k) AS prefix FROM s WHERE k <= 3 GROUP BY 1)
SELECT s_suppkey, prefix || chr(10) || chr(10) || s_name AS prompt FROM supplier JOIN p ON s_nationkey = c_nationkey""",
)
def few_shot(spark, sf_dir):
    shots = table(spark, sf_dir, "customer").withColumn("q", F.concat(F.lit("Q: "), "c_name"))
    prefix = chat.few_shot_prefix(shots, ["c_nationkey"], "c_custkey", "q", 3)
    s = table(spark, sf_dir, "supplier")
    return s.join(prefix, s["s_nationkey"] == prefix["c_nationkey"]).select("s_suppkey", F.concat("prefix", F.lit("\n\n"), "s_name").alias("prompt"))


# ---------------------------------------------------------------- scores

_SCORES_SQL = "s AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 1)) AS v FROM embeddings), b AS (SELECT vec_id, label, v, list_position(v[1:4], list_max(v[1:4])) - 1 AS best FROM s)"


def _scores(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v"))


@query("choice_accuracy", f"WITH {_SCORES_SQL}, g AS (SELECT vec_id % 7 AS subject, avg(CASE WHEN best = label % 4 THEN 1.0 ELSE 0 END) AS acc, count(*) AS n, sum(CASE WHEN best = label % 4 THEN 1 ELSE 0 END) AS c FROM b GROUP BY 1) SELECT avg(acc) AS macro_acc, CAST(sum(c) AS DOUBLE) / sum(n) AS micro_acc, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS n_correct_rederived FROM g")
def choice_accuracy(spark, sf_dir):
    rows = _scores(spark, sf_dir).select((F.col("vec_id") % 7).alias("subject"), (scoring.first_best(F.col("v"), F.lit(4)) == F.col("label") % 4).alias("right"))
    return scoring.grouped_accuracy(rows, "subject", "right")[1]


@query("subject_accuracy", f"WITH {_SCORES_SQL} SELECT vec_id % 7 AS subject, count(*) AS n, CAST(sum(CASE WHEN best = label % 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, avg(CASE WHEN best = label % 4 THEN 1.0 ELSE 0 END) AS acc FROM b GROUP BY 1")
def subject_accuracy(spark, sf_dir):
    rows = _scores(spark, sf_dir).select((F.col("vec_id") % 7).alias("subject"), (scoring.first_best(F.col("v"), F.lit(4)) == F.col("label") % 4).alias("right"))
    return scoring.grouped_accuracy(rows, "subject", "right")[0]


@query("true_mass", f"WITH {_SCORES_SQL} SELECT vec_id, list_position(v[1:6], list_max(v[1:6])) - 1 IN (0, 2) AS mc1, round((exp(v[1]) + exp(v[3])) / list_sum(list_transform(v[1:6], lambda x: exp(x))), 9) AS mc2 FROM s")
def true_mass(spark, sf_dir):
    mc1, mc2 = scoring.true_mass(F.slice("v", 1, 6), F.array(F.lit(0), F.lit(2)))
    return _scores(spark, sf_dir).select("vec_id", mc1, F.round(mc2, 9).alias("mc2"))


@query("choice_logprob", f"WITH {_SCORES_SQL} SELECT vec_id, round(v[label + 1] - ln(list_sum(list_transform(v, lambda x: exp(x)))), 9) AS lp FROM s")
def choice_logprob(spark, sf_dir):
    return _scores(spark, sf_dir).select("vec_id", F.round(F.element_at(scoring.log_softmax(F.col("v")), F.col("label") + 1), 9).alias("lp"))


@query("perplexity", f"WITH {_SCORES_SQL}, t AS (SELECT label, v[1] - 1 AS lp, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m FROM s) SELECT label, round(sum(-lp * m), 6) AS ce_sum, CAST(sum(m) AS BIGINT) AS n_tokens, round(sum(-lp * m) / greatest(sum(m), 1), 9) AS ce_mean, round(exp(least(sum(-lp * m) / greatest(sum(m), 1), 20.0)), 9) AS perplexity FROM t GROUP BY 1")
def perplexity(spark, sf_dir):
    rows = _scores(spark, sf_dir).withColumn("m", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1)).groupBy("label").agg(*scoring.cross_entropy(F.col("v")[0] - 1, F.col("m")))
    return rows.select("label", F.round("ce_sum", 6).alias("ce_sum"), "n_tokens", F.round("ce_mean", 9).alias("ce_mean"), F.round("perplexity", 9).alias("perplexity"))


@query("z_loss", f"WITH {_SCORES_SQL}, z AS (SELECT vec_id, v[label + 1] AS x, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS lse FROM s) SELECT vec_id, round(lse - x + 1e-5 * lse * lse, 9) AS loss FROM z")
def z_loss(spark, sf_dir):
    return _scores(spark, sf_dir).select("vec_id", F.round(scoring.z_loss(F.col("v"), F.col("label")), 9).alias("loss"))


@query("leaf_norms", f"WITH {_SCORES_SQL}, e AS (SELECT label, unnest(v) AS x FROM s) SELECT label, round(sqrt(sum(x * x)), 6) AS norm FROM e GROUP BY ROLLUP (label)")
def leaf_norms(spark, sf_dir):
    rows = _scores(spark, sf_dir).select("label", F.explode("v").alias("x"))
    return scoring.norms(rows, "label", "x").withColumn("norm", F.round("norm", 6))


@query("accumulation", "SELECT l_orderkey // 64 AS step, round(sum(l_extendedprice) / greatest(sum(l_quantity), 1), 6) AS token_mean, round(avg(l_extendedprice / greatest(l_quantity, 1)), 6) AS microbatch_mean FROM lineitem GROUP BY 1")
def accumulation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("step", F.floor(F.col("l_orderkey") / 64))
    out = scoring.accumulated(rows, "step", "l_extendedprice", "l_quantity")
    return out.select("step", F.round("token_mean", 6).alias("token_mean"), F.round("microbatch_mean", 6).alias("microbatch_mean"))


@query("schedules", "SELECT range AS step, round(1e-5 + (1e-3 - 1e-5) * 0.5 * (1 + cos(pi() * least(range / 200.0, 1.0))), 12) AS cosine, round(CASE WHEN range < 20 THEN 1e-3 * range / 20 ELSE 1e-3 * (1 - least((range - 20) / 180.0, 1.0)) END, 12) AS linear, range = 1 OR (range <= 20 AND range % 5 = 0) OR range % 20 = 0 AS logged FROM range(251)")
def schedules(spark, sf_dir):
    s = F.col("id")
    return spark.range(251).select(s.alias("step"), F.round(scoring.cosine_rate(s, 200, 1e-3, 1e-5), 12).alias("cosine"), F.round(scoring.warm_rate(s, 200, 1e-3, 20), 12).alias("linear"), scoring.logged_step(s).alias("logged"))


@query("adamw", f"WITH {_SCORES_SQL}, g AS (SELECT vec_id, v[1] AS g, v[2] AS p, v[3] AS m, abs(v[4]) AS vv, label % 2 = 0 AS d FROM s), n AS (SELECT least(1.0, 1.0 / (sqrt(sum(g * g)) + 1e-6)) AS f FROM g), u AS (SELECT vec_id, p, d, 0.9 * m + (1 - 0.9) * g * f AS m, 0.95 * vv + (1 - 0.95) * g * f * g * f AS v FROM g, n) SELECT vec_id, round(p - 1e-3 * ((m / (1 - 0.9 ** 10)) / (sqrt(v / (1 - 0.95 ** 10)) + 1e-8) + CASE WHEN d THEN 0.1 * p ELSE 0 END), 9) + 0.0 AS p FROM u")
def adamw(spark, sf_dir):
    v = F.col("v")
    rows = _scores(spark, sf_dir).select(F.lit("w").alias("leaf"), F.col("vec_id").alias("idx"), v[0].alias("g"), v[1].alias("p"), v[2].alias("m"), F.abs(v[3]).alias("v"), (F.col("label") % 2 == 0).alias("decayed"))
    return scoring.adamw(rows, 10, 1e-3).select(F.col("idx").alias("vec_id"), (F.round("p", 9) + 0.0).alias("p"))


# ---------------------------------------------------------------- answers and normal forms

_PUNCT_SQL = "'[!-/:-@\\[-`{-~]'"


def _rewritten(spark, sf_dir):
    """Each document's whole text, and the same without each seventh word."""
    words = F.filter(T.words(F.col("text")), lambda _, i: i % 7 != 6)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("pred"), F.array_join(words, " ").alias("gold"))


def _bags_sql(distinct: str) -> str:
    """Normal words of a text and of the same without each seventh word: articles are whole words here, since what else could stand beside one is deleted."""
    normal = lambda x: f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), {_PUNCT_SQL}, '', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the'))"
    return f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT doc_id, text AS pred, array_to_string(list_filter(ws, lambda x, i: (i - 1) % 7 <> 6), ' ') AS gold FROM w),
n AS (SELECT doc_id, {distinct}({normal('pred')}) AS a, {distinct}({normal('gold')}) AS b FROM d),"""


@query(
    "squad_f1",
    _bags_sql("")
    + """x AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(a) AS w FROM n) GROUP BY ALL), y AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(b) AS w FROM n) GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(least(x.c, y.c)) AS DOUBLE) AS same FROM x JOIN y USING (doc_id, w) GROUP BY 1)
SELECT n.doc_id, array_to_string(a, ' ') = array_to_string(b, ' ') AS em, round(CASE WHEN a IS NULL THEN NULL WHEN same IS NULL THEN 0 ELSE 2 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)) END, 9) AS f1 FROM n LEFT JOIN s USING (doc_id)""",
)
def squad_f1(spark, sf_dir):
    rows = _rewritten(spark, sf_dir).select("doc_id", T.squad_normal(F.col("pred")).alias("a"), T.squad_normal(F.col("gold")).alias("b"))
    return rows.select("doc_id", (F.col("a") == F.col("b")).alias("em"), F.round(T.whole_multiset_f1(F.col("a"), F.col("b")), 9).alias("f1"))


@query(
    "passage_f1",
    _bags_sql("list_distinct")
    + """s AS (SELECT *, CAST(len(list_intersect(a, b)) AS DOUBLE) AS same FROM n)
SELECT doc_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN same = 0 THEN 0 ELSE 2 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)) END, 9) AS f1 FROM s""",
)
def passage_f1(spark, sf_dir):
    rows = _rewritten(spark, sf_dir).select("doc_id", T.passage_bag(F.col("pred")).alias("a"), T.passage_bag(F.col("gold")).alias("b"))
    return rows.select("doc_id", F.round(T.set_f1(F.col("a"), F.col("b")), 9).alias("f1"))


@query(
    "number_answers",
    r"""WITH a AS (SELECT l_orderkey, l_linenumber, 'First 1,234 apples cost $' || l_extendedprice || '. So #### ' || CAST(l_quantity AS INT) || '.' AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, list_extract(regexp_extract_all(regexp_replace(regexp_replace(replace(replace(t, ',', ''), '$', ''), '(?s)^.*#### ', ''), '\.$', ''), '[-+]?\d*\.\d+|\d+'), -1) AS base_answer,
 list_extract(regexp_extract_all(regexp_replace(t, '(\d),(\d)', '\1\2', 'g'), '[-+]?\d*\.\d+|\d+'), -1) AS chat_answer, replace(trim(split_part(t, '####', 2)), ',', '') AS gold FROM a""",
)
def number_answers(spark, sf_dir):
    t = F.concat(F.lit("First 1,234 apples cost $"), F.col("l_extendedprice").cast("string"), F.lit(". So #### "), F.col("l_quantity").cast("int").cast("string"), F.lit("."))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"))
    return rows.select("l_orderkey", "l_linenumber", T.gsm8k_base_answer(F.col("t")).alias("base_answer"), T.gsm8k_chat_answer(F.col("t")).alias("chat_answer"), T.gsm8k_gold(F.col("t")).alias("gold"))


@query(
    "choice_letters",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN substr('ABCD', CAST(o_custkey % 4 AS INT) + 1, 1) WHEN 1 THEN substr('ABCD', CAST(o_custkey % 4 AS INT) + 1, 1) WHEN 2 THEN substr('ABCD', CAST(o_custkey % 4 AS INT) + 1, 1) WHEN 3 THEN substr('ABCD', CAST(o_custkey % 4 AS INT) + 1, 1) ELSE '' END AS letter FROM orders""",
)
def choice_letters(spark, sf_dir):
    letter = F.expr("substring('ABCD', cast(o_custkey % 4 as int) + 1, 1)")
    kind = F.col("o_orderkey") % 5
    t = F.when(kind == 0, F.concat(F.lit("Maybe (A). Therefore, the answer is ("), letter, F.lit(")."))).when(kind == 1, F.concat(F.lit("the answer is "), F.lower(letter), F.lit(", of course"))).when(kind == 2, F.concat(letter, F.lit(") is correct"))).when(kind == 3, F.concat(F.lit("I pick ("), letter, F.lit(") here"))).otherwise(F.lit("no idea"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.choice_letter(t).alias("letter"))


@query("bbh_answers", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '(' || substr('ABC', CAST(o_custkey % 3 AS INT) + 1, 1) || ')' WHEN 1 THEN substr('ABC', CAST(o_custkey % 3 AS INT) + 1, 1) ELSE '' END AS mc, '-' || o_custkey AS number FROM orders""")
def bbh_answers(spark, sf_dir):
    letter = F.expr("substring('ABC', cast(o_custkey % 3 as int) + 1, 1)")
    kind = F.col("o_orderkey") % 3
    t = F.when(kind == 0, F.concat(F.lit("So the answer is ("), letter, F.lit(")."))).when(kind == 1, F.concat(F.lit("it must be "), letter, F.lit(" then"))).otherwise(F.lit("nothing here"))
    mc = T.bbh_answer(t, "snarks")
    number = T.bbh_answer(F.concat(F.lit("3 + 4. So the answer is -"), F.col("o_custkey").cast("string"), F.lit(".")), "multistep_arithmetic_two")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(kind == 1, F.translate(mc, "()", "")).otherwise(mc).alias("mc"), number.alias("number"))


@query("stop_cut", r"SELECT doc_id, regexp_split_to_array(text, '\n|, ')[1] AS head FROM documents")
def stop_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cut_at_stops(F.col("text"), ["\n", ", "]).alias("head"))


@query("alias_match", "SELECT e.event_id, contains('the user did View or CLICK', event_type) OR contains('the user did View or CLICK', lower(event_type)) OR contains('the user did View or CLICK', upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2))) AS hit FROM events e")
def alias_match(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.alias_match(F.lit("the user did View or CLICK"), F.array("event_type")).alias("hit"))


@query("json_keys", """SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1""")
def json_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- instruction predicates

_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, {_PUNCT_SQL}, '', 'g')"


_CHECKS: dict[str, tuple[str, dict, str]] = {
    "placeholders": ("detectable_content:number_placeholders", {"num_placeholders": 1}, r"len(regexp_extract_all(v, '\[.*?\]')) >= 1"),
    "no_comma": ("punctuation:no_comma", {}, "NOT contains(v, ',')"),
    "words": ("length_constraints:number_words", {"num_words": 200, "relation": "at least"}, r"len(regexp_extract_all(v, '[\p{L}\p{M}\p{N}_]+')) >= 200"),
    "letter": ("keywords:letter_frequency", {"letter": "q", "let_frequency": 3, "let_relation": "at least"}, "length(v) - length(replace(lower(v), 'q', '')) >= 3"),
    "existence": ("keywords:existence", {"keywords": ["the", "that"]}, "regexp_matches(v, '(?i)the') AND regexp_matches(v, '(?i)that')"),
    "forbidden": ("keywords:forbidden_words", {"forbidden_words": ["idiot", "moron"]}, r"NOT regexp_matches(v, '(?i)\bidiot\b') AND NOT regexp_matches(v, '(?i)\bmoron\b')"),
    "frequency": ("keywords:frequency", {"keyword": "the", "frequency": 10, "relation": "less than"}, "len(regexp_extract_all(v, '(?i)the')) < 10"),
    "range": ("count:word_count_range", {"min_words": 100, "max_words": 300}, r"len(regexp_extract_all(v, '[\p{L}\p{M}\p{N}_]+')) BETWEEN 100 AND 300"),
    "numbers": ("count:numbers", {"N": 1}, rf"len(regexp_extract_all({_bare('v')}, '\d+')) = 1"),
    "pronouns": ("count:pronouns", {"N": 1}, f"len(list_filter({_WORDS.format(_bare('lower(v)'))}, lambda x: list_contains([{', '.join(repr(x) for x in C.PRONOUNS)}], x))) >= 1"),
    "newline": ("format:newline", {}, rf"len(list_filter(string_split(trim({_bare('v')}, chr(10) || chr(9) || chr(13) || ' '), chr(10)), lambda x: x <> '')) = len({_WORDS.format(_bare('v'))})"),
    "vowels": ("constraint:vowels", {}, f"len(list_filter({_WORDS.format(_bare('lower(v)'))}, lambda x: NOT regexp_matches(x, '^[aeiou]'))) = 0"),
    "lengths": ("constraint:chars", {}, f"len(list_distinct(list_transform({_WORDS.format(_bare('v'))}, lambda x: length(x)))) = len({_WORDS.format(_bare('v'))})"),
    "palindromes": ("constraint:palindrome", {"small_n": 3}, rf"len(list_filter({_WORDS.format(_bare('lower(v)'))}, lambda x: x = reverse(x) AND NOT regexp_matches(x, '^\d+$'))) = 3"),
    "punctuation": ("constraint:punctuation", {"small_n": 4}, f"len(list_distinct(regexp_extract_all(v, {_PUNCT_SQL}))) >= 4"),
    "upper": ("change_case:english_capital", {}, "v = upper(v) AND regexp_matches(v, '[A-Z]')"),
    "lower": ("change_case:english_lowercase", {}, "v = lower(v) AND regexp_matches(v, '[a-z]')"),
    "bullets": ("format:list", {"sep": "|"}, "length(v) - length(replace(v, '|', '')) >= 2"),
    "spaces": ("format:no_whitespace", {}, r"NOT regexp_matches(v, '\s')"),
    "clusters": ("words:consonants", {}, f"len(list_filter({_WORDS.format(_bare('lower(v)'))}, lambda x: NOT regexp_matches(x, '[bcdfghj-np-tv-z]{{2}}'))) = 0"),
    "ending": ("startend:end_checker", {"end_phrase": "the."}, "ends_with(lower(trim(trim(v, chr(10) || ' '), '\"')), 'the.')"),
    "no_and": ("constraint:conjunctions", {}, "NOT regexp_matches(lower(v), 'and|but|for|nor|or|so|yet')"),
}


@query("checkers_strict", "SELECT doc_id, " + ", ".join(f"coalesce(trim(v, chr(10) || ' ') <> '' AND ({sql}), false) AS {k}" for k, (_, _, sql) in _CHECKS.items()) + " FROM (SELECT doc_id, text AS v FROM documents)")
def checkers_strict(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[C.strict(i, F.col("text"), kw).alias(k) for k, (i, kw, _) in _CHECKS.items()])




def _trimmed(x: str) -> str:
    return f"trim({x}, '" + T.PUNCT.replace("'", "''") + " ')"


_PRIMES = ", ".join(str(p) for p in range(2, 100) if all(p % q for q in range(2, p)))
_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"

#: More predicates over all documents; w: words, p: words in lower case without punctuation.
_MORE_CHECKS: dict[str, tuple[str, dict, str]] = {
    "paragraphs": ("length_constraints:number_paragraphs", {"num_paragraphs": 1}, r"len(list_filter(regexp_split_to_array(v, '\s?\*\*\*\s?'), lambda x: trim(x) <> '')) = 1 AND len(list_filter(regexp_split_to_array(v, '\s?\*\*\*\s?')[2:-2], lambda x: trim(x) = '')) = 0"),
    "bullet_list": ("detectable_format:number_bullet_lists", {"num_bullets": 1}, r"len(regexp_extract_all(v, '(?m)^\s*\*[^\*].*$')) + len(regexp_extract_all(v, '(?m)^\s*-.*$')) = 1"),
    "canned": ("detectable_format:constrained_response", {}, " OR ".join(f"contains(v, '{x}')" for x in C.CANNED)),
    "highlights": ("detectable_format:number_highlighted_sections", {"num_highlights": 1}, r"len(list_filter(regexp_extract_all(v, '\*[^\n\*]*\*'), lambda x: trim(trim(x, '*')) <> '')) + len(list_filter(regexp_extract_all(v, '\*\*[^\n\*]*\*\*'), lambda x: trim(x[3:-3]) <> '')) >= 1"),
    "sections": ("detectable_format:multiple_sections", {"section_spliter": "version", "num_sections": 1}, r"len(regexp_split_to_array(v, '\s?version\s?\d+\s?')) - 1 >= 1"),
    "postscript": ("detectable_content:postscript", {"postscript_marker": "P.S."}, r"regexp_matches(lower(v), 'p\.\s?s\.')"),
    "title": ("detectable_format:title", {}, r"len(list_filter(regexp_extract_all(v, '<<[^\n]+>>'), lambda x: trim(regexp_replace(x, '^<+|>+$', '', 'g')) <> '')) > 0"),
    "repeat_prompt": ("combination:repeat_prompt", {"prompt_to_repeat": "the"}, "starts_with(lower(trim(v)), 'the')"),
    "shouted": ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, rf"len(list_filter(list_transform(w, lambda x: {_trimmed('x')}), lambda x: x = upper(x) AND regexp_matches(x, '\p{{Lu}}'))) >= 2"),
    "quoted": ("startend:quotation", {}, "length(trim(v)) > 1 AND starts_with(trim(v), '\"') AND ends_with(trim(v), '\"')"),
    "different_words": ("count:unique_word_count", {"N": 60}, f"len(list_distinct(list_transform(w, lambda x: {_trimmed('lower(x)')}))) >= 60"),
    "stop_words": ("ratio:stop_words", {"percentage": 25, "stop_list": ["the", "of", "and", "a", "in", "to", "is"]}, r"len(regexp_extract_all(lower(v), '[\p{L}\p{M}\p{N}_]+')) > 0 AND len(list_filter(regexp_extract_all(lower(v), '[\p{L}\p{M}\p{N}_]+'), lambda x: x IN ('the', 'of', 'and', 'a', 'in', 'to', 'is'))) * 100.0 <= 25 * len(regexp_extract_all(lower(v), '[\p{L}\p{M}\p{N}_]+'))"),
    "linking": ("count:conjunctions", {"small_n": 2}, f"len(list_distinct(list_filter(w, lambda x: {_trimmed('x')} <> '' AND lower({_trimmed('x')}) IN ({', '.join(map(repr, C.CONJUNCTIONS))})))) >= 2"),
    "names": ("count:person_names", {"N": 1}, " OR ".join(f"contains(v, '{x}')" for x in C.NAMES)),
    "grams": ("ratio:overlap", {"reference_text": "the water and this house", "percentage": 3}, f"length(v) > 2 AND abs(len(list_intersect({_GRAMS.format('v')}, {_GRAMS.format(repr('the water and this house'))})) * 100.0 / len({_GRAMS.format('v')}) - 3) <= 2"),
    "three_vowels": ("words:vowel", {}, r"NOT contains(trim(v, chr(10) || chr(13) || chr(9) || ' '), chr(10)) AND len(list_distinct(regexp_extract_all(lower(v), '[aeiou]'))) <= 3"),
    "prime_lengths": ("words:prime_lengths", {}, f"len(list_filter({_WORDS.format(_bare('v'))}, lambda x: length(x) NOT IN ({_PRIMES}))) = 0"),
    "japanese": ("count:words_japanese", {"N": 2}, r"len(list_filter(range(2, len(w) + 1, 2), lambda i: NOT regexp_matches(w[i], '[぀-ヿ一-鿿]') AND NOT regexp_matches(w[i], '^\d+$'))) = 0"),
    "repeated": ("words:repeats", {"small_n": 5}, "coalesce(list_max(map_values(list_aggregate(p, 'histogram'))), 0) <= 5"),
    "first_letters": ("words:no_consecutive", {}, "len(list_filter(range(1, len(p)), lambda i: substr(p[i], 1, 1) = substr(p[i + 1], 1, 1))) = 0"),
    "sub_bullets": ("format:sub-bullets", {}, "len(list_filter(string_split(v, '*')[2:], lambda x: NOT contains(x, '-'))) = 0"),
    "multiples": ("custom:multiples", {}, r"regexp_extract_all(v, '\d+') = ['14', '21', '28', '35', '42', '49']"),
    "backwards": ("custom:character_reverse", {}, "contains(lower(v), 'elgae dlab')"),
    "same_count": ("type:num_words", {"prev_response": "one two three four five six seven, eight nine ten"}, f"len({_WORDS.format(_bare('v'))}) = 10"),
    "digits": ("constraint:digits", {"small_n": 4}, r"len(regexp_extract_all(v, '[\p{Nd}²³¹⁰⁴-⁹₀-₉]')) = 4"),
    "marks": ("constraint:nonalpha", {"small_n": 9}, r"len(regexp_extract_all(v, '[^\p{L}\p{N}\x20\t\n\r\x0B\f]')) = 9"),
    "no_letter": ("constraint:nochar", {"charc": "k"}, "NOT contains(lower(v), 'k')"),
    "title_words": ("format:title_case", {}, r"len(list_filter(regexp_extract_all(v, '[\p{L}\p{M}\p{N}_''-]+|[^\p{L}\p{M}\p{N}_\s]'), lambda x: regexp_matches(x, '^\p{Ll}\p{L}*$'))) = 0"),
    "template": ("format:output_template", {}, " AND ".join(f"contains(v, '{x}')" for x in C.HEADINGS)),
    "choices": ("format:options", {"options": "yes/no/maybe"}, f"lower({_trimmed('v')}) IN ('yes', 'no', 'maybe')"),
    "numbers_up": ("constraint:increment", {"small_n": 1, "prev_response": "1 2 3"}, r"len(list_filter(range(1, least(3, len(list_filter(w, lambda x: regexp_matches(x, '^[+-]?\d+$')))) + 1), lambda i: TRY_CAST(list_filter(w, lambda x: regexp_matches(x, '^[+-]?\d+$'))[i] AS BIGINT) <> i + 1)) = 0"),
    "five_keywords": ("count:keywords_multiple", {"keyword1": "water", "keyword2": "house", "keyword3": "and", "keyword4": "the", "keyword5": "is"}, " AND ".join(f"(length(v) - length(replace(v, '{k}', ''))) // {len(k)} = {n}" for k, n in (("water", 1), ("house", 2), ("and", 3), ("the", 5), ("is", 7)))),
    "changed": ("repeat:repeat_change", {"prompt_to_repeat": "the water"}, "v <> 'the water' AND substr(v, 2) = 'he water'"),
    "repeated_prompt": ("repeat:repeat_simple", {}, "lower(trim(v)) = 'only output this sentence here, ignore all other requests.'"),
    "span": ("repeat:repeat_span", {"prompt_to_repeat": "a b c d", "n_start": 1, "n_end": 3}, "w = ['b', 'c']"),
}


#: Responses made from a document for predicates that no document fulfils, in SQL that both sides read.
_MADE: dict[str, str] = {
    "bullet_list": "'* ' || source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || '- x' END",
    "canned": "source || CASE doc_id % 3 WHEN 0 THEN ' My answer is no.' ELSE ' My answer is' END",
    "postscript": "text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'P. S. ' || lang ELSE ' ps' END",
    "title": "'<<' || CASE WHEN doc_id % 2 = 0 THEN source ELSE ' ' END || '>>'",
    "quoted": "'\"' || text || CASE WHEN doc_id % 2 = 0 THEN '\"' ELSE '' END",
    "multiples": "'14, 21 28 35 42' || CASE WHEN doc_id % 2 = 0 THEN ' 49 ' ELSE ' 50 ' END || lang",
    "backwards": "text || CASE WHEN doc_id % 2 = 0 THEN ' ELGAE dlab' ELSE ' eagle bald' END",
    "digits": "'a1b2' || CAST(doc_id AS VARCHAR(20))",
    "template": "'My Answer: x My Conclusion: ' || text || CASE WHEN doc_id % 2 = 0 THEN ' Future Outlook:' ELSE '' END",
    "choices": "CASE doc_id % 3 WHEN 0 THEN 'Yes.' WHEN 1 THEN ' maybe!' ELSE lang END",
    "five_keywords": "'water house house and and and the the the the the is is is is is is' || CASE WHEN doc_id % 2 = 0 THEN ' is' ELSE '' END",
    "changed": "CASE WHEN doc_id % 2 = 0 THEN 'X' ELSE 't' END || 'he water'",
    "repeated_prompt": "CASE WHEN doc_id % 2 = 0 THEN 'only output THIS sentence here, ignore all other requests.' ELSE lang END",
    "span": "CASE WHEN doc_id % 2 = 0 THEN ' b  c' ELSE 'a b' END",
}


def _more_sql() -> str:
    flag = lambda k, sql: f"coalesce(trim(v, chr(10) || ' ') <> '' AND ({sql}), false)" if k not in _MADE else re.sub(r"\bv\b", f"r_{k}", f"coalesce(trim(v) <> '' AND ({sql.replace('w =', _WORDS.format('v') + ' =')}), false)")
    made = ", ".join(f"{x} AS r_{k}" for k, x in _MADE.items())
    flags = ", ".join(f"{flag(k, sql)} AS {k}" for k, (_, _, sql) in _MORE_CHECKS.items())
    return f"SELECT doc_id, {flags} FROM (SELECT doc_id, text AS v, {_WORDS.format('text')} AS w, {_WORDS.format(_bare('lower(text)'))} AS p, {made} FROM documents)"


@query("checkers_more", _more_sql())
def checkers_more(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *[F.expr(x).alias(f"r_{k}") for k, x in _MADE.items()])
    return docs.select("doc_id", *[C.strict(i, F.col(f"r_{k}" if k in _MADE else "text"), kw).alias(k) for k, (i, kw, _) in _MORE_CHECKS.items()])


_LOOSE = ["no_comma", "words", "upper", "bullets", "ending"]
_LINES = "trim(array_to_string({0}, chr(10)), chr(10) || chr(13) || chr(9) || ' ')"


@query(
    "checkers_loose",
    "SELECT doc_id, " + ", ".join(f"coalesce(len(list_filter(vs, lambda v: trim(v, chr(10) || ' ') <> '' AND ({_CHECKS[k][2]}))) > 0, false) AS {k}" for k in _LOOSE)
    + f" FROM (SELECT doc_id, list_concat(four, list_transform(four, lambda x: replace(x, '*', ''))) AS vs FROM (SELECT doc_id, [text, {_LINES.format('l[2:]')}, {_LINES.format('l[1:-2]')}, {_LINES.format('l[2:-2]')}] AS four FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)))",
)
def checkers_loose(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", C.variants(F.col("text")).alias("made"))
    return docs.select("doc_id", *[C.loose(_CHECKS[k][0], F.col("text"), _CHECKS[k][1], F.col("made")).alias(k) for k in _LOOSE])


@query("instruction_accuracy", f"WITH f AS (SELECT [{', '.join(f'coalesce(({sql}), false)' for _, (_, _, sql) in list(_CHECKS.items())[:6])}] AS l FROM (SELECT text AS v FROM documents)) SELECT avg(CASE WHEN list_bool_and(l) THEN 1.0 ELSE 0 END) AS prompt_acc, CAST(sum(len(list_filter(l, lambda x: x))) AS DOUBLE) / sum(len(l)) AS instruction_acc FROM f")
def instruction_accuracy(spark, sf_dir):
    return _accuracy(table(spark, sf_dir, "documents"))


def _accuracy(docs: DataFrame) -> DataFrame:
    flags = docs.select(F.array(*[C.strict(i, F.col("text"), kw) for i, kw, _ in list(_CHECKS.values())[:6]]).alias("l"))
    return flags.agg(F.avg(F.forall("l", lambda x: x).cast("int")).alias("prompt_acc"), (F.sum(F.size(F.filter("l", lambda x: x))) / F.sum(F.size("l"))).alias("instruction_acc"))


# ---------------------------------------------------------------- results mart


@query("latest_per_key", "SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return results.latest(rows, ["user_id", "event_type"], "ts", "event_id")


@query("paired_delta", "WITH m AS (SELECT user_id, event_type, max(round(value, 3)) AS x FROM events GROUP BY ALL) SELECT user_id, max(CASE WHEN event_type = 'click' THEN x END) AS \"before\", max(CASE WHEN event_type = 'view' THEN x END) AS \"after\", coalesce(printf('%+.1f', (max(CASE WHEN event_type = 'view' THEN x END) - max(CASE WHEN event_type = 'click' THEN x END)) * 100), '—') AS delta FROM m GROUP BY 1")
def paired_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.round("value", 3)).alias("x"))
    return results.paired_delta(rows, "user_id", "event_type", "x", "click", "view")


@query("leaderboard", "SELECT o_orderpriority AS task, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def leaderboard(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "task")
    return results.leaderboard(rows, "task", "o_totalprice", "o_orderkey").select("task", "o_orderkey", "rank")


@query("coverage", "SELECT user_id, count(DISTINCT event_type) AS n_done, 3 AS n_total FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def coverage(spark, sf_dir):
    return results.coverage(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view", "error"])


@query("summary_names", "SELECT event_id, '2024' AS ts, CASE event_id % 3 WHEN 0 THEN 'mmlu_pro' WHEN 1 THEN 'mmlu' END AS task, CASE event_id % 3 WHEN 0 THEN 'run' || user_id WHEN 1 THEN 'run' || user_id END AS label FROM events")
def summary_names(spark, sf_dir):
    k = F.col("event_id") % 3
    name = F.concat(F.lit("gs/x/2024_"), F.when(k == 0, "mmlu_pro_run").when(k == 1, "mmlu_run").otherwise("other_run"), F.col("user_id").cast("string"), F.lit(".json"))
    return table(spark, sf_dir, "events").select("event_id", *results.parse_name(name, ["mmlu", "mmlu_pro"]))


@query("pivot_grid", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY 1")
def pivot_grid(spark, sf_dir):
    one = lambda s: F.sum((F.col("o_orderstatus") == s).cast("int"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(one("F").alias("f"), one("O").alias("o"))


@query("closure", "WITH p AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation) SELECT DISTINCT a, b FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT a, a FROM p UNION ALL SELECT b, b FROM p)")
def closure(spark, sf_dir):
    return results.symmetric_closure(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")


@query("complete_steps", "SELECT n_nationkey AS step FROM nation WHERE n_nationkey % 3 = 0")
def complete_steps(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    stem = F.format_string("ckpt/step_%07d", "n_nationkey")
    return results.complete_steps(n.select(F.concat(stem, F.lit("/")).alias("path")).union(n.filter("n_nationkey % 3 = 0").select(F.concat(stem, F.lit("_COMPLETE")))).union(n.select(F.lit("ckpt/junk").alias("path"))))


@query("scored_predictions", "SELECT d.source, sum(CASE WHEN coalesce(l.toxic, 0) = 0 THEN 1 ELSE 0 END) / count(*) AS score FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def scored_predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(scoring.accuracy(F.coalesce("toxic", F.lit(0)) == 0).alias("score"))


# ---------------------------------------------------------------- benchmark items, maths, sinks, streams

from corvane.functions import benchmarks as B  # noqa: E402
from corvane.functions import math_text as M  # noqa: E402
from corvane.sources import writers  # noqa: E402
from corvane.streaming import ordered  # noqa: E402


@query(
    "math_forms",
    r"""SELECT l_orderkey, l_linenumber, '\frac{' || CAST(l_quantity AS INT) || '}{' || l_linenumber || '}' AS short, CAST(CAST(l_quantity AS INT) * 1000 AS VARCHAR) AS final, CAST(l_linenumber AS VARCHAR) AS inside FROM lineitem""",
)
def math_forms(spark, sf_dir):
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    thousands = F.concat(F.lit("x = "), q, F.lit(",000 dollars"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.short_form(F.concat(q, F.lit(" / "), k)).alias("short"), M.final_form(thousands).alias("final"), M.boxed(F.concat(F.lit(r"so \boxed{"), k, F.lit("} holds"))).alias("inside"))


@query("math_solved", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 7 = l_linenumber % 7 AS solved FROM lineitem")
def math_solved(spark, sf_dir):
    answer = F.concat(F.lit(r"Thus \boxed{"), (F.col("l_quantity").cast("int") % 7).cast("string"), F.lit("}."))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.solved(answer, (F.col("l_linenumber") % 7).cast("string")).alias("solved"))


@query("math_solved_by_algebra", "SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 1 AS solved FROM lineitem")
def math_solved_by_algebra(spark, sf_dir):
    """Sums of fractions and roots against another way to write them, which is one off for every third line number."""
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    answer = F.concat(F.lit(r"Thus \boxed{\frac{"), q, F.lit(r"}{7}+\sqrt{"), (k * k * 2).cast("string"), F.lit(r"}x}."))
    gold = F.concat(F.lit(r"\frac{x^2"), F.when(k % 3 == 1, F.lit("+1")).otherwise(F.lit("")), F.lit(" - x^2 + "), q, F.lit(r"}{7} + "), k.cast("string"), F.lit(r"x\sqrt{2}"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answer.alias("answer"), gold.alias("gold"))
    return M.with_solved(rows, "answer", "gold", "solved", algebra=True).select("l_orderkey", "l_linenumber", "solved")


@query("exam_queries", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || chr(10) ELSE '' END || 'Question: ' || p_name || chr(10) || ' A. ' || p_brand || chr(10) || ' B. none' || chr(10) || 'Answer:' AS prompt FROM part")
def exam_queries(spark, sf_dir):
    passage = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", B.exam_query(passage, F.col("p_name"), F.array(F.concat(F.lit("(A) "), "p_brand"), F.lit("B. none"))).alias("prompt"))


@query("blanks", "SELECT p_partkey, split_part(p_name || '_x', '_', 1) AS before, substr(p_name || '_x', instr(p_name || '_x', '_') + 1) AS after FROM part")
def blanks(spark, sf_dir):
    before, after = B.blank_parts(F.concat("p_name", F.lit("_x")))
    return table(spark, sf_dir, "part").select("p_partkey", before.alias("before"), after.alias("after"))


@query("activity_queries", r"SELECT p_partkey, replace(regexp_replace(regexp_replace(trim(p_brand || ': ' || p_name || ' [title] and [x] ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))), '\.? \[title\]', '. ', 'g'), '\[.*?\]', '', 'g'), '  ', ' ') AS query FROM part")
def activity_queries(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", B.activity_query(F.col("p_brand"), F.concat("p_name", F.lit(" [title] and [x]")), F.col("p_type")).alias("query"))


@query("gold_places", "SELECT o_orderkey, CAST(o_custkey % 5 AS INT) AS gold FROM orders")
def gold_places(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 2 == 0, F.expr("substring('ABCDE', cast(o_custkey % 5 as int) + 1, 1)")).otherwise((F.col("o_custkey") % 5 + 1).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", B.gold_index(key).alias("gold"))


@query("open_scores", "SELECT event_id, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS em, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS f1 FROM events")
def open_scores(spark, sf_dir):
    em, f1 = B.best_open_scores(F.col("event_type"), F.array(F.lit("The Click!"), F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", em, f1)


@query(
    "prompt_messages",
    "SELECT n_nationkey, 'D qa F|A: one|' || n_name || ' F' AS said FROM nation",
)
def prompt_messages(spark, sf_dir):
    shots = F.array(F.struct(F.lit("qa A:").alias("user"), F.lit("one").alias("assistant")))
    said = B.prompt_messages(F.col("n_name"), shots, None, True, "D ", " F", "A:")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(said, lambda m: m["content"]), "|").alias("said"))


@query("merged_choices", "SELECT n_nationkey, 'x,' || n_name || ',y' AS choices, '1,2' AS places FROM nation")
def merged_choices(spark, sf_dir):
    first = F.struct(F.array(F.lit("x"), F.col("n_name")).alias("choices"), F.array(F.lit(1), F.lit(0)).alias("labels"))
    second = F.struct(F.array(F.col("n_name"), F.lit("y")).alias("choices"), F.array(F.lit(0), F.lit(0)).alias("labels"))
    choices, places = B.merged_choices(first, second)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(choices, ",").alias("choices"), F.array_join(places.cast("array<string>"), ",").alias("places"))


_shared = shared_path


@query("shard_roundtrip", f"WITH {_PACKED_SQL} SELECT global_seq, CAST(list_sum(tokens) AS BIGINT) AS token_sum FROM r WHERE global_seq >= 100")
def shard_roundtrip(spark, sf_dir):
    """Write shards, then read them from row 100 on."""
    path, rows = _shared(spark, "shards"), _packed(spark, sf_dir)
    shard, row = corpus.shard_place(F.col("global_seq"), 500)
    writers.write_shards(rows.select("*", shard, row), path, 12)
    return readers.shards(spark, path, 100).select("global_seq", _total(F.col("tokens")).alias("token_sum"))


@query(
    "ordered_stream",
    f"""WITH {_PACKED_SQL}, n AS (SELECT count(*) - 100 AS n FROM r), k AS (SELECT n, unnest(range(2 * n)) AS k FROM n)
SELECT 100 + k % n AS global_seq, k // n AS cycle, k // (n // 3 + 1) * (n // 3 + 1) AS batch, k % (n // 3 + 1) AS place FROM k""",
)
def ordered_stream(spark, sf_dir):
    """Two passes over all shards from row 100 on, in batches that end inside shards and passes; the place is that in the batch's files."""
    path = _shared(spark, "stream")
    shard, row = corpus.shard_place(F.col("global_seq"), 500)
    packed = written(_packed(spark, sf_dir).select("global_seq", "tokens"), "packed")
    writers.write_shards(packed.select("*", shard, row), path, 12)
    n, sink = packed.count(), ordered.BatchSink(spark, _shared(spark, "stream-out"))
    rows = spark.read.schema("global_seq long, tokens array<int>, row_in_shard long, shard_id long").parquet(path)
    ordered.follow(rows, n, lambda batch, at, following: sink.take(batch.select("global_seq", "cycle"), at, following), _shared(spark, "stream-state"), 100, (n - 100) // 3 + 1, 2, shard_size=500)
    out = sink.rows("global_seq long, cycle long").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    place = F.row_number().over(Window.partitionBy("batch").orderBy("file", "row")) - 1
    return out.select("global_seq", "cycle", "batch", place.cast("long").alias("place"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return ordered.windowed_counts(events, "ts", ["event_type"], value=F.col("value")).withColumn("total", F.round("total", 6))


@query("corpus_stats", f"WITH {_PACKED_SQL} SELECT count(*) AS n_rows, count(DISTINCT file_idx) AS n_files, count(*) * 64 AS n_tokens FROM r")
def corpus_stats(spark, sf_dir):
    return _packed(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.countDistinct("file_idx").alias("n_files"), (F.count("*") * 64).alias("n_tokens"))
