"""The pipeline's stages, each against what it must keep, and the registered names."""

import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from corvane.llm import queries


def test_names_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(queries.ORACLES) <= set(queries.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_in_order(spark, docs):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(n))
    common = say(100)
    texts = [f"the water and this house {say(150)} {common} with words {say(20)}" for _ in range(4)]
    texts += [texts[0], None, "0 1 2 3", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" the house and water"]
    rows = docs(*texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, "")
        assert out.columns == rows.columns, name
        rows = spark.createDataFrame(out.collect(), rows.schema)
    kept = {r.doc_id: r.text for r in rows.collect()}
    assert 0 in kept and 4 not in kept and 5 not in kept and 6 not in kept
    assert kept[7].startswith("[SECRET]") and not any(common[200:240] in t for t in kept.values()) and {1, 2, 3} <= set(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, "").toPandas()
    assert set(packed.doc_id) == set(kept)


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids, unlike texts under one id."""
    long = " ".join(f"the water and this house {i}" for i in range(4000))
    rows = [(1, "the water and this house is here now", "en", "s", 3), (1, "the water and this house is here now", "en", "s", 3), (1, "quite another text about the water and the house", "en", "s", 3), (None, "the house and the water again here", "en", None, None)]
    return [*rows, (2, None, None, None, None), (3, "", "en", "s", 0), (4, long, "en", "s", len(long)), (5, long + " end", None, "s", 9), (6, "0 1 2", "en", "s", 5), (7, "this house token=abcdefgh1 and the water", "en", "t", 1)]


DOC = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["row", "gone", "c1", "c2", "kept_id", "own_t1", "found_lang", "found", "base_spans", "all_spans", "t1", "h1", "spans", "logs"]


def test_stages_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame(odd_rows(), DOC)
    rows = rows.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in NAMES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, "")
        assert out.columns == rows.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for c in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() >= len(odd_rows())


def test_stages_take_an_empty_table(spark):
    empty = spark.createDataFrame([], DOC)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns), name


def test_run(spark, tmp_path):
    spark.createDataFrame(odd_rows(), DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    ids = set(packed.doc_id.dropna().astype(int))
    assert {1, 4, 7} <= ids and not {2, 3, 5, 6} & ids and packed.doc_id.isna().any()
    assert packed[packed.doc_id == 1].groupby("doc_tokens").ngroups == 2, "both texts of id 1 stay, its copy goes"
    for _, own in packed.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
