"""Manifests, steps that run once, permutations and Markdown blocks, against hand-worked results."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import corpus, reports, results
from corvane.plans.learned import SUBTASKS
from corvane.sources import readers, writers


def test_a_manifest_is_written_read_and_checked(spark, tmp_path):
    source = {"max_length": 64, "shuffle_policy": "none at repack", "file_order": "by name", "packing": "greedy", "rows": 12}
    baked = corpus.shuffled_manifest(corpus.check_unshuffled(source), 7, "corpus")
    writers.write_manifest(spark, f"{tmp_path}/manifest.json", baked)
    read = json.loads(writers.get_text(spark, f"{tmp_path}/manifest.json"))
    assert read == baked and read["shuffle_seed"] == 7 and read["rows"] == 12 and "packing" not in read
    assert readers.check_manifest(read, 64) is read
    with pytest.raises(ValueError, match="64 tokens, not 65"):
        readers.check_manifest(read, 65)
    with pytest.raises(ValueError, match="global order"):
        readers.check_manifest(source, 64)
    with pytest.raises(ValueError, match="file order"):
        corpus.check_unshuffled({"shuffle_policy": "by seed"})


def test_a_step_runs_once(spark, tmp_path):
    ran = []

    def step(n):
        return lambda: ran.append(n) or {"rows": n}

    folder = f"{tmp_path}/steps"
    assert [writers.once(spark, folder, n, step(n)) for n in (1, 1, 3, 2, 4)] == [True, False, True, False, True]
    assert ran == [1, 3, 4] and writers.latest_commit(spark, folder) == (4, {"rows": 4})

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writers.once(spark, folder, 5, fails)
    assert writers.once(spark, folder, 5, step(5)) and ran == [1, 3, 4, 5]


def test_source_places_invert_the_order(spark, tmp_path):
    order = [3, 0, 4, 1, 2]
    rows = spark.createDataFrame([(i, s, "x") for i, s in enumerate(order)], "out_pos long, src_pos long, other string")
    kept = spark.read.parquet(writers.write_permutation(rows, str(tmp_path), 9))
    assert kept.columns == ["out_pos", "src_pos"]
    got = {r.src_pos: (r.out_pos, r.out_shard, r.out_row) for r in corpus.source_places(kept, 2).collect()}
    assert got == {s: (i, i // 2, i % 2) for i, s in enumerate(order)}


def test_blocks_of_markdown(spark):
    text, changed = results.replace_block("# Title\n", "scores", r"a \1 b")
    assert changed and text == "# Title\n\n<!-- scores:start -->\n" + r"a \1 b" + "\n<!-- scores:end -->\n"
    again, changed = results.replace_block(text, "scores", r"a \1 b")
    assert again == text and not changed
    other, changed = results.replace_block(text + "after\n", "scores", "new")
    assert changed and other == "# Title\n\n<!-- scores:start -->\nnew\n<!-- scores:end -->\nafter\n"
    rows = spark.createDataFrame([("b", 2, 0.5), ("a", 1, None)], "name string, n int, x double")
    assert results.markdown_rows(rows, ["name", "n"], ["n"]) == "| name | n |\n|---|---|\n| a | 1 |\n| b | 2 |"


def test_block_of_a_task(spark):
    scored = spark.createDataFrame([("s1-1000", {"acc": 0.25, "f1": 0.5}, "m/1"), ("s2-1000", {"acc": 0.75}, None), ("s1-2000", {"f1": 0.1}, "m/3")], "label string, metrics map<string,double>, model_path string")
    values = scored.select("label", F.try_element_at("metrics", F.lit("acc")).alias("value"))
    pairs = reports.step_pairs(values, ["1000", "2000"], "s1-", "s2-")
    lines = reports.task_block("acc", pairs, scored, ["f1"]).split("\n")
    assert [x for x in lines if x.startswith("| 1000")][0].startswith("| 1000 | 0.2500 | 0.7500 | ")
    assert "50" in [x for x in lines if x.startswith("| 1000")][0] and any(x.startswith("| 2000 | — | — |") for x in lines)
    listed = [x.split(" | ")[0] for x in lines if x.startswith("| s")]
    assert listed == ["| step", "| s2-1000", "| s1-1000"] and lines[-2].endswith("| `m/1` |")


def test_answers_of_every_subtask(spark):
    def plain(v, name):
        answer = T.BBH_ANSWERS.get(name, T.BBH_CHOICE)
        tries = [t.replace("(?id)", "(?i)") % answer for t in T.BBH_TEMPLATES] + [r"\b([A-Z])\b"] * (name not in T.BBH_ANSWERS) + [f"(?i)({answer})"]
        out = next((found[-1] for found in (re.findall(p, v) for p in tries) if found), "")
        for left, right in T.BBH_DELIMITERS:
            if not re.match(answer, left):
                out = re.sub(f"^{re.escape(left)}(.*){re.escape(right)}$", r"\1", out).strip()
        return f"({out})" if name not in T.BBH_ANSWERS and len(out) == 1 else out

    texts = [p % a for a in SUBTASKS.values() for p in ("So the answer is %s.", "first (A), then\nAnswer: %s", "`%s`", "É B à %s")] + ["", "none of it", "x\n"]
    rows = spark.createDataFrame([(v, k) for v in texts for k in [*SUBTASKS, "unknown", None]], "v string, k string")
    wrong = [(r.v, r.k, r.a) for r in rows.withColumn("a", T.bbh_answers(F.col("v"), F.col("k"))).collect() if r.a != plain(r.v, r.k)]
    assert not wrong
