"""However many partitions there are, a language's gram counts meet as a few tables."""

import numpy as np

from corvane.llm import language


def test_few_tables_a_language(spark):
    rows = spark.createDataFrame([(f"word{chr(97 + i % 26)} the text", "en" if i % 2 else "de") for i in range(400)], "text string, lang string").repartition(64)
    one, many = (language._gram_counts(x).collect() for x in (rows.coalesce(1), rows))
    assert max(sum(r.lang == k for r in many) for k in ("en", "de")) <= language.FIT_TASKS
    total = lambda found: {k: sum(np.frombuffer(r.data, np.int64) for r in found if r.lang == k).tolist() for k in ("en", "de")}
    assert total(one) == total(many)
    assert language.learn(rows).languages == ["de", "en", language.UNKNOWN]
