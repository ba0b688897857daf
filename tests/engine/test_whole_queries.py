"""Queries over whole tables against plain Python, on documents that the queries with SQL leave out."""

import re
import string
from collections import Counter

import pytest

from corvane.functions import checkers as C
from corvane.plans.registry import _CHECKS, QUERIES

TEXTS = [
    "Die Straße war naß, und der Äther (so sagt man) roch nach Öl. 12 Vögel sahen das Haus an der Ecke.", "L'été, à la plage: une idée, un café, the end of a day.", "¿Qué pasó? El niño comió 3.0 manzanas y 03 peras, más tarde the an a.",
    "plain text, only six words here", "", "the", None, " ".join(f"word{i % 97} the Ünder{i % 13}" for i in range(3000)), "x" * 400 + " après " + "tail " * 200,
    "ÉTÉ À PARIS", "été à paris", "ÄÖÜ|É|ñ Anna été Élé é 7", "naïve\nÉtude\nça", "là\u00a0bas", "That is the qué, qüq; I said: fin à the.",
]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(f"{root}/documents.parquet")
    return str(root)


def bare(v):
    return v.translate(str.maketrans("", "", string.punctuation))


def rewritten(v):
    return " ".join(w for i, w in enumerate(v.split()) if i % 7 != 6)


def share(same, n, m):
    return round(2 * (same / n) * (same / m) / (same / n + same / m), 9) if same else 0.0


def test_f1_of_whole_texts(spark, whole):
    squad = {r.doc_id: (r.em, r.f1) for r in QUERIES["squad_f1"](spark, whole).collect()}
    passage = {r.doc_id: r.f1 for r in QUERIES["passage_f1"](spark, whole).collect()}
    assert set(squad) == set(passage) == set(range(len(TEXTS)))
    for i, v in enumerate(TEXTS):
        if v is None:
            assert squad[i] == (None, None)
            continue
        a, b = (re.sub(r"\b(a|an|the)\b", " ", bare(x.lower())).split() for x in (v, rewritten(v)))
        assert squad[i] == (a == b, pytest.approx(share((Counter(a) & Counter(b)).total(), len(a), len(b)), abs=1e-9)), v[:40]
        whole_number = lambda w: str(int(float(w))) if re.fullmatch(r"[+-]?\d+(\.0*)?", w) else w
        a, b = ({whole_number(w) for w in bare(re.sub(r"\b(a|an|the)\b", " ", x.lower().strip())).split()} for x in (v, rewritten(v)))
        assert passage[i] == pytest.approx(share(len(a & b), len(a), len(b)) if a or b else 1.0, abs=1e-9), v[:40]


def holds(name, v):
    """The predicates of checkers_strict on one text that is not blank, in plain Python."""
    low, plain = v.lower(), bare(v.lower()).split()
    return {
        "placeholders": lambda: len(re.findall(r"\[.*?\]", v)) >= 1, "no_comma": lambda: "," not in v, "words": lambda: len(re.findall(r"\w+", v)) >= 200, "letter": lambda: low.count("q") >= 3,
        "existence": lambda: "the" in low and "that" in low, "forbidden": lambda: not re.search(r"\b(idiot|moron)\b", low), "frequency": lambda: low.count("the") < 10, "range": lambda: 100 <= len(re.findall(r"\w+", v)) <= 300,
        "numbers": lambda: len(re.findall(r"\d+", bare(v))) == 1, "pronouns": lambda: any(w in C.PRONOUNS for w in plain), "newline": lambda: len([x for x in bare(v).strip().split("\n") if x]) == len(bare(v).split()),
        "vowels": lambda: all(w[0] in "aeiou" for w in plain), "lengths": lambda: len({len(w) for w in plain}) == len(plain), "palindromes": lambda: sum(w == w[::-1] and not w.isdigit() for w in plain) == 3,
        "punctuation": lambda: len(set(v) & set(string.punctuation)) >= 4, "upper": lambda: v.isupper(), "lower": lambda: v.islower(), "bullets": lambda: v.count("|") >= 2, "spaces": lambda: not re.search(r"\s", v),
        "clusters": lambda: all(re.search("[bcdfghj-np-tv-z]{2}", w) for w in plain), "ending": lambda: low.strip().strip('"').endswith("the."), "no_and": lambda: not re.search("and|but|for|nor|or|so|yet", low),
    }[name]()


def test_predicates_of_all_documents(spark, whole):
    rows = {r.doc_id: r.asDict() for r in QUERIES["checkers_strict"](spark, whole).collect()}
    assert set(rows) == set(range(len(TEXTS)))
    wrong = [(i, k, rows[i][k]) for i, v in enumerate(TEXTS) for k in _CHECKS if rows[i][k] != bool(v and v.strip() and holds(k, v))]
    assert not wrong
    flags = [[bool(v and v.strip() and holds(k, v)) for k in list(_CHECKS)[:6]] for v in TEXTS]
    got = QUERIES["instruction_accuracy"](spark, whole).first()
    assert got.prompt_acc == pytest.approx(sum(map(all, flags)) / len(TEXTS)) and got.instruction_acc == pytest.approx(sum(map(sum, flags)) / len(TEXTS) / 6)


def packed(lengths):
    """file_idx, seq_in_file of all packed rows in their order."""
    return [(i, k) for i, n in enumerate(lengths) for k in range(n // 64)]


@pytest.fixture(scope="module")
def long_files(spark, tmp_path_factory):
    root, lengths = tmp_path_factory.mktemp("files"), [5000, 63, 70_000, 0, 64, *[700] * 60, 40_000]
    spark.createDataFrame([(i, "ab " * n) for i, n in enumerate(lengths)], "doc_id long, text string").repartition(3).write.parquet(f"{root}/documents.parquet")
    return str(root), packed(lengths)


def test_all_rows_are_packed(spark, long_files):
    path, want = long_files
    rows = QUERIES["fixed_packing"](spark, path).orderBy("global_seq").collect()
    assert len(want) > 100_000 // 64
    assert [(r.file_idx, r.seq_in_file, r.global_seq, r.token_sum) for r in rows] == [(*x, at, 128) for at, x in enumerate(want)]


def test_all_rows_are_streamed(spark, long_files):
    """Two passes from row 100 on; batch and place are those the rows stand at in the sink's files."""
    path, want = long_files
    rows = QUERIES["ordered_stream"](spark, path).orderBy("batch", "place").collect()
    n = len(want) - 100
    assert [(r.cycle, r.global_seq) for r in rows] == [(k // n, 100 + k % n) for k in range(2 * n)]
    assert [r.batch + r.place for r in rows] == list(range(2 * n)) and len({r.batch for r in rows}) > 3
