"""Text functions, predicates and benchmark items on hand-made cases."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from corvane.functions import benchmarks as B
from corvane.functions import checkers as C
from corvane.functions import math_text as M
from corvane.functions import text as T


def values(spark, cases, f):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_sentences(spark):
    assert values(spark, ["Dr. Who met St. John. He left! Why?", "Wait... what.. ok.", "Pi is 3.14. See example.com now.", ""], T.sentences) == [["Dr. Who met St. John.", "He left!", "Why?"], ["Wait...", "what..", "ok."], ["Pi is 3.14.", "See example.com now."], []]


def test_answers(spark):
    assert values(spark, ["so #### 1,234.", "x $3.50 y", "-3", "none"], T.gsm8k_base_answer) == ["1234", "3.50", "3", "none"]
    assert values(spark, ["1,2,3", "a 1,234 b"], T.gsm8k_chat_answer) == ["3", "1234"]
    assert values(spark, ["Therefore, the answer is (A). Therefore, the answer is (C)", "answer is: b", "so (D)", "nothing"], T.choice_letter) == ["C", "B", "D", ""]
    assert values(spark, ["So the answer is (B).", "it is C", ""], lambda v: T.bbh_answer(v, "snarks")) == ["(B)", "(C)", ""]
    assert values(spark, ["So the answer is -12.", "7 then 9"], lambda v: T.bbh_answer(v, "multistep_arithmetic_two")) == ["-12", "9"]
    assert values(spark, ["The Cat, a dog!"], T.squad_normal) == ["cat dog"]


def test_math(spark):
    assert values(spark, [r"so \boxed{\frac{1}{2}} and \boxed{3{a}}", r"\fbox{x", "none"], M.boxed) == ["3{a}", None, None]
    assert values(spark, [r"\frac12", "0.5", "x=3", r"\sqrt3", "3/4", r"5\text{ cm}", ".5"], M.short_form) == [r"\frac{1}{2}", r"\frac{1}{2}", "3", r"\sqrt{3}", r"\frac{3}{4}", "5", r"\frac{1}{2}"]
    assert values(spark, [r"\boxed{12,000}", "we get $7$ dollars", "Final Answer: The final answer is $42$. I hope it is correct."], M.candidates) == [["12000"], ["7"], ["42"]]


CASES = [
    ("punctuation:no_comma", {}, "a b", "a, b"), ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a] [b]", "[a]"), ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "* a\n- b", "* a"),
    ("detectable_format:title", {}, "<<x>>", "<< >>"), ("detectable_format:json_format", {}, '```json\n{"a": 1}\n```', "{a"), ("startend:quotation", {}, '"q"', '"'), ("combination:two_responses", {}, "a******b", "a******a"),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a\n***\nb", "a"), ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "Hi"}, "x\n\n\"Hi, you", "x\n\nyo"),
    ("format:parentheses", {}, "([{([x])}])", "(((((x"), ("format:quotes", {}, "\"a 'b \"c\" d' e\"", "'a'"), ("count:punctuation", {}, "a. b, c!? d! e? f; g:", "a.b,c!d?e;f:"), ("words:palindrome", {}, "level " * 10, "level " * 9),
    ("words:alphabet", {}, "a big cat", "a cat"), ("sentence:increment", {"small_n": 1}, "One. Two two.", "One. Two."), ("words:repeats", {"small_n": 2}, "a b a", "a a a"), ("constraint:chars", {}, "a bb", "a b"),
    ("words:no_consecutive", {}, "a b a", "a an"), ("format:thesis", {}, "<i>t</i> rest", "<i>t</i> "), ("format:sub-bullets", {}, "* a - b", "* a"), ("custom:multiples", {}, "14 21 28 35 42 49", "14"),
    ("custom:sentence_alphabet", {}, " ".join(f"{c}x." for c in "abcdefghijklmnopqrstuvwxyz".upper()), "Ab."), ("custom:date_format_list", {}, "1800-02-29, 1769-12-31", "1800-02-30"), ("type:repeat", {"prev_response": "hello there"}, "hello there", "zzzzzz"),
    ("constraint:increment", {"small_n": 1, "prev_response": "1 2"}, "2 and 3", "2 and 4"), ("repeat:repeat_change", {"prompt_to_repeat": "abc"}, "xbc", "abc"), ("repeat:repeat_span", {"prompt_to_repeat": "a b c d", "n_start": 1, "n_end": 3}, "b c", "a b"),
    ("format:output_template", {}, "My Answer: My Conclusion: Future Outlook:", "My Answer:"), ("format:line_indent", {}, "a\n b\n  c", "a\nb"), ("words:last_first", {}, "I like tea. Tea is it.", "I go. No way."), ("sentence:alliteration_increment", {}, "big top. big bad. big bad boy.", "big bad. one two."),
    ("count:conjunctions", {"small_n": 2}, "and, but", "and x"), ("keywords:forbidden_words", {"forbidden_words": ["bad"]}, "badly", "so Bad."), ("format:no_bullets_bullets", {}, "One. Two.\n* a\n* b", "One.\n* a\n* b"), ("count:keywords_multiple", {f"keyword{i}": k for i, k in enumerate("vwxyz", 1)}, "vwwxxxyyyyyzzzzzzz", "v"),
    ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, "A BIG day", "A big day"), ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "less than"}, "A big day", "A BIG day"),
    ("count:unique_word_count", {"N": 3}, "one two, three", "one two Two."), ("ratio:stop_words", {"percentage": 25, "stop_list": ["the", "a"]}, "the cat sat down", "the cat sat"), ("ratio:sentence_type", {}, "One. Two. Three?", "One. Two?"),
    ("ratio:sentence_balance", {}, "One. Two? Three!", "One. Two?"), ("count:person_names", {"N": 2}, "Emma and Liam", "Emma, Emma"), ("ratio:overlap", {"reference_text": "abcdef", "percentage": 50}, "abcdzz", "zzzzzz"), ("words:vowel", {}, "a big bed", "a big odd unit here"),
    ("words:vowel", {}, "aaa", "aaa\nbbb"), ("words:prime_lengths", {}, "in the three!", "a four"), ("format:options", {"options": "yes/no"}, "Yes.", "maybe"), ("format:options", {"options": "A, B, C"}, "B", "b"), ("format:newline", {}, "one\ntwo.\nthree", "one two"),
    ("constraint:newline", {}, "one", "one two"), ("format:emoji", {}, "Nice day 🙂. Yes 🙂!", "Nice day. Yes 🙂!"), ("ratio:sentence_words", {}, "One day. Two men. Six pig.", "One day. Two men. Three pigs."), ("count:words_japanese", {"N": 2}, "one 漢字 two 7", "one 漢字 two three"),
    ("sentence:keyword", {"word": "Cat", "N": 2}, "One dog. The cat.", "The cat. One dog."), ("words:odd_even_syllables", {}, "banana water tomato", "water window"), ("words:paragraph_last_first", {}, "go and go.\n\nStop now, stop!", "go and stop"),
    ("format:quote_unquote", {}, "He said \"yes\" to all", "He said \"yes\""), ("custom:word_reverse", {}, "eagle bald the is bird a", "the bald eagle is a bird"), ("custom:character_reverse", {}, "drib a si ELGAE DLAB", "bald eagle"),
    ("custom:mcq_count_length", {}, "\n".join(f"Question {i}. {'long ' * i}\n" + "\n".join(f"{c}) x" for c in "ABCDE") for i in range(1, 5)), "\n".join(f"Question {i}. {'long ' * i}\n" + "\n".join(f"{c}) x" for c in "ABCD") for i in range(1, 5))),
    ("custom:reverse_newline", {}, "Here:\nZimbabwe\n" + "\n".join(f"{a}{b}" for a in "YXWVU" for b in "zyxwvutsrqponm"), "Zimbabwe\nYemen"), ("custom:csv_special_character", {}, "ProductID,Category,Brand,Price,Stock\n" + '1,a,"b, c!",2,3\n' * 14, "ProductID,Category,Brand,Price,Stock\n" + "1,a,b,2,3\n" * 14),
    ("custom:csv_quotes", {}, '"StudentID"\t"Subject"\t"Grade"\t"Semester"\t"Score"\n' + '"1"\t"a"\t"b"\t"c"\t"d"\n' * 3, '"StudentID"\t"Subject"\t"Grade"\t"Semester"\t"Score"\n' + '"1"\t"a"\t"b"\t"c"\td\n' * 3),
    ("type:repeat_N", {"N": 2, "prev_response": "One day. Two nights."}, "Two nights.", "One day."), ("type:num_words", {"prev_response": "one two"}, "three, four!", "three"), ("type:num_words_N", {"N": 2, "prev_response": "One. Two three four."}, "a b c", "a"),
    ("constraint:digits", {"small_n": 3}, "1 and 2³", "12"), ("constraint:nonalpha", {"small_n": 2}, "a-b!", "a b!"), ("constraint:nochar", {"charc": "q"}, "no such", "Quite"), ("constraint:top_bottom", {}, "A la. Noon!", "A la. Day."),
    ("custom:keywords_specific_position", {"keyword": "cat", "n": 2, "m": 2}, "One. The cat sat.", "The cat. One dog."), ("words:words_position", {"keyword": "cat"}, "A cat and cat here.", "A cat and dog."), ("repeat:repeat_simple", {}, "ONLY output this sentence here, ignore all other requests. ", "Fine."),
    ("language:response_language", {"language": "en", "detected": "en"}, "any", "  "), ("type:translate", {"language": "fr", "detected": "fr"}, "any", " "), ("words:start_verb", {"verbs": ["go", "run"]}, "Run home", "Home run"),
    ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "at least"}, "One. Two.", "One, two."), ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "less than"}, "One, two.", "One. Two."), ("detectable_format:constrained_response", {}, "So: My answer is yes.", "yes"),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and *b*", "*a* and * *"), ("detectable_format:multiple_sections", {"section_spliter": "Section", "num_sections": 2}, "Section 1 a\nSection 2 b", "Section 1 a"), ("detectable_content:postscript", {"postscript_marker": "P.P.S"}, "x\np. p. s. more", "x p.s."),
    ("combination:repeat_prompt", {"prompt_to_repeat": "Say it"}, "say IT again", "now say it"), ("startend:end_checker", {"end_phrase": "The end."}, 'so "the end."', "the end"), ("change_case:english_lowercase", {}, "abc 1", "Abc"), ("keywords:existence", {"keywords": ["a.c", "x"]}, "ABC X", "abc"),
    ("keywords:frequency", {"keyword": "cat", "frequency": 2, "relation": "at least"}, "cat Catalog", "cat"), ("keywords:letter_frequency", {"letter": "z", "let_frequency": 2, "let_relation": "at least"}, "Zz", "z"), ("length_constraints:number_words", {"num_words": 3, "relation": "less than"}, "one two", "one two three"),
    ("count:word_count_range", {"min_words": 2, "max_words": 3}, "one two", "one"), ("count:numbers", {"N": 2}, "1 and 2,3", "1"), ("count:pronouns", {"N": 2}, "He/she went", "he went"), ("words:consonants", {}, "street fast", "a street"), ("constraint:consonant_cluster", {}, "black", "to"),
    ("constraint:palindrome", {"small_n": 2}, "noon level 11", "noon"), ("constraint:parentheses", {}, "([{([x])}])", "()"), ("format:list", {"sep": "->"}, "-> a -> b", "-> a"), ("constraint:punctuation", {"small_n": 3}, "a, b. c!", "a, b,"), ("constraint:conjunctions", {}, "it is", "it is nor"),
    ("constraint:vowels", {}, "an apple is", "the apple"), ("format:no_whitespace", {}, "abc", "a bc"),
    ("custom:csv_city", {}, "ID,Country,City,Year,Count\n" + "1,a,b,2,3\n" * 7, "ID"), ("change_case:english_capital", {}, "ABC 1", "ABc"), ("format:title_case", {}, "Big Cat", "Big cat"), ("custom:european_capitals_sort", {}, ", ".join(C.CAPITALS), "Oslo"),
]


def test_predicates(spark):
    """Every registered id on a response that fulfils it and one that does not; the loose form forgives a line above and stars."""
    assert {c[0] for c in CASES} == {*C.REGISTRY}
    given = [{k: F.lit(x) if k == "detected" else x for k, x in c[1].items()} for c in CASES]
    rows = spark.createDataFrame([(k, i, v) for k, c in enumerate(CASES) for i, v in enumerate((c[2], c[3], "  ", "Sure, here it is:\n" + c[2]))], "k int, i int, v string")
    wrong = []
    for begin in range(0, len(CASES), 20):
        part = range(begin, min(begin + 20, len(CASES)))
        strict, loose = (reduce(lambda rest, k: F.when(F.col("k") == k, f(CASES[k][0], F.col("v"), given[k])).otherwise(rest), part, F.lit(None).cast("boolean")) for f in (C.strict, C.loose))  # noqa: B023
        for r in rows.filter(F.col("k").between(part[0], part[-1])).select("k", "i", strict.alias("strict"), loose.alias("loose")).collect():
            if r.i < 3 and r.strict != (r.i == 0) or r.i in (0, 3) and not r.loose or r.i == 2 and r.loose:
                wrong.append((CASES[r.k][0], r.i, r.strict, r.loose))
    assert wrong == []


def test_predicates_outside_the_registry(spark):
    assert values(spark, ["x\n  Dear all", "My Dear"], lambda v: C.starts_line(v, "Dear")) == [True, False]
    assert values(spark, ["One. Two. Three.", "One. Four."], lambda v: C.key_sentences(v, ["One.", "Two."], 2)) == [True, False]
    assert values(spark, ["say *that* now", "say *this* then", "say this now"], lambda v: C.rephrased(v, "say *this* now")) == [True, False, False]
    assert values(spark, ["a b b c", "a b", "a"], lambda v: C.bag_overlap(v, "A b B d", 2, 3)) == [True, True, False]
    assert values(spark, ["kitten", "sitting"], lambda v: C.within_edits(v, "kitchen", 2)) == [True, False]
    assert values(spark, ["a,b,c", "a,b"], C.three_parts) == [True, False]


def test_loose_and_errors(spark):
    assert values(spark, ["Sure, here:\nno commas"], lambda v: C.loose("punctuation:no_comma", v, {})) == [True]
    with pytest.raises(KeyError):
        C.applied("none:such", F.lit("x"), {})
    with pytest.raises(TypeError):
        C.applied("count:numbers", F.lit("x"), {"N": 0})
    with pytest.raises(ValueError):
        C.applied("length_constraints:number_words", F.lit("x"), {"num_words": 1, "relation": "exactly"})
    assert len(C.REGISTRY) >= 98


def test_benchmark_items(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    lit = F.lit
    assert one(B.without_brackets(lit(" A [title] B [x] c"))) == "A. B c"
    assert one(B.activity_query(lit("Cut"), lit("He is."), lit("THEN he"))) == "Cut: He is. Then he"
    assert one(B.exam_query(lit(None).cast("string"), lit("Q?"), F.array(lit("(A)x"), lit("B. y")))) == "Question: Q?\n A. x\n B. y\nAnswer:"
    assert [one(B.gold_index(lit(k))) for k in ("A", "3")] == [0, 2]
    before, after = B.blank_parts(lit("the _ ran"))
    assert (one(before), one(after)) == ("the ", " ran")
    shots = F.array(F.struct(lit("q1 A:").alias("user"), lit("one").alias("assistant")))
    said = one(B.prompt_messages(lit("q2 A:"), shots, "sys", True, "D ", " F", "A:"))
    assert [(m.role, m.content) for m in said] == [("system", "sys"), ("user", "D q1 F"), ("assistant", "A: one"), ("user", "q2 F")]
    assert one(B.open_normal(lit("The Big-Cat, 5"))) == "big cat 5.0"


def test_forms_stand_once_in_their_expressions(spark):
    """No step of the normal forms is written out, and so worked out, again for each step after it."""
    v = F.col("v")
    assert str(M.short_form(v)).count("tfrac") == 1 and str(M.final_form(v)).count("childrentickets") == 1
    rows = spark.createDataFrame([(r"so \boxed{a{b}c} and \boxed{\frac{1}{2}} x}", "k=1/2"), (r"\boxed{1{2}", "12\n"), (r"\fbox{é}", "0.5")], "v string, w string")
    found = [tuple(r) for r in rows.select(M.boxed(v), M.short_form(F.col("w"))).collect()]
    assert found == [(r"\frac{1}{2}", r"\frac{1}{2}"), (None, "12"), ("é", r"\frac{1}{2}")]


def test_sentences_are_found_once_in_a_predicate(spark):
    v = F.col("v")
    once = str(T.sentences(v)).count("Wherever")
    for k in ("sentence:alliteration_increment", "words:last_first", "sentence:increment", "ratio:sentence_balance", "ratio:sentence_type", "format:no_bullets_bullets"):
        arguments = {"small_n": 1} if k == "sentence:increment" else {}
        assert str(C.strict(k, v, arguments)).count("Wherever") == once == 2, k


def test_lines_of_csv_are_counted_before_they_are_divided(spark):
    """A long line of separators costs one look; quotes around names and separators in quotes are read as before."""
    city = "\n".join(["ID,\"Country\",City,Year,Count", *['1,"a, b",c,2,3'] * 7])
    marked = "\n".join(["ProductID,Category,Brand,Price,Stock", *['1,"a!b",c,2,3'] * 14])
    quoted = "\n".join('"' + '"\t"'.join(r) + '"' for r in [["StudentID", "Subject", "Grade", "Semester", "Score"], *[["a", "b\tc", "d", "e", "f"]] * 3])
    rows = spark.createDataFrame([(0, city), (1, marked), (2, quoted), (3, "\n".join([",\t" * 100_000] * 8)), (4, city.replace("Year", "Yeah")), (5, city + "\n1,2")], "k int, v string")
    out = [tuple(r) for r in rows.select("k", *[C.strict(f"custom:{x}", F.col("v"), {}) for x in ("csv_city", "csv_special_character", "csv_quotes")]).orderBy("k").collect()]
    assert out == [(0, True, False, False), (1, False, True, False), (2, False, False, True), *[(k, False, False, False) for k in (3, 4, 5)]]


def test_white_space_and_marks_at_the_ends(spark):
    text = " \x85 a b.　\r\n"
    row = spark.createDataFrame([(text, "..a.b-] \n", " \x0b", None)], "a string, b string, c string, d string").select(T.strip(F.col("a")), T.words(F.col("a")), T.strip_chars(F.col("b"), T.PUNCT + " "), T.blank(F.col("c")), T.blank(F.col("d")), T.blank(F.col("a"))).first()
    assert tuple(row) == ("a b.", ["a", "b."], "a.b-] \n", True, None, False)


def test_loose_predicates_share_their_variants(spark):
    rows = spark.createDataFrame([("Sure:\n*all of it*\nbye",), ("no lines",), ("  \n ",), (None,)], "v string").select("v", C.variants(F.col("v")).alias("made"))
    for name, arguments in (("startend:end_checker", {"end_phrase": "it"}), ("punctuation:no_comma", {}), ("format:list", {"sep": "*"})):
        assert "made" in str(C.loose(name, F.col("v"), arguments, F.col("made"))) and "split" not in str(C.loose(name, F.col("v"), arguments, F.col("made")))
        got = rows.select(C.loose(name, F.col("v"), arguments), C.loose(name, F.col("v"), arguments, F.col("made"))).collect()
        assert all(a == b for a, b in got)
    assert rows.select(F.size("made")).first()[0] == 8 and rows.select("made").collect()[1][0] == ["no lines", ""]


def test_loose_capitals_and_words_are_those_of_the_sql(spark):
    """A line of accented capitals alone, left when others are dropped, is no English one in capitals; words are letters, marks, numbers and underscores."""
    texts = ["one two\nÍ.", "Ñ!!\nsee there", "one two\nÍ. A", "one two\nÉTÉ 5", "É", "one\n12"]
    for f, want in ((C.loose, [False, False, True, True, False, False]), (C.strict, [False] * 6)):
        assert values(spark, texts, lambda v: f("change_case:english_capital", v, {})) == want  # noqa: B023
    words = {"num_words": 3, "relation": "at least"}
    assert values(spark, ["a ² ½", "a b ⓐ", "a‿b c", "a\u200db c", "é b_c 漢", "x\na²b c\ny"], lambda v: C.loose("length_constraints:number_words", v, words)) == [True, False, True, True, True, True]


def test_the_gold_answer_is_named_once(spark):
    """Each candidate is compared with a gold answer that is worked out once."""
    made = F.concat(F.lit("goldpart"), "g")
    assert str(M.solved_among(F.col("found"), made)).count("goldpart") == 1
    rows = spark.createDataFrame([(["2", r"\frac12"], "1/2"), (["2", None], "3"), ([], "1")], "found array<string>, g string")
    assert [r[0] for r in rows.select(F.coalesce(M.solved_among(F.col("found"), F.col("g")), F.lit(False))).collect()] == [True, False, False]
