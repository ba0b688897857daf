"""Instruction predicates by registry id, as column expressions, with strict and loose evaluation."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import reduce
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as T

Check = Callable[..., Column]
REGISTRY: dict[str, Check] = {}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Fixed values.
CONJUNCTIONS = ["and", "but", "for", "nor", "or", "so", "yet"]
PRONOUNS = ["i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves"]
NAMES = ["Emma", "Liam", "Sophia", "Jackson", "Olivia", "Noah", "Ava", "Lucas", "Isabella", "Mason", "Mia", "Ethan", "Charlotte", "Alexander", "Amelia", "Benjamin", "Harper", "Leo", "Zoe", "Daniel", "Chloe", "Samuel", "Lily", "Matthew", "Grace", "Owen", "Abigail", "Gabriel", "Ella", "Jacob", "Scarlett", "Nathan", "Victoria", "Elijah", "Layla", "Nicholas", "Audrey", "David", "Hannah", "Christopher", "Penelope", "Thomas", "Nora", "Andrew", "Aria", "Joseph", "Claire", "Ryan", "Stella", "Jonathan"]
CAPITALS = ["Reykjavik", "Helsinki", "Oslo", "Tallinn", "Stockholm", "Riga", "Moscow", "Copenhagen", "Vilnius", "Minsk", "Dublin", "Berlin", "Amsterdam", "Warsaw", "London", "Brussels", "Prague", "Luxembourg", "Paris", "Vienna", "Bratislava", "Budapest", "Vaduz", "Chisinau", "Bern", "Ljubljana", "Zagreb"]
CANNED = ("My answer is yes.", "My answer is no.", "My answer is maybe.")
HEADINGS = ("My Answer:", "My Conclusion:", "Future Outlook:")


def check(*ids: str) -> Callable[[Check], Check]:
    def add(f: Check) -> Check:
        REGISTRY.update(dict.fromkeys(ids, f))
        return f

    return add


def _relation(n: Column, relation: str, than: int) -> Column:
    if relation not in ("less than", "at least"):
        raise ValueError(f"relation must be 'less than' or 'at least', not {relation!r}")
    return n < than if relation == "less than" else n >= than


def _count(v: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)))


def _all(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.forall(xs, f)


def _pairs(xs: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Whether f holds for each element and the next."""
    return T.once(xs, lambda xs: _pairs_of(xs, f))


def _pairs_of(xs: Column, f: Callable[[Column, Column], Column]) -> Column:
    n = F.size(xs)
    both = F.zip_with(F.slice(xs, 1, F.greatest(n - 1, F.lit(0))), F.slice(xs, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.coalesce(f(a, b), F.lit(False)))
    return (n < 2) | F.forall(both, lambda x: x)


def _bare_words(v: Column, lower: bool = True) -> Column:
    """Words without punctuation at their ends; none of them empty."""
    return T.cores(F.lower(v) if lower else v)


def _plain_words(v: Column) -> Column:
    return T.words(T.without_punctuation(F.lower(v)))


def _n_words(v: Column) -> Column:
    r"""Runs of letters, marks, numbers and underscores; ``(?U)\w`` lacks numbers such as ² and ½, and has joiners, ties and circled letters."""
    return _count(v, r"[\p{L}\p{M}\p{N}_]+")


def _chars(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


@check("length_constraints:number_sentences")
def number_sentences(v, num_sentences, relation, counted=None):
    """By the rule splitter, or ``counted``: a column with the number that ``operators.sentences`` found by learned abbreviations."""
    return _relation(F.size(T.sentences(v)) if counted is None else counted, relation, num_sentences)


@check("length_constraints:number_words")
def number_words(v, num_words, relation):
    return _relation(_n_words(v), relation, num_words)


@check("length_constraints:number_paragraphs")
def number_paragraphs(v, num_paragraphs):
    def divided(parts: Column) -> Column:
        inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
        return ~F.exists(inner, lambda p: p == "") & (F.size(F.filter(parts, lambda p: p != "")) == num_paragraphs)

    parts = F.transform(F.split(v, r"\s?\*\*\*\s?", -1), T.strip)
    return F.when(v.contains("***"), T.once(parts, divided)).otherwise((~T.blank(v)).cast("int") == num_paragraphs)


@check("length_constraints:nth_paragraph_first_word")
def nth_paragraph_first_word(v, num_paragraphs, nth_paragraph, first_word):
    parts = F.split(v, "\n\n", -1)
    filled = F.size(F.filter(parts, lambda p: T.strip(p) != ""))
    word = F.get(T.words(F.get(parts, F.lit(nth_paragraph - 1))), F.lit(0))
    word = F.lower(F.regexp_extract(F.regexp_replace(F.regexp_replace(word, "^'+", ""), '^"+', ""), r"""^[^.,?!'"]*""", 0))
    return (filled == num_paragraphs) & (filled >= nth_paragraph) & F.coalesce(word == first_word.lower(), F.lit(False))


@check("detectable_content:number_placeholders")
def number_placeholders(v, num_placeholders):
    return _count(v, r"(?d)\[.*?\]") >= num_placeholders


@check("detectable_content:postscript")
def postscript(v, postscript_marker):
    marker = postscript_marker.strip()
    # What may stand before and after the two usual ones decides nothing.
    pattern = {"P.P.S": r"p\.\s?p\.\s?s", "P.S.": r"p\.\s?s\."}.get(marker, r"(?dm)\s*" + marker.lower() + ".*$")
    return F.lower(v).rlike(pattern)


@check("detectable_format:number_bullet_lists")
def number_bullets(v, num_bullets):
    return _count(v, r"(?dm)^\s*\*[^\*].*$") + _count(v, r"(?dm)^\s*-.*$") == num_bullets


@check("detectable_format:constrained_response")
def constrained_response(v):
    return reduce(lambda a, b: a | b, [T.strip(v).contains(x) for x in CANNED])


@check("detectable_format:number_highlighted_sections")
def highlights(v, num_highlights):
    single = F.filter(F.regexp_extract_all(v, F.lit(r"\*[^\n\*]*\*"), F.lit(0)), lambda x: T.strip(T.strip_chars(x, "*")) != "")
    double = F.filter(F.regexp_extract_all(v, F.lit(r"\*\*[^\n\*]*\*\*"), F.lit(0)), lambda x: T.strip(F.substring(x, F.lit(3), F.length(x) - 4)) != "")
    return F.size(single) + F.size(double) >= num_highlights


@check("detectable_format:multiple_sections")
def multiple_sections(v, section_spliter, num_sections):
    return F.size(F.split(v, r"\s?" + section_spliter.strip() + r"\s?\d+\s?", -1)) - 1 >= num_sections


@check("detectable_format:json_format")
def json_format(v):
    bare = T.strip(v)
    for fence in ("```json", "```Json", "```JSON", "```"):
        bare = F.regexp_replace(bare, "^" + fence, "")
    return F.try_parse_json(T.strip(F.regexp_replace(bare, "```$", ""))).isNotNull()


@check("detectable_format:title")
def title(v):
    return F.exists(F.regexp_extract_all(v, F.lit(r"<<[^\n]+>>"), F.lit(0)), lambda x: T.strip(F.regexp_replace(x, "^<+|>+$", "")) != "")


@check("keywords:existence")
def keywords(v, keywords):
    return reduce(lambda a, b: a & b, [v.rlike("(?i)" + k) for k in keywords], F.lit(True))


@check("keywords:frequency")
def keyword_frequency(v, keyword, frequency, relation):
    return _relation(_count(v, "(?i)" + keyword.strip()), relation, frequency)


@check("keywords:forbidden_words")
def forbidden_words(v, forbidden_words):
    return reduce(lambda a, b: a & b, [~v.rlike(r"(?iU)\b" + w + r"\b") for w in forbidden_words], F.lit(True))


@check("keywords:letter_frequency")
def letter_frequency(v, letter, let_frequency, let_relation):
    return _relation(T.count_of(F.lower(v), letter.strip().lower()), let_relation, let_frequency)


@check("combination:two_responses")
def two_responses(v):
    return T.once(F.transform(F.split(v, r"\*{6}", -1), T.strip), _two_parts)


def _two_parts(parts: Column) -> Column:
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    filled = F.filter(parts, lambda p: p != "")
    return ~F.exists(inner, lambda p: p == "") & (F.size(filled) == 2) & F.coalesce(F.get(filled, F.lit(0)) != F.get(filled, F.lit(1)), F.lit(False))


@check("combination:repeat_prompt")
def repeat_prompt(v, prompt_to_repeat):
    return T.strip(F.lower(v)).startswith(prompt_to_repeat.strip().lower())


@check("startend:end_checker")
def end_phrase(v, end_phrase):
    return F.lower(T.strip_chars(T.strip(v), '"')).endswith(end_phrase.strip().lower())


@check("startend:quotation")
def quotation(v):
    v = T.strip(v)
    return (F.length(v) > 1) & v.startswith('"') & v.endswith('"')


@check("change_case:english_capital")
def english_capital(v):
    """Case alone, of a response with one of the letters A to Z at least; the language is not detected here."""
    return (v == F.upper(v)) & v.rlike("[A-Z]")


@check("change_case:english_lowercase")
def english_lowercase(v):
    """Case alone; the language is not detected here."""
    return (v == F.lower(v)) & v.rlike(r"\p{Ll}")


@check("change_case:capital_word_frequency")
def capital_words(v, capital_frequency, capital_relation):
    """Words are runs of characters other than white space, punctuation at their ends apart."""
    capital = F.regexp_extract_all(v, F.lit(rf"(?<![^{T.SPACE}])[^{T.SPACE}\p{{Lu}}]*+\p{{Lu}}[^{T.SPACE}]*+"), F.lit(0))
    return _relation(F.size(F.filter(capital, lambda w: w == F.upper(w))), capital_relation, capital_frequency)


@check("punctuation:no_comma")
def no_comma(v):
    return ~v.contains(",")


@check("count:word_count_range")
def word_count_range(v, min_words, max_words):
    return _n_words(v).between(min_words, max_words)


@check("count:unique_word_count")
def unique_words(v, N):
    """Words of punctuation alone count as one."""
    marks = v.rlike(rf"(?<![^{T.SPACE}])\p{{Punct}}++(?![^{T.SPACE}])")
    return F.size(F.array_distinct(_bare_words(v))) + marks.cast("int") >= N


@check("ratio:stop_words")
def stop_words(v, percentage, stop_list):
    """``stop_list``: the stop words, which come from outside."""
    tokens = F.regexp_extract_all(F.lower(v), F.lit(r"(?U)\w+"), F.lit(0))
    share = T.once(tokens, lambda t: F.try_divide(F.size(F.filter(t, lambda w: w.isin(*stop_list))) * F.lit(100.0), F.size(t)))
    return F.coalesce(share <= percentage, F.lit(False))


def _ending(sentences: Column, mark: str) -> Column:
    return F.size(F.filter(sentences, lambda s: s.endswith(mark)))


@check("ratio:sentence_type")
def sentence_type(v):
    return T.once(T.sentences(v), lambda s: _ending(s, ".") == 2 * _ending(s, "?"))


@check("ratio:sentence_balance")
def sentence_balance(v):
    return T.once(T.sentences(v), lambda s: (_ending(s, ".") == _ending(s, "?")) & (_ending(s, ".") == _ending(s, "!")))


@check("ratio:sentence_words")
def sentence_lengths(v):
    return T.once(T.sentences(v), lambda s: (F.size(s) == 3) & (F.size(F.array_distinct(F.transform(s, lambda x: F.length(T.strip(x))))) == 1))


@check("count:conjunctions")
def conjunctions(v, small_n):
    found = rf"(?i)(?<![^{T.SPACE}])\p{{Punct}}*+(?:{'|'.join(CONJUNCTIONS)})\p{{Punct}}*+(?![^{T.SPACE}])"
    return F.size(F.array_distinct(F.regexp_extract_all(v, F.lit(found), F.lit(0)))) >= small_n


@check("count:person_names")
def person_names(v, N):
    return F.size(F.filter(F.array(*map(F.lit, NAMES)), lambda n: v.contains(n))) >= N


def _trigrams(v: Column) -> Column:
    """Distinct runs of three characters; none of a shorter text."""
    return F.array_distinct(F.regexp_extract_all(v, F.lit("(?s)(?=(...))."), F.lit(1)))


@check("ratio:overlap")
def overlap(v, reference_text, percentage):
    b = _trigrams(F.lit(reference_text))
    return F.coalesce(T.once(_trigrams(v), lambda a: F.abs(F.try_divide(F.size(F.array_intersect(a, b)) * F.lit(100.0), F.size(a)) - percentage) <= 2), F.lit(False))


@check("count:numbers")
def numbers(v, N):
    return _count(T.without_punctuation(v), r"\d+") == N


@check("words:alphabet")
def alphabet_loop(v):
    w = F.filter(F.transform(T.words(without_ends(v)), lambda x: F.lower(T.strip_chars(x, T.PUNCT + " "))), lambda x: x != "")
    at = lambda x: F.instr(F.lit(LETTERS), F.substring(x, 1, 1))
    return _pairs(w, lambda a, b: (at(a) > 0) & (at(a) % 26 + 1 == at(b)))


def without_ends(v: Column) -> Column:
    return F.translate(v, T.PUNCT, "")


@check("words:vowel")
def few_vowels(v):
    return (F.size(F.split(T.strip(v), "\n", -1)) == 1) & (F.size(F.array_distinct(F.filter(_chars(F.lower(v)), lambda c: c.isin(*"aeiou")))) <= 3)


@check("words:consonants", "constraint:consonant_cluster")
def consonant_cluster(v):
    return _all(_plain_words(v), lambda w: w.rlike("[bcdfghj-np-tv-z]{2}"))


@check("sentence:alliteration_increment")
def alliteration(v):
    def score(s: Column) -> Column:
        return T.once(F.filter(F.transform(T.words(F.lower(s)), lambda x: F.regexp_replace(x, r"^[\p{Punct} ]+", "")), lambda x: x != ""), runs)

    def runs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        same = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.substring(a, 1, 1) == F.substring(b, 1, 1))
        zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("run"))
        return F.aggregate(same, zero, lambda st, x: F.struct((st["n"] + F.when(x, F.when(st["run"], 1).otherwise(2)).otherwise(0)).alias("n"), x.alias("run")), lambda st: st["n"])

    return _pairs(F.transform(T.sentences(v), score), lambda a, b: a < b)


@check("words:palindrome")
def palindromes(v):
    return F.size(F.filter(_plain_words(v), lambda w: (w == F.reverse(w)) & (F.length(w) >= 5))) >= 10


@check("constraint:palindrome")
def palindrome_count(v, small_n):
    return F.size(F.filter(_plain_words(v), lambda w: (w == F.reverse(w)) & ~w.rlike(r"^\d+$"))) == small_n


@check("count:punctuation")
def punctuation_cover(v):
    rest = F.when(v.contains("?!"), F.regexp_replace(v, r"(?s)^(.*?)\?!", "$1")).otherwise(F.regexp_replace(v, r"(?s)^(.*?)!\?", "$1"))
    return v.rlike(r"!\?|\?!|‽") & reduce(lambda a, b: a & b, [rest.contains(c) for c in ".,!?;:"])


def _stack_machine(v: Column, step: Callable[[Column, Column], Column], init: Column) -> Column:
    return F.aggregate(_chars(v), init, step, lambda s: s["done"])


@check("format:parentheses", "constraint:parentheses")
def nested_brackets(v):
    """Open brackets are kept as a string, the last one last."""
    init = F.struct(F.lit("").alias("open"), F.lit(0).alias("deep"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        last = F.substring(s["open"], -1, 1)
        fits = ((last == "(") & (c == ")")) | ((last == "[") & (c == "]")) | ((last == "{") & (c == "}"))
        opens, closes = c.isin("(", "[", "{"), c.isin(")", "]", "}")
        pushed = F.concat(s["open"], c)
        popped = F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)
        now = F.when(opens, pushed).when(closes & fits, popped).when(closes, F.lit("")).otherwise(s["open"])
        deep = F.when(opens, F.greatest(s["deep"], F.length(pushed))).when(closes & ~fits, F.lit(0)).otherwise(s["deep"])
        return F.struct(now.alias("open"), deep.alias("deep"), (s["done"] | closes & fits & (s["deep"] >= 5) & (F.length(popped) < s["deep"])).alias("done"))

    return F.when(v.rlike(r"[(\[{]"), _stack_machine(F.regexp_replace(v, r"[^()\[\]{}]", ""), step, init)).otherwise(F.lit(False))


@check("format:quotes")
def nested_quotes(v):
    init = F.struct(F.lit("").alias("open"), F.lit(0).alias("deep"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        closes = (s["open"] != "") & (F.substring(s["open"], -1, 1) == c)
        now = F.when(closes, F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)).otherwise(F.concat(s["open"], c))
        return F.struct(now.alias("open"), F.greatest(s["deep"], F.length(now)).alias("deep"), (s["done"] | closes & (s["deep"] - F.length(now) >= 3)).alias("done"))

    return _stack_machine(F.regexp_replace(v, "[^\"']", ""), step, init)


@check("words:prime_lengths")
def prime_lengths(v):
    primes = [p for p in range(2, 100) if all(p % q for q in range(2, p))]
    return _all(T.words(T.without_punctuation(v)), lambda w: F.length(w).isin(*primes))


@check("format:options")
def options(v, options):
    split = [x.strip() for x in options.split("/" if "/" in options else "or" if "or" in options else ",")]
    if re.match(r"\W*[aA]\W*[bB]\W*[cC]\W*", options):
        return v.isin(*split)
    return F.lower(T.strip_chars(v, T.PUNCT + " ")).isin(*[x.strip(T.PUNCT + " ").lower() for x in split])


@check("format:newline", "constraint:newline")
def word_a_line(v):
    v = T.strip(T.without_punctuation(v))
    return F.size(F.filter(F.split(v, "\n", -1), lambda x: x != "")) == F.size(T.words(v))


@check("format:emoji")
def emoji(v):
    """Each sentence ends with a pictograph, or the next begins with one."""
    pictograph = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"

    def ends(s: Column) -> Column:
        after = F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.lit("")))
        return F.zip_with(s, after, lambda x, y: T.strip_chars(x, T.PUNCT + " ").rlike(pictograph + r"\x{FE0F}?$") | F.coalesce(y, F.lit("")).rlike("^" + pictograph))

    return _all(F.transform(F.array(T.sentences(v)), ends)[0], lambda x: x)


@check("count:words_japanese")
def words_japanese(v, N):
    return _all(F.filter(T.words(v), lambda w, i: (i + 1) % N == 0), lambda w: w.rlike(r"[぀-ヿ一-鿿]|^\d+$"))


@check("words:repeats")
def word_repeats(v, small_n):
    def repeated(w: Column) -> Column:
        n = F.greatest(F.size(w) - F.lit(small_n), F.lit(0))
        return F.exists(F.zip_with(F.slice(w, 1, n), F.slice(w, small_n + 1, n), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))

    return ~T.once(F.sort_array(_plain_words(v)), repeated)


@check("sentence:keyword")
def sentence_keyword(v, word, N):
    return F.coalesce(F.lower(F.get(T.sentences(v), F.lit(N - 1))).contains(word.lower()), F.lit(False))


@check("count:pronouns")
def pronouns(v, N):
    return F.size(F.filter(_plain_words(F.translate(v, "/", " ")), lambda w: w.isin(*PRONOUNS))) >= N


@check("words:last_first")
def last_first(v):
    w = F.transform(T.sentences(v), lambda s: T.words(F.lower(T.strip_chars(s, T.PUNCT + " "))))
    return _pairs(w, lambda a, b: T.strip_chars(F.try_element_at(a, F.lit(-1)), T.PUNCT) == T.strip_chars(F.try_element_at(b, F.lit(1)), T.PUNCT))


@check("words:paragraph_last_first")
def paragraph_ends(v):
    lines = F.filter(F.transform(F.split(F.lower(v), "\n", -1), lambda x: T.words(T.strip_chars(x, T.PUNCT + " "))), lambda w: F.size(w) > 0)
    return _all(lines, lambda w: F.try_element_at(w, F.lit(1)) == F.try_element_at(w, F.lit(-1)))


@check("sentence:increment")
def word_increment(v, small_n):
    n = F.transform(T.sentences(v), lambda s: F.size(T.words(T.without_punctuation(s))))
    return _pairs(n, lambda a, b: b == a + small_n)


@check("words:no_consecutive")
def no_consecutive(v):
    return ~T.without_punctuation(F.lower(v)).rlike(rf"(?<![^{T.SPACE}])([^{T.SPACE}])[^{T.SPACE}]*+{T.SPACE}++\1")


@check("format:line_indent")
def line_indent(v):
    """Blank lines go, but the line after one that went is passed over while they are looked for."""
    lines = F.split(v, "\n", -1)
    zero = F.struct(F.lit(-1).alias("last"), F.lit(False).alias("skip"), F.lit(True).alias("rises"))

    def step(s: Column, x: Column) -> Column:
        gone = ~s["skip"] & T.blank(x)
        at = F.length(x) - F.length(F.ltrim(x, F.lit(T.WHITE)))
        return F.struct(F.when(gone, s["last"]).otherwise(at).alias("last"), gone.alias("skip"), (s["rises"] & (gone | (at > s["last"]))).alias("rises"))

    return F.aggregate(lines, zero, step, lambda s: s["rises"])


@check("format:quote_unquote")
def quote_unquote(v):
    v = F.regexp_replace(F.replace(F.translate(v, "“”", '""'), F.lit("'\"'"), F.lit("")), r"(?U)\s+", "")
    bare = F.regexp_replace(v, r"^[\d\p{Punct}&&[^\"]]+|[\d\p{Punct}&&[^\"]]+$", "")
    return ~v.contains('""') & (bare != "") & ~bare.endswith('"')


@check("format:list")
def special_bullets(v, sep):
    return T.count_of(v, sep) >= 2


@check("format:thesis")
def thesis(v):
    rest = F.when(v.contains("<i>"), F.substring(v, F.instr(v, "<i>"), F.length(v))).when(v.contains("<em>"), F.substring(v, F.instr(v, "<em>"), F.length(v)))
    end = F.when(rest.contains("</i>"), F.instr(rest, "</i>")).when(rest.contains("</em>"), F.instr(rest, "</em>"))
    return F.coalesce((T.strip(F.substring(rest, F.lit(4), end - 4)) != "") & (T.strip(F.substring(rest, end + 4, F.length(rest))) != ""), F.lit(False))


@check("format:sub-bullets")
def sub_bullets(v):
    parts = F.split(v, r"\*", -1)
    return _all(F.slice(parts, 2, F.size(parts)), lambda x: x.contains("-"))


@check("format:no_bullets_bullets")
def sentences_then_bullets(v):
    """State: whether text may still come, sentences, bullets, whether it failed."""
    zero = F.struct(F.lit(True).alias("text"), F.lit(0).alias("s"), F.lit(0).alias("b"), F.lit(False).alias("bad"))

    def step(st: Column, line: Column) -> Column:
        bullet = T.strip(line).startswith("*")
        bad = st["bad"] | F.when(bullet, st["s"] < 2).otherwise(~st["text"])
        # A line's sentences count while text may come and nothing has failed.
        n = F.when(~bullet & st["text"] & ~bad, F.size(T.sentences(T.strip(line)))).otherwise(0)
        return T.once(n, lambda n: F.struct((n > 0).alias("text"), (st["s"] + n).alias("s"), (st["b"] + bullet.cast("int")).alias("b"), bad.alias("bad")))

    return F.aggregate(F.split(v, "\n", -1), zero, step, lambda st: ~st["bad"] & (st["b"] >= 2))


@check("custom:multiples")
def multiples(v):
    return F.regexp_extract_all(v, F.lit(r"\d+"), F.lit(0)) == F.array(*[F.lit(str(x)) for x in range(14, 50, 7)])


@check("custom:mcq_count_length")
def four_questions(v):
    questions = F.filter(F.transform(F.split(v, r"\n*(?:Question \d+[\.|\):;]?\s*)", -1), T.strip), lambda q: q != "")
    option = r"^[A-Ea-e][\.|\)]\s*\w+"
    lines = lambda q: F.transform(F.split(q, "\n", -1), T.strip)
    n_options = lambda q: F.size(F.filter(lines(q), lambda x: x.rlike(option)))
    stem = lambda q: F.aggregate(lines(q), F.struct(F.lit("").alias("t"), F.lit(False).alias("done")), lambda s, x: F.struct(F.when(x.rlike(option) | s["done"], s["t"]).otherwise(F.concat(s["t"], F.lit(" "), x)).alias("t"), (s["done"] | x.rlike(option)).alias("done")), lambda s: F.length(T.strip(s["t"])))
    return v.startswith("Question") & (F.size(questions) == 4) & _all(questions, lambda q: n_options(q) == 5) & _pairs(F.transform(questions, stem), lambda a, b: a < b)


_FOLD = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")


def _ascii(v: Column) -> Column:
    """Latin letters without their marks; other characters beyond ASCII go."""
    return F.regexp_replace(F.translate(v, *_FOLD), r"[^\x00-\x7F]", "")


@check("custom:reverse_newline")
def reverse_lines(v):
    lines = F.filter(F.transform(F.split(v, "\n", -1), lambda x: T.strip_chars(x, T.PUNCT + " ")), lambda x: x != "")
    hit = F.array_position(F.transform(lines, lambda x: x.contains("Zimbabwe")), True)
    rest = F.transform(F.slice(lines, F.greatest(hit.cast("int"), F.lit(1)), F.size(lines)), _ascii)
    return (hit > 0) & (F.size(rest) >= 52) & (rest == F.sort_array(rest, False))


@check("custom:word_reverse")
def word_reverse(v):
    said = F.array_join(F.reverse(T.words(T.without_punctuation(F.lower(T.strip(v))))), " ")
    return said.contains("bald eagle") & (F.size(T.sentences(F.array_join(F.reverse(T.words(v)), " "))) == 1)


@check("custom:character_reverse")
def character_reverse(v):
    return F.lower(v).contains("elgae dlab")


@check("custom:sentence_alphabet")
def sentence_alphabet(v):
    s = T.sentences(v)
    firsts = F.transform(s, lambda x: F.substring(F.lower(F.get(T.words(x), F.lit(0))), 1, 1))
    return F.coalesce(firsts == F.array(*map(F.lit, LETTERS)), F.lit(False))


@check("custom:european_capitals_sort")
def capitals(v):
    return F.filter(F.transform(F.split(_ascii(v), ",", -1), T.strip), lambda x: x != "") == F.array(*map(F.lit, CAPITALS))


def _csv(v: Column, sep: str, n: int, header: list[str], holds: Callable[[Column], Column]) -> Column:
    """``holds`` of n rows of fields, quotes kept: a separator inside quotes divides nothing.

    A field looks for quotes up to its line's end, so lines are counted, and the first one read without quotes, before any is divided.
    """

    def fields(lines: Column) -> Column:
        rows = F.transform(lines, lambda r: F.split(r, sep + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
        likely = (F.size(lines) == n) & F.coalesce(F.translate(F.get(lines, F.lit(0)), '"', "") == sep.join(header), F.lit(False))
        return F.when(likely, T.once(rows, holds)).otherwise(F.lit(False))

    return T.once(F.filter(F.split(v, r"\r?\n", -1), lambda r: r != ""), fields)


_BARE = r'^"|"$'


def _headed(rows: Column, names: list[str], quotes: str) -> Column:
    return F.coalesce(F.transform(F.get(rows, F.lit(0)), lambda x: F.regexp_replace(x, quotes, "")) == F.array(*map(F.lit, names)), F.lit(False))


@check("custom:csv_city")
def csv_city(v):
    names = ["ID", "Country", "City", "Year", "Count"]
    return _csv(v, ",", 8, names, lambda rows: _headed(rows, names, _BARE) & _all(rows, lambda r: F.size(r) == 5))


@check("custom:csv_special_character")
def csv_special(v):
    names = ["ProductID", "Category", "Brand", "Price", "Stock"]
    return _csv(v, ",", 15, names, lambda rows: _headed(rows, names, _BARE) & _all(rows, lambda r: F.size(r) == 5) & F.exists(rows, lambda r: F.exists(r, lambda x: x.rlike(r'^".*[^\w\s"].*"$'))))


@check("custom:csv_quotes")
def csv_quotes(v):
    names = ["StudentID", "Subject", "Grade", "Semester", "Score"]
    return _csv(v, "\t", 4, names, lambda rows: _headed(rows, names, '"') & _all(rows, lambda r: (F.size(r) == 5) & _all(r, lambda x: x.startswith('"') & x.endswith('"'))))


@check("custom:date_format_list")
def date_list(v):
    def good(d: Column) -> Column:
        part = lambda k: F.regexp_extract(d, r"^(\d{4})-(\d{2})-(\d{2})$", k).try_cast("int")
        y, m, day = part(1), part(2), part(3)
        most = F.when(m == 2, 29).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.coalesce(y.between(1769, 1821) & m.between(1, 12) & (day >= 1) & (day <= most), F.lit(False))

    return _all(F.transform(F.split(T.strip(v), ",", -1), T.strip), good)


@check("type:repeat")
def repeat(v, prev_response):
    b = _trigrams(F.lit(prev_response))
    return T.once(_trigrams(v), lambda a: (F.size(a) == 0) | F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)) > 0.7, F.lit(False)))


@check("type:repeat_N")
def repeat_sentence(v, N, prev_response):
    """Sentences by the rule splitter."""
    b = _trigrams(F.get(T.sentences(F.lit(prev_response)), F.lit(N - 1)))
    return F.coalesce(T.once(_trigrams(v), lambda a: (F.size(a) == 0) | (F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)) > 0.7)), F.lit(False))


def _n_plain(v: Column) -> Column:
    return F.size(T.words(T.without_punctuation(v)))


@check("type:num_words")
def same_words(v, prev_response):
    return _n_plain(v) == _n_plain(F.lit(prev_response))


@check("type:num_words_N")
def same_words_sentence(v, N, prev_response):
    """Sentences by the rule splitter."""
    return F.coalesce(_n_plain(v) == _n_plain(F.get(T.sentences(F.lit(prev_response)), F.lit(N - 1))), F.lit(False))


@check("constraint:increment")
def increments(v, small_n, prev_response):
    whole = lambda t: F.regexp_extract_all(t, F.lit(rf"(?<![^{T.SPACE}])[+-]?+\d++(?![^{T.SPACE}])"), F.lit(0))

    def rise(both: Column) -> Column:
        n = F.least(F.size(both["before"]), F.size(both["now"]))
        return F.forall(F.zip_with(F.slice(both["before"], F.lit(1), n), F.slice(both["now"], F.lit(1), n), lambda a, b: a.cast("long") + small_n == b.cast("long")), lambda x: x)

    return T.once(F.struct(whole(F.lit(prev_response)).alias("before"), whole(v).alias("now")), rise)


@check("constraint:digits")
def digits(v, small_n):
    return _count(v, r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]") == small_n


@check("constraint:nonalpha")
def non_alpha(v, small_n):
    return _count(v, r"[^\p{L}\p{N}\x20\t\n\r\x0B\f]") == small_n


@check("constraint:chars")
def different_lengths(v):
    n = F.transform(T.words(T.without_punctuation(v)), lambda w: F.length(w))
    return F.size(F.array_distinct(n)) == F.size(n)


@check("constraint:punctuation")
def punctuation_kinds(v, small_n):
    return F.size(F.array_distinct(F.regexp_extract_all(v, F.lit(r"\p{Punct}"), F.lit(0)))) >= small_n


@check("constraint:nochar")
def no_letter(v, charc):
    return ~F.lower(v).contains(charc)


@check("constraint:conjunctions")
def no_conjunctions(v):
    return ~F.lower(v).rlike("|".join(CONJUNCTIONS))


@check("constraint:vowels")
def vowel_starts(v):
    return _all(_plain_words(v), lambda w: w.rlike("^[aeiou]"))


@check("constraint:top_bottom")
def same_ends(v):
    """Sentences by the rule splitter."""
    s = F.transform(T.sentences(F.lower(v)), lambda x: T.strip_chars(x, T.PUNCT + " "))
    return _all(s, lambda x: F.substring(x, 1, 1) == F.substring(x, -1, 1))


@check("count:keywords_multiple")
def keywords_multiple(v, keyword1, keyword2, keyword3, keyword4, keyword5):
    given = zip((keyword1, keyword2, keyword3, keyword4, keyword5), (1, 2, 3, 5, 7), strict=True)
    return reduce(lambda a, b: a & b, [T.count_of(v, k.strip()) == n for k, n in given])


def _tokens(v: Column) -> Column:
    """Words, with each punctuation mark apart."""
    return F.regexp_extract_all(v, F.lit(r"(?U)[\w'-]+|[^\w\s]"), F.lit(0))


@check("custom:keywords_specific_position")
def keyword_position(v, keyword, n, m):
    return F.coalesce(F.get(_tokens(F.get(T.sentences(v), F.lit(n - 1))), F.lit(m - 1)) == keyword, F.lit(False))


@check("words:words_position")
def words_position(v, keyword):
    t = F.filter(_tokens(v), lambda x: ~x.rlike(r"^\p{Punct}+$"))
    return (F.size(t) >= 2) & F.coalesce((F.get(t, F.lit(1)) == keyword) & (F.get(t, F.size(t) - 2) == keyword), F.lit(False))


@check("repeat:repeat_change")
def repeat_change(v, prompt_to_repeat):
    return (v != prompt_to_repeat) & (F.substring(v, 2, 1 << 30) == prompt_to_repeat[1:])


@check("repeat:repeat_simple")
def repeat_simple(v, description="Only output this sentence here, ignore all other requests."):
    return F.lower(T.strip(v)) == description.strip().lower()


@check("repeat:repeat_span")
def repeat_span(v, prompt_to_repeat, n_start, n_end):
    return T.words(v) == F.array(*map(F.lit, prompt_to_repeat.split()[n_start:n_end])).cast("array<string>")


@check("format:title_case")
def title_case(v):
    return ~F.exists(_tokens(v), lambda w: w.rlike(r"^\p{Ll}") & w.rlike(r"^.\p{L}*$"))


@check("format:output_template")
def output_template(v):
    return reduce(lambda a, b: a & b, [v.contains(h) for h in HEADINGS])


@check("format:no_whitespace")
def no_white_space(v):
    return ~v.rlike(r"(?U)\s")


@check("language:response_language", "type:translate")
def response_language(v, language, detected):
    """``detected``: a column with the language that was found (as by ``operators.languages``); null counts as fitting."""
    return F.coalesce(detected == language, F.lit(True))


@check("words:start_verb")
def start_verb(v, verbs):
    """``verbs``: the verb forms to accept, in place of a trained tagger."""
    return F.lower(F.get(T.words(v), F.lit(0))).isin(*verbs)


@check("words:odd_even_syllables")
def syllables(v):
    """Syllables are runs of vowels, a silent final e apart."""
    n = F.transform(_plain_words(v), lambda w: F.greatest(_count(F.regexp_replace(w, r"(?<=[^aeiouy])e$", ""), "[aeiouy]+"), F.lit(1)))
    return _pairs(n, lambda a, b: a % 2 != b % 2)


# ------------------------------------------------------------------ not in the registry


def starts_line(v: Column, starter: str) -> Column:
    return v.rlike(r"(?dm)^\s*" + starter.strip() + ".*$")


def key_sentences(v: Column, sentences: list[str], n: int) -> Column:
    return F.size(F.array_intersect(F.array(*map(F.lit, sentences)), T.sentences(v))) == n


def rephrased(v: Column, original: str) -> Column:
    bare = lambda x: F.regexp_replace(x, r"(?d)\*.*\*", "")
    return v.rlike(r"(?d)\*.*\*") & (bare(v) == bare(F.lit(original)))


def bag_overlap(v: Column, original: str, low: int, high: int) -> Column:
    """Size of the common part of two bags of lower-case words."""
    tokens = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0))
    a, b = tokens(v), tokens(F.lit(original))
    times = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(times(a, w), times(b, w))).between(low, high)


def within_edits(v: Column, reference: str, n: int) -> Column:
    return F.levenshtein(v, F.lit(reference)) <= n


def three_parts(v: Column) -> Column:
    return F.size(F.split(v, ",", -1)) == 3


def named_countries(v: Column, places: list[str], n: int) -> Column:
    """At least n different places of a list stand in the response as whole words; the list takes the part of a trained tagger."""
    found = [F.when(v.rlike(rf"(?U)(?<!\w){re.escape(p)}(?!\w)"), F.lit(p)) for p in places]
    return F.size(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))) >= n


def variable_names(code: str) -> list[str] | None:
    """All names that Python code reads or writes; None if it cannot be parsed."""
    try:
        return sorted({x.id for x in ast.walk(ast.parse(code)) if isinstance(x, ast.Name)})
    except (SyntaxError, ValueError):
        return None


def camel_case(name: str) -> bool:
    """Letters and digits, a small letter first, and never two capitals in a row; an empty name counts as one."""
    return not name or name[0].islower() and name.isalnum() and not any(a.isupper() and b.isupper() for a, b in pairwise(name))


def camel_case_variables(v: Column) -> Column:
    """The response is Python code whose variables are all in camel case."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        names = [variable_names(t) if t is not None else None for t in texts]
        return pd.Series([x is not None and all(map(camel_case, x)) for x in names], dtype=bool)

    return run(v)


def reversed_words(v: Column, dictionary: Column) -> Column:
    """Of the words fewer than a fifth are, read backwards, not in the dictionary (an array of lower-case words); false without words."""
    bare = F.transform(T.words(v), lambda w: F.reverse(F.lower(T.strip_chars(w, T.PUNCT + " "))))
    return (F.size(bare) > 0) & (F.size(F.filter(bare, lambda w: ~F.array_contains(dictionary, w))) < 0.2 * F.size(bare))


# ------------------------------------------------------------------ evaluation


def applied(instruction: str, v: Column, kwargs: dict) -> Column:
    """One predicate.  Falsy arguments are left out; what a predicate needs and lacks raises, and so does an unknown id."""
    if instruction not in REGISTRY:
        raise KeyError(f"unknown instruction {instruction!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[instruction](v, **{k: x for k, x in kwargs.items() if isinstance(x, Column) or x})


def strict(instruction: str, v: Column, kwargs: dict) -> Column:
    """The response is not blank and the predicate holds."""
    return F.coalesce(~T.blank(v) & applied(instruction, v, kwargs), F.lit(False))


def variants(v: Column) -> Column:
    """The response, and without its first line, last line, or both; each also without asterisks."""
    return T.once(F.split(v, "\n", -1), lambda lines: _variants(v, lines))


def _variants(v: Column, lines: Column) -> Column:
    n = F.size(lines)
    joined = lambda start, length: T.strip(F.array_join(F.slice(lines, start, F.greatest(length, F.lit(0))), "\n"))
    four = [v, joined(F.lit(2), n - 1), joined(F.lit(1), n - 1), joined(F.lit(2), n - 2)]
    return T.once(F.array(*four), lambda xs: F.array_distinct(F.concat(xs, F.transform(xs, lambda x: F.translate(x, "*", "")))))


def loose(instruction: str, v: Column, kwargs: dict, made: Column | None = None) -> Column:
    """Some variant of the response that is not blank satisfies the predicate; ``made``: a column of its variants, for several predicates."""
    return F.exists(variants(v) if made is None else made, lambda x: F.coalesce(~T.blank(x) & applied(instruction, x, kwargs), F.lit(False)))
