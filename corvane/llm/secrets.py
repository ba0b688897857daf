"""Secret scans with built-in functions only: fixed patterns and sliding-window entropy."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import unused

#: The base kinds in their order, pattern and the group whose length counts, with its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidate strings: whole runs of these characters.  Position in ALPHABET is a character's counter.
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Entropy kinds: what all characters of the candidate are, what it must hold, and the least bits a character of a window.
CLASSES = (
    ("entropy_hex", r"^[0-9a-fA-F]+$", r"(?=.*[0-9])(?=.*[a-fA-F])", 3.0),
    ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", r"(?=.*[0-9])(?=.*[A-Za-z])", 3.7),
)
WINDOW = 20
#: Code points of the chunks in which a text is put together again.
CHUNK = 1_000
#: Candidates with such a part are no secrets: placeholders, sequences, digests named as such, dates, uuids.
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|redacted|x{6,}",
    r"(?i)0123456789|1234567890|abcdefghij|qwertyuiop",
    r"(?i)^sha(1|256|384|512)[-_=]",
    r"^\d{4}-\d{2}-\d{2}",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[-_=+/]+[A-Za-z]*[-_=+/]*$",
)
#: Logarithms are whole multiples of 2 ** -16, so adding and taking away counts stays exact.
_SCALE = 1 << 16
_KINDS = [x[0] for x in (*BASE, *CLASSES)]
_NONE = "cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)"


def _c_log_c(c: int) -> int:
    return round(c * math.log2(c) * _SCALE) if c else 0


def most_sum(bits: float) -> int:
    """A window's sum of count * log2(count) is at most this when its entropy is ``bits`` or more."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * _SCALE)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _scan(xs: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running ``add`` (from 0) of an array of whole numbers, in blocks of its size's root: each block's own, then on top of the blocks before."""
    kind = "array<bigint>"

    def small(ys: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast(kind).alias("out"))
        step = lambda s, y: F.struct(add(s["sum"], y).alias("sum"), F.concat(s["out"], F.array(add(s["sum"], y))).alias("out"))
        return F.aggregate(ys, first, step, lambda s: s["out"])

    def of_blocks(blocks: Column) -> Column:
        before = small(F.transform(blocks, lambda ys: F.element_at(ys, -1)))
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(before, 1, F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda ys, x: F.transform(ys, lambda y: add(x, y))))

    def of(bound: Column) -> Column:
        xs, size = bound["xs"], bound["size"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda k: small(F.slice(xs, k * size + 1, size)))
        return F.when(F.size(xs) > 0, _bound(blocks, of_blocks)).otherwise(F.array().cast(kind))

    return _bound(xs, lambda x: _bound(F.struct(x.alias("xs"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int").alias("size")), of))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, found, part>> of the leftmost non-overlapping matches, in code points.

    The texts between matches come from ``split`` with the same pattern; a running sum of lengths gives the places.
    """
    kind = "array<struct<start:bigint,end:bigint,found:string,part:string>>"

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _scan(F.zip_with(gaps, found, lambda g, x: (F.length(g) + F.length(x["found"])).cast("bigint")), lambda a, b: a + b)
        return F.zip_with(ends, found, lambda end, x: F.struct((end - F.length(x["found"])).alias("start"), end.alias("end"), x["found"].alias("found"), x["part"].alias("part")))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.zip_with(whole, parts, lambda x, y: F.struct(x.alias("found"), y.alias("part")))
    return F.when(text.rlike(pattern), _bound(found, placed)).otherwise(F.array().cast(kind))


def _least_sum(found: Column) -> Column:
    """The least sum of count * log2(count) of a window, by counts that each step changes in two places.

    Characters are told apart and looked up once each; the one that leaves stands WINDOW places before.
    The counts are the letters of a string, ``A`` for none.
    """
    table = F.array(*[F.lit(_c_log_c(c)) for c in range(WINDOW + 2)])
    big = 1 << 30

    def step(s: Column, x: Column) -> Column:
        new, old, full = x["new"], x["old"], x["full"]
        count = lambda k: F.ascii(F.substring(s["counts"], k, F.lit(1))) - 65
        gain = F.element_at(table, count(new) + 2) - F.element_at(table, count(new) + 1)
        loss = F.when(old > 0, F.element_at(table, count(F.greatest(old, F.lit(1))) + 1) - F.element_at(table, F.greatest(count(F.greatest(old, F.lit(1))), F.lit(1)))).otherwise(F.lit(0))
        total = F.when(new == old, s["total"]).otherwise(s["total"] + gain - loss)
        more = F.overlay(s["counts"], F.char(count(new) + 66), new, F.lit(1))
        counts = F.when(new == old, s["counts"]).when(old == 0, more).otherwise(F.overlay(more, F.char(count(old) + 64), old, F.lit(1)))
        least = F.when(full, F.least(s["least"], total)).otherwise(s["least"])
        return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"))

    def of(places: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(0), WINDOW), places)
        moves = F.zip_with(places, F.slice(gone, F.lit(1), F.size(places)), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
        moves = F.transform(moves, lambda x, i: F.struct(x["new"].alias("new"), x["old"].alias("old"), (i >= WINDOW - 1).alias("full")))
        zero = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0).alias("total"), F.lit(big).alias("least"))
        return F.aggregate(moves, zero, step, lambda s: s["least"])

    return _bound(F.transform(F.split(found, "(?<=.)(?=.)"), lambda c: F.instr(F.lit(ALPHABET), c)), of)


def _span(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(_KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _longer(least: int) -> Callable[[Column], Column]:
    return lambda x: F.length(x["part"]) >= least


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start and then kind."""
    each = []
    for kind, pattern, group, least in BASE:
        kept = F.filter(_matches(text, pattern, group), _longer(least))
        each.append(F.transform(kept, _span(kind)))
    return F.array_sort(F.concat(*each))


def _outside(found: Column, base: Column) -> Column:
    """The candidates that no base span contains: none that starts before them reaches their end."""
    kinds = "array<struct<start:bigint,last:boolean,end:bigint,found:string>>"
    spans = F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(False).alias("last"), x["end"].alias("end"), F.lit(None).cast("string").alias("found")))
    others = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(True).alias("last"), x["end"].alias("end"), x["found"].alias("found")))

    def of(events: Column) -> Column:
        reach = _scan(F.transform(events, lambda x: F.when(x["last"], F.lit(0).cast("bigint")).otherwise(x["end"])), F.greatest)
        marked = F.zip_with(events, reach, lambda x, y: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), (x["last"] & (y < x["end"])).alias("free")))
        return F.filter(marked, lambda x: x["free"])

    return _bound(F.array_sort(F.concat(spans.cast(kinds), others.cast(kinds))), of)


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidates with a window at or over its class's entropy, unless allow-listed or inside a base span."""
    allowed = lambda x: reduce(lambda a, b: a | b, [x["found"].rlike(p) for p in ALLOWED])
    of_class = lambda x, value: F.coalesce(*[F.when(x["found"].rlike(c[1]) & x["found"].rlike(c[2]), F.lit(value(c))) for c in CLASSES])
    rank = lambda x: of_class(x, lambda c: _KINDS.index(c[0]))
    found = _outside(F.filter(_matches(text, CANDIDATE), lambda x: rank(x).isNotNull() & ~allowed(x)), base)
    high = F.filter(found, lambda x: _least_sum(x["found"]) <= of_class(x, lambda c: most_sum(c[3])))
    return F.transform(high, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), of_class(x, lambda c: c[0]).alias("kind")))


def with_spans(docs: DataFrame, text_col: str, base_col: str, all_col: str) -> DataFrame:
    """Add the base spans and all spans as arrays of (start, rank, end, kind), under names that ``docs`` does not use; null texts count as empty."""
    text = F.coalesce(docs[text_col], F.lit(""))
    out = docs.withColumn(base_col, base_spans(text))
    more = F.when(text.rlike(CANDIDATE), entropy_spans(text, F.col(base_col))).otherwise(F.expr(_NONE))
    return out.withColumn(all_col, F.array_sort(F.concat(F.col(base_col), more)))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    Reads two columns, shuffles nothing.  Null and empty texts have no spans; ids may be
    null or repeated; texts of any length are scanned whole.
    """
    found = with_spans(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "text", "base", "spans")
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias(id_col), *[n(x[0]) for x in BASE], F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text in chunks of CHUNK."""
    first, last = (F.floor(x / CHUNK).cast("int") for x in (start, end))
    a, b = ((x - F.floor(x / CHUNK) * CHUNK).cast("int") for x in (start, end))
    of = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, F.substring(of(first), a + 1, b - a)).otherwise(F.concat(F.substring(of(first), a + 1, F.lit(CHUNK)), middle, F.substring(of(last), F.lit(1), b)))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span, overlapping ones together, by ``mark``; all rows and other columns stay, whatever their names, and null texts stay null."""
    base, spans = unused(docs, "base_spans"), unused(docs, "all_spans")
    text = F.col(text_col)

    def clean(bound: Column) -> Column:
        """Chunks of the text, and for each span the furthest end of the spans up to it."""
        chunks, reach = bound["chunks"], bound["reach"]
        before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(reach, F.lit(1), F.size(reach) - 1))
        gaps = F.filter(F.zip_with(before, F.col(spans), lambda at, x: F.struct(at.alias("at"), x["start"].alias("start"))), lambda x: x["start"] >= x["at"])
        kept = F.transform(gaps, lambda x: F.concat(_between(chunks, x["at"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), _between(chunks, F.element_at(reach, -1), F.length(text).cast("bigint")))

    bound = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), _scan(F.transform(spans, lambda x: x["end"]), F.greatest).alias("reach"))
    out = with_spans(docs, text_col, base, spans)
    return out.withColumn(text_col, F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(_bound(bound, clean))).drop(base, spans)


def _sql() -> str:
    """The same in DuckDB: every window of every candidate, its counts from scratch."""
    parts = []
    for kind, pattern, group, least in (*BASE, ("cand", CANDIDATE[CANDIDATE.index(")") + 1 :], 0, 20)):
        p = pattern.replace("'", "''")
        parts.append(f"""{kind}_m AS (SELECT id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_split_to_array(t, '{p}') AS gs, regexp_extract_all(t, '{p}', {group}) AS ps FROM d),
{kind}_e AS (SELECT id, ms, gs, ps, unnest(range(len(ms))) AS i FROM {kind}_m),
{kind}_s AS (SELECT id, '{kind}' AS kind, ms[i + 1] AS found, CAST(list_sum(list_transform(gs[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) AS BIGINT) AS a FROM {kind}_e WHERE length(ps[i + 1]) >= {least})""")
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_KINDS))
    kinds = " ".join(f"WHEN regexp_matches(found, '{of}') AND regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]') THEN '{name}'" for name, of, _, _ in CLASSES)
    sums = ", ".join(str(_c_log_c(c)) for c in range(WINDOW + 1))
    most = " ".join(f"WHEN '{name}' THEN {most_sum(bits)}" for name, _, _, bits in CLASSES)
    denied = " OR ".join(f"regexp_matches(found, '{p}')" for p in ALLOWED)
    base = " UNION ALL ".join(f"SELECT id, kind, a, a + length(found) AS b FROM {x[0]}_s" for x in BASE)
    return f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
{', '.join(parts)},
base AS ({base}),
cand AS (SELECT id, found, a, a + length(found) AS b, CASE {kinds} END AS kind FROM cand_s),
kept AS (SELECT * FROM cand c WHERE kind IS NOT NULL AND NOT ({denied}) AND NOT EXISTS (SELECT 1 FROM base x WHERE x.id = c.id AND x.a <= c.a AND c.b <= x.b)),
windows AS (SELECT id, found, a, b, kind, unnest(range(length(found) - {WINDOW - 1})) AS w FROM kept),
chars AS (SELECT id, found, a, b, kind, w, unnest(range({WINDOW})) AS o FROM windows),
counts AS (SELECT id, a, b, kind, w, substr(found, w + o + 1, 1) AS ch, count(*) AS c FROM chars GROUP BY ALL),
sums AS (SELECT id, a, b, kind, w, sum([{sums}][c + 1]) AS s FROM counts GROUP BY id, a, b, kind, w),
more AS (SELECT id, kind, a, b FROM sums GROUP BY id, kind, a, b HAVING min(s) <= CASE kind {most} END),
every AS (SELECT id, kind, a, b, CASE kind {ranks} END AS r FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
said AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r) FILTER (r < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r) AS spans, count(*) AS n FROM every GROUP BY id)
SELECT d.id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans
FROM d LEFT JOIN said ON said.id = d.id"""


SECRETS_SQL = _sql()
