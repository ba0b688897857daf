"""URL filters: longest-match rules, and a Bloom filter cascade over the corpus's hosts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, mix64

#: Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host labels whose hosts are listed.
LISTED_LABELS = ("casino-win", "cheap-pills", "free-bets", "spam-farm")
BITS_PER_KEY, HASHES = 10, 7
#: Keys of one shard's filters, all levels together; shards whose filters are broadcast at once (each under 2 MB at these sizes).
SHARD_KEYS, SHARDS_AT_ONCE = 1_000_000, 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = [], []
    for says, of, under in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(under)
        rule.append(F.when(fits, F.lit(of + under)))
        verdict.append(F.when(fits, F.lit(says)))
    return F.coalesce(*rule), F.coalesce(*verdict)


@dataclass
class Cascade:
    """Filters by (shard, level).  Odd levels hold listed keys, even levels what the level before took for listed."""

    shards: int
    levels: list[dict[int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        step = h2.astype(np.uint64) | np.uint64(1)
        with np.errstate(over="ignore"):
            first = mix64(h1.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            return (mix64(first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(size)).astype(np.int64)

    def holds(self, level: int, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        for s, bits in self.levels[level].items():
            own = np.flatnonzero(shard == s)
            if len(own):
                at = self.places(h1[own], h2[own], level, 8 * len(bits))
                out[own] = (bits[at >> 3] >> (at & 7) & 1).all(axis=1)
        return out

    def listed(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe that the cascade was built over."""
        out, going = np.zeros(len(h1), bool), np.ones(len(h1), bool)
        for level in range(len(self.levels)):
            inside = self.holds(level, shard, h1, h2)
            out[going & ~inside] = level % 2 == 1
            going &= inside
        out[going] = len(self.levels) % 2 == 1
        return out


def _hashed(df: DataFrame, key: Column, shards: int) -> DataFrame:
    out = df.withColumns({"h1": F.xxhash64(key), "h2": F.xxhash64(F.lit(1), key)})
    return out.withColumn("shard", F.pmod(F.xxhash64(F.lit(2), key), F.lit(shards)).cast("int"))


def _encode(keys: DataFrame, level: int) -> dict[int, np.ndarray]:
    """One filter a shard for ``keys`` (shard, h1, h2), each made in one task from the shard's keys, which are of bounded number."""

    def bits(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(max(8, -(-len(pdf) * BITS_PER_KEY // 8)), np.uint8)
        for first in range(0, len(pdf), 1 << 16):
            some = pdf.iloc[first : first + (1 << 16)]
            at = Cascade.places(some["h1"].to_numpy(), some["h2"].to_numpy(), level, 8 * len(out)).ravel()
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "bits": [out.tobytes()]})

    made = keys.select("shard", "h1", "h2").groupBy("shard").applyInPandas(bits, "shard int, bits binary")
    return {r.shard: np.frombuffer(r.bits, np.uint8) for r in made.collect()}


def _asked(held: Broadcast, level: int | None) -> Callable[..., Column]:
    """Whether one level holds a key, or (None) whether the whole cascade lists it."""

    def run(shard: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
        args = shard.to_numpy(), h1.to_numpy(), h2.to_numpy()
        return pd.Series(held.value.listed(*args) if level is None else held.value.holds(level, *args))

    return F.pandas_udf(run, "boolean")


def shards_for(listed: int, others: int) -> int:
    """Shards that keep the keys of all filters of one at about SHARD_KEYS: each level passes its share of mistakes on from the level two before.

    Of m keys that are not in a filter of b bits a key and h hashes m * (1 - exp(-h / b)) ** h are taken for its own.
    """
    mistakes = (1 - math.exp(-HASHES / BITS_PER_KEY)) ** HASHES
    held = (listed + (mistakes * others if listed else 0)) / (1 - mistakes)
    return max(1, math.ceil(held / SHARD_KEYS))


def build_cascade(universe: DataFrame, shards: int) -> Cascade:
    """A cascade over ``universe`` (shard, h1, h2, listed), which holds every key that will be asked for, once.

    Levels alternate until none takes a wrong key.  Filters have BITS_PER_KEY bits a key; with as many shards as
    ``shards_for`` says those of SHARDS_AT_ONCE stay at about that many times SHARD_KEYS keys' worth, 40 MB, however many keys are not listed.
    """
    cascade, turn = Cascade(shards), True
    inside, outside = universe.filter("listed"), universe.filter("not listed")
    while True:
        filters = _encode(inside, len(cascade.levels))
        if not filters:
            return cascade
        cascade.levels.append(filters)
        level, held = len(cascade.levels) - 1, universe.sparkSession.sparkContext.broadcast(cascade)
        mistaken = cut(outside.filter(_asked(held, level)("shard", "h1", "h2")), f"cascade-{level}")
        inside, outside, turn = mistaken, inside, not turn


def judge_urls(pages: DataFrame, rules: tuple = RULES, labels: tuple = LISTED_LABELS, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, listed.

    The longest fitting rule decides; without one, hosts in the list are blocked: those with one of the
    labels, and those of ``listed``, a table of lower-case hosts (host), of any size, which may hold nulls, repeats and hosts that no page has.  The
    list's membership comes from a Bloom filter cascade, exact for every host of the corpus: no
    join with the pages.  Hosts are counted once each, so a common host costs nothing more.
    Keys are dealt over shards, as many as the listed hosts and the mistakes expected of the others need; when there are more shards than may be
    broadcast at once, the pages are judged in several passes, each for its shards.
    Null urls and urls without ``://`` have empty host and path, no rule, and are allowed.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    labelled = F.exists(F.split("host", r"\."), lambda x: x.isin(*labels)) if labels else F.lit(False)
    hosts = rows.select(host.alias("host")).distinct().withColumn("listed", labelled)
    if listed is not None:
        keys = listed.select(F.col("host").alias("key")).filter("key is not null").distinct()
        hosts = hosts.join(keys, F.col("host") == F.col("key"), "left").select("host", (F.col("listed") | F.col("key").isNotNull()).alias("listed"))
    universe = cut(_hashed(hosts, F.col("host"), 1).drop("shard"), "hosts")
    n_listed, n_others = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    shards = shards_for(n_listed, n_others)
    universe = cut(_hashed(universe.drop("h1", "h2"), F.col("host"), shards), "hosts-dealt") if shards > 1 else universe.withColumn("shard", F.lit(0))
    rows = _hashed(rows.select("id", host.alias("host"), path.alias("path")), F.col("host"), shards)
    out = None
    for first in range(0, shards, SHARDS_AT_ONCE):
        own = F.col("shard").between(first, first + SHARDS_AT_ONCE - 1)
        held = spark.sparkContext.broadcast(build_cascade(universe.filter(own), shards))
        one = rows.filter(own).withColumn("listed", _asked(held, None)("shard", "h1", "h2"))
        out = one if out is None else out.unionByName(one)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


def _sql() -> str:
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in rules)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in rules)
    listed = f"list_has_any(string_split(host, '.'), [{', '.join(repr(x) for x in LISTED_LABELS)}])"
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict, {listed} AS listed FROM h"""


URL_SQL = _sql()
