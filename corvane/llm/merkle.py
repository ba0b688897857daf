"""Merkle manifests of a table: a node store on shared storage, proofs by coordinate, and their verification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import cut
from corvane.operators.scans import numbered
from corvane.sources.shared import shared_path

#: Children of a node.
WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


@dataclass
class Tree:
    """One tree for each key, as tables of its levels: level k has key, at, digest, size (the key's nodes there) and from 1 on children (digests in order)."""

    spark: SparkSession
    path: str
    levels: int
    width: int

    def level(self, k: int) -> DataFrame:
        kind = "key string, at long, digest string, size long" + (", children array<string>" if k else "")
        return self.spark.read.schema(kind).parquet(f"{self.path}/level={k}")

    def roots(self) -> DataFrame:
        """key, digest of each tree's last node."""
        out = self.level(0)
        for k in range(1, self.levels + 1):
            out = out.select("key", "digest", "size").unionByName(self.level(k).select("key", "digest", "size"))
        return out.filter("size = 1").select("key", "digest")

    def tails(self, above: DataFrame, k: int = 1) -> DataFrame:
        """key, at, children and path of the nodes of level ``k``: the siblings from there up, and then those of ``above`` (key, path).

        Levels are merged from the top down: each joins its nodes' coordinates with the level before, which has a sixteenth of the rows.
        """
        tails = None
        for i in range(self.levels, k - 1, -1):
            nodes = self.level(i)
            own = nodes.filter("size = 1").join(above, "key").select("key", "at", "children", "path")
            if tails is not None:
                lower = nodes.filter("size > 1").withColumn("up", F.expr(f"at DIV {self.width}"))
                higher = tails.select("key", F.col("at").alias("up"), F.col("children").alias("siblings"), "path")
                lower = lower.join(higher, ["key", "up"])
                own = own.unionByName(lower.select("key", "at", "children", F.concat(F.array(siblings("siblings", F.col("at") % self.width)), "path").alias("path")))
            tails = own
        return tails


def siblings(children: str, place: Column) -> Column:
    """(left, right): the digests before and after a place, concatenated."""
    place = place.cast("int")
    parts = F.slice(children, F.lit(1), place), F.slice(children, place + 2, F.greatest(F.size(children) - place - 1, F.lit(0)))
    return F.struct(F.array_join(parts[0], "").alias("left"), F.array_join(parts[1], "").alias("right"))


def grow(nodes: DataFrame, path: str, width: int = WIDTH) -> Tree:
    """The trees over ``nodes`` (key, at, digest, size), each level written sorted, made from the one before it, until every key has one node."""
    spark = nodes.sparkSession
    nodes.select("key", "at", "digest", "size").sortWithinPartitions("key", "at").write.parquet(f"{path}/level=0")
    tree, most = Tree(spark, path, 0, width), nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        below = tree.level(tree.levels).filter("size > 1").groupBy("key", F.expr(f"at DIV {width}").alias("at"))
        children = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        level = below.agg(children.alias("children"), F.max("size").alias("below")).select("key", "at", F.sha2(F.array_join("children", ""), 256).alias("digest"), F.expr(f"(below + {width - 1}) DIV {width}").alias("size"), "children")
        tree.levels += 1
        level.sortWithinPartitions("key", "at").write.parquet(f"{path}/level={tree.levels}")
        most = -(-most // width)
    return tree


def fold(leaf: Column, path: Column) -> Column:
    """The digest that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda own, x: F.sha2(F.concat(x["left"], own, x["right"]), 256))


def lowered(text: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.translate(text.cast("string"), ascii_uppercase, ascii_lowercase)


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, tamper: Callable[[Column], Column] = lowered, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root, verified of each row: its place under one root, and whether its proof gives that root.

    Each group's leaves stand by id and then digest; runs of ``width`` nodes become the next level's nodes until one is left, the group's
    subroot; the subroots, by group (null first, then UTF-8), make a tree in the same way.  Leaves are sorted by ranges, so a group of
    any size lies in many sorted runs; every level is a folder of the node store in the shared folder, made by reading the one before;
    proofs come from merging the levels by coordinate, top down, so that a run's leaves share what is above them.  Where ``tampered`` (by
    default: 5 divides crc32 of the id in decimals) the leaf of ``tamper`` of the text is folded instead of the row's own.

    Null values of any field count as ``-``; null ids come first and are not tampered with; repeated ids stand by digest, repeated rows
    one after the other; a lone row's proof is the empty text's digest; an empty table gives no rows; other columns are not read;
    texts are read whole, and only digests are shuffled.
    """
    spark = docs.sparkSession
    tampered = (F.crc32(docs[id_col].cast("string").cast("binary")) % 5 == 0) if tampered is None else tampered
    changed = leaf_digest([tamper(docs[c]) if c == text_col else docs[c] for c in fields])
    group = F.when(docs[group_col].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), docs[group_col].cast("string")))
    leaves = cut(docs.select(docs[id_col].alias("id"), group.alias("key"), leaf_digest([docs[c] for c in fields]).alias("digest"), F.when(tampered, changed).alias("other")), "merkle-leaves")
    leaves = cut(numbered(leaves, ["id", "digest"], ["key"], size="size"), "merkle-runs")
    groups = grow(leaves, shared_path(spark, "merkle-groups"), width)

    tops = cut(numbered(groups.roots().withColumnsRenamed({"key": "group"}).withColumn("key", F.lit("")), ["group"], ["key"], size="size"), "merkle-tops")
    top = grow(tops, shared_path(spark, "merkle-top"), width)
    root = top.roots().select("key", F.col("digest").alias("root"))
    above = root.select("key", F.array().cast(_PATH).alias("path"))
    ends = tops.filter("size = 1").join(above, "key").select("group", "path")
    if top.levels:
        places = tops.withColumn("up", F.expr(f"at DIV {width}")).join(top.tails(above).withColumnRenamed("at", "up"), ["key", "up"])
        ends = places.select("group", F.concat(F.array(siblings("children", F.col("at") % width)), "path").alias("path"))
    ends = cut(ends.join(tops.select("group", "key", F.col("digest").alias("subroot")), "group").join(root, "key").select(F.col("group").alias("key"), "path", "subroot", "root"), "merkle-ends")

    facts = ends.select("key", "subroot", "root")
    alone = leaves.filter("size = 1").join(ends.select("key", "path"), "key").select("key", "id", "digest", "other", "path")
    if groups.levels:
        tails = groups.tails(ends.select("key", "path")).withColumnRenamed("at", "up")
        placed = leaves.filter("size > 1").withColumn("up", F.expr(f"at DIV {width}")).join(tails, ["key", "up"])
        alone = alone.unionByName(placed.select("key", "id", "digest", "other", F.concat(F.array(siblings("children", F.col("at") % width)), "path").alias("path")))
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    out = alone.join(facts, "key").select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), fold(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6, tops: int = 5) -> str:
    """The same in SQL, for up to 16^levels rows a group and 16^tops groups."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    low = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    crc = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, CAST(length(CAST(doc_id AS VARCHAR)) AS BIGINT) + 1), lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    steps = [
        f"l AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || source, '0') AS key, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 5 = 0 THEN {leaf(low)} END AS other FROM documents)",
        "n0 AS (SELECT r, key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d, count(*) OVER (PARTITION BY key) AS size FROM l)",
    ]

    def climb(n: str, top: int) -> None:
        for k in range(top):
            steps.append(f"{n}{k + 1} AS (SELECT key, pos // 16 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d, (any_value(size) + 15) // 16 AS size FROM {n}{k} WHERE size > 1 GROUP BY key, pos // 16)")

    def fold_up(n: str, out: str, rows: str, top: int) -> None:
        steps.append(f"{out}0 AS ({rows})")
        for k in range(top):
            node = f"SELECT x.r, coalesce(string_agg(CASE WHEN n.pos < x.pos // {16**k} THEN n.d END, '' ORDER BY n.pos), '') AS a, coalesce(string_agg(CASE WHEN n.pos > x.pos // {16**k} THEN n.d END, '' ORDER BY n.pos), '') AS b FROM {out}{k} x JOIN {n}{k} n ON n.key = x.key AND n.pos // 16 = x.pos // {16 ** (k + 1)} WHERE n.size > 1 GROUP BY x.r"
            steps.append(f"{out}{k + 1} AS (SELECT x.r, x.key, x.pos, CASE WHEN p.r IS NULL THEN x.f ELSE sha256(p.a || x.f || p.b) END AS f, x.proof || coalesce(p.a || p.b, '') AS proof FROM {out}{k} x LEFT JOIN ({node}) p ON p.r = x.r)")

    climb("n", levels)
    steps.append("u AS (" + " UNION ALL ".join(f"SELECT key, d FROM n{k} WHERE size = 1" for k in range(levels + 1)) + ")")
    steps.append("t0 AS (SELECT '' AS key, key AS source, row_number() OVER (ORDER BY key) - 1 AS pos, d, count(*) OVER () AS size FROM u)")
    climb("t", tops)
    steps.append("root AS (" + " UNION ALL ".join(f"SELECT d FROM t{k} WHERE size = 1" for k in range(tops + 1)) + ")")
    fold_up("n", "f", "SELECT l.r, l.key, n0.pos, coalesce(l.other, l.leaf) AS f, '' AS proof FROM l JOIN n0 USING (r)", levels)
    fold_up("t", "g", f"SELECT x.r, '' AS key, t0.pos, x.f, x.proof FROM f{levels} x JOIN t0 ON t0.source = x.key", tops)
    return f"WITH {', '.join(steps)} SELECT l.doc_id, l.leaf, u.d AS subroot, root.d AS root, sha256(x.proof) AS proof_sha256, x.f AS folded_root, x.f = root.d AS verified FROM l JOIN g{tops} x ON x.r = l.r JOIN u ON u.key = l.key CROSS JOIN root"


MERKLE_SQL = _sql()
