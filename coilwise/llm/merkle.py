"""Merkle manifest of a table as a content-addressed graph, with proofs by descent from the root.

1. ``leaf_digests``: one digest a row, of all its fields.
2. ``ranked``: leaves are dealt by ranges of (lang, doc_id, leaf), and a leaf's rank in its language is its
   place in its part plus the rows of the language in earlier parts, so no task holds a language.
3. ``grow``: level by level, every FAN consecutive nodes become a record (digest, children), until a tree has
   one node. The trees' tops are, in order of lang, the leaves of the root tree, which grows the same way.
4. ``descend``: requests for leaves go down from the root together as long as their ranks share digits. At
   each level the node's digest fetches its record, the next digits choose children, and the children not
   chosen join the path. Reversed, a path is the proof from leaf to root.

Records are kept per shelf of SHELF neighbouring nodes. A digest that recurs, as repeated rows without id
make it, is stored and looked up once a shelf, so no digest gathers more than SHELF rows. Only the rows of
one record (FAN) are ever collected. The level next to the leaves has an eighth of the rows; below it paths
are used where they are made and don't move again.

Defined cases: a null field is written as ``-`` and differs from an empty one; a null lang is a tree of its
own, first in order; rows without doc_id come first in their tree; rows of one doc_id follow by their leaf
digests, so the root doesn't depend on the order of rows; equal rows are leaves each; the only leaf of a
language is its subroot and the only subroot is the root, with a proof over no digests; an empty table
gives an empty result; columns other than the five are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import stored

FAN = 8
SHELF = 4096


def digest(text: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(text.cast("binary"), 256)


def field(c: Column) -> Column:
    """A value with its length in bytes in front, or ``-``."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def tampered() -> Column:
    """Rows whose doc_id has a checksum that 3 divides."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaf_digests(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, start): the leaf and the leaf after tampering."""
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    leaf = digest(F.concat(*head, field(F.col("text"))))
    return docs.select("lang", "doc_id", leaf.alias("leaf"), F.when(tampered(), digest(F.concat(*head, field(lower)))).alias("start")).withColumn("start", F.coalesce("start", "leaf"))


def ranked(rows: DataFrame, order: list[Column], group: list[str], label: str) -> DataFrame:
    """Add ``rank`` (from 0) in the given order and ``n``, the rows of the group; the order starts with the group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed, _ = stored(dealt, label)
    placed = placed.withColumn("part", F.shiftright("place", 33))
    # one row per part and group
    runs = placed.groupBy("part", *group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("many"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", *group, (F.coalesce(F.sum("many").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("many").over(whole).alias("n"))
    return placed.join(runs, ["part", *group]).withColumn("rank", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records of every level above ``nodes`` (tree, at, n, digest), and each tree's top (tree, depth, digest)."""
    records, tops = [], nodes.where("n = 1").select("tree", F.lit(0).alias("depth"), "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct((F.col("at") % FAN).alias("digit"), "digest")))
        up = nodes.where("n > 1").groupBy("tree", F.expr(f"at div {FAN}").alias("at"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n")).agg(run["digest"].alias("children"))
        record, _ = stored(up.select("tree", "at", "n", digest(F.array_join("children", "")).alias("digest"), "children"), "merkle-level")
        records.append(record)
        nodes = record.drop("children")
        tops = tops.union(nodes.where("n = 1").select("tree", F.lit(len(records)).alias("depth"), "digest"))
        most = (most + FAN - 1) // FAN
    return records, tops


def descend(records: list[DataFrame], tops: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, digest, path, ...) of every request (tree, rank, request), found from its tree's top.

    ``path`` has (digit, others) of each level, from the top down. It goes on from the path in ``tops``,
    whose further columns are handed on.
    """
    more = [c for c in tops.columns if c not in ("tree", "depth", "digest", "path")]
    held = tops.withColumn("at", F.lit(0).cast("bigint"))
    found = held.where("depth = 0").join(requests.select("tree", "request"), "tree").select("request", "digest", "path", *more)
    front = None
    for k in range(len(records), 0, -1):
        entering = held.where(F.col("depth") == k).select("tree", "at", "digest", "path", *more)
        front = entering if front is None else front.union(entering)
        shelf = F.expr(f"at div {SHELF}").alias("shelf")
        kept = records[k - 1].select("digest", "tree", shelf, "children").dropDuplicates(["digest", "tree", "shelf"])
        digit = F.expr(f"cast(rank div {FAN ** (k - 1)} % {FAN} as int)").alias("digit")
        asked = requests.select("tree", F.expr(f"rank div {FAN**k}").alias("at"), digit, *(["request"] if k == 1 else []))
        asked = asked.groupBy("tree", "at").agg((F.collect_list(F.struct("digit", "request")) if k == 1 else F.collect_set(F.struct("digit"))).alias("asked"))
        step = front.select("*", shelf).join(kept, ["digest", "tree", "shelf"]).join(asked, ["tree", "at"])
        step = step.select("tree", "at", "path", "children", *more, F.inline("asked"))
        others = F.filter("children", lambda c, i: i != F.col("digit"))
        step = step.select("*", F.get("children", "digit").alias("digest"), F.concat("path", F.array(F.struct("digit", others.alias("others")))).alias("down"))
        if k == 1:
            return found.union(step.select("request", "digest", F.col("down").alias("path"), *more))
        front = step.select("tree", (F.col("at") * FAN + F.col("digit")).alias("at"), "digest", F.col("down").alias("path"), *more)
    return found


def fold(start: Column, upward: Column) -> Column:
    """The root that follows from a leaf and the other children on its way up."""
    return F.aggregate(upward, start, lambda low, x: digest(F.concat(
        F.array_join(F.slice(x["others"], F.lit(1), x["digit"]), ""), low, F.array_join(F.slice(x["others"], x["digit"] + 1, F.lit(FAN)), ""))))


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root) of every row; ``proof`` lists (digit, others) from leaf to root."""
    rows, _ = stored(leaf_digests(docs), "merkle-leaves")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree")  # never null, so trees can be joined
    by_id = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("start")]
    leaves, _ = stored(ranked(rows.select("*", tree), by_id, ["tree"], "merkle-ranks"), "merkle-ranked")
    records, tops = grow(leaves.select("tree", F.col("rank").alias("at"), "n", F.col("leaf").alias("digest")))
    tops, _ = stored(tops.join(leaves.select("tree", "lang").distinct(), "tree"), "merkle-tops")

    subroots, _ = stored(ranked(tops, [F.col("lang").asc_nulls_first()], [], "merkle-subroots").select("*", F.lit("").alias("root_tree")), "merkle-langs")
    root_records, root_top = grow(subroots.select(F.col("root_tree").alias("tree"), F.col("rank").alias("at"), "n", "digest"))
    root = root_top.first()
    nowhere = F.array().cast("array<struct<digit:int,others:array<string>>>").alias("path")
    above = descend(root_records, root_top.select("*", nowhere), subroots.select(F.col("root_tree").alias("tree"), "rank", F.struct("tree", "depth").alias("request")))
    starts = above.select("request.tree", "request.depth", "digest", "path", F.col("digest").alias("subroot"))
    found = descend(records, starts, leaves.select("tree", "rank", F.struct("doc_id", "start").alias("request")))
    return found.select(
        "request.doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root.digest if root else None).cast("string").alias("root"),
        F.reverse("path").alias("proof"), fold(F.col("request.start"), F.reverse("path")).alias("folded_root"),
    )


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: CRC-32 bit by bit, with its reversed polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT)"""


def _grown(name: str, nodes: str) -> str:
    """All nodes (tree, lev, pos, n, d), and the runs of children (tree, lev, run, ds)."""
    return f"""{name} AS (SELECT tree, 0 AS lev, pos, n, d FROM {nodes} UNION ALL SELECT tree, lev + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(d, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, lev, pos // {FAN}, n),
{name}_runs AS MATERIALIZED (SELECT tree, lev, pos // {FAN} AS run, list(d ORDER BY pos) AS ds FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _walked(name: str, start: str, runs: str) -> str:
    """Each row's way up: the siblings so far and the digest that follows from its leaf."""
    low, high = f"array_to_string(ds[1:pos % {FAN}], '')", f"array_to_string(ds[pos % {FAN} + 2:], '')"
    return f"""{name} AS (SELECT rid, tree, pos, 0 AS lev, proof, now FROM {start} UNION ALL
 SELECT rid, w.tree, pos // {FAN}, w.lev + 1, proof || {low} || {high}, sha256({low} || now || {high}) FROM {name} w JOIN {runs} r ON r.tree = w.tree AND r.lev = w.lev AND r.run = w.pos // {FAN})"""


SQL = f"""WITH RECURSIVE lf AS (SELECT doc_id, lang, sha256({_HEAD} || {_field('text')}) AS leaf, sha256({_HEAD} || {_field(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")}) AS other, {_CRC} % 3 = 0 AS bad FROM documents),
rk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS d FROM lf),
{_grown('lv', 'rk')}, sb AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, d, lev FROM lv WHERE n = 1), {_grown('rt', 'sb')},
{_walked('wa', "(SELECT rid, tree, pos, '' AS proof, CASE WHEN coalesce(bad, false) THEN other ELSE leaf END AS now FROM rk)", 'lv_runs')},
{_walked('wb', '(SELECT rid, 0 AS tree, sb.pos, proof, now FROM wa JOIN sb ON sb.pos = wa.tree AND sb.lev = wa.lev)', 'rt_runs')}
SELECT doc_id, leaf, sb.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.d AS verified
FROM rk JOIN sb ON sb.pos = rk.tree JOIN wb USING (rid) JOIN (SELECT d, lev FROM rt WHERE n = 1) t ON t.lev = wb.lev"""


@llm_query("op11_merkle_manifest", SQL)
def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof digest of every document, and the root folded from a leaf that may be tampered with."""
    siblings = F.array_join(F.flatten(F.transform("proof", lambda x: x["others"])), "")
    rows = proofs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
