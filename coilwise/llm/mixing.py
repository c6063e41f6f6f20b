"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, ``target / source_size``. Documents
are ranked within their source, expected copies are prefix-summed along the rank, one random offset is
added per source, and a document is emitted once for every integer boundary that its share of the sum
crosses. The rank goes up the sizes over every second document and down again over the others, so the mix
is an implicitly stratified sample whose errors on the two legs cancel around the longest documents in the
middle.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null
doc_id ranks first among equal sizes; rows that repeat are documents of their own; an empty table gives
an empty mix; a source of size 0 gets the target 0 and no copies. Further columns pass through
``mix_documents`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .registry import llm_query

WORD = r"[^\x20\x09-\x0D]+"
#: A group of equal source and size is ranked in so many parts, so no task ranks a whole group.
PARTS = 1024


def words_in(text: str | Column) -> Column:
    """Number of words of a text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets per source from (source, source_size, docs).

    Sources in code-point order (null last) take the weights in turn. All sizes together are shared by
    weight; a target stops at ``most`` times its source's size and the excess is reshared by weight.
    With the sources sorted by size per weight, the first k are stopped and the others share the rest.
    The table has one row per source, so the windows over it are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.select("source", "source_size", "docs", turn.cast("bigint").alias("w"))
    up = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.select(
        "*", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).alias("stopped"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("gone"),
        F.sum("source_size").over(whole).alias("total"), F.sum("w").over(whole).alias("all_w"),
    )
    level = (F.col("total") - F.col("stopped")).cast("double") / (F.col("all_w") - F.col("gone")).cast("double")
    free = level * F.col("w") <= (F.col("source_size") * most).cast("double")
    w = w.select("source", "source_size", "docs", "w", F.min(F.when(free, F.struct((F.col("source_size") / F.col("w")).alias("at"), level.alias("level")))).over(whole)["level"].alias("level"))
    return w.select("source", "source_size", "docs", F.least(F.col("level") * F.col("w"), (F.col("source_size") * most).cast("double")).alias("target"))


def offset_of(source: str | Column, seed: int) -> Column:
    """The random offset of a source in [0, 1): the first 32 bits of an md5."""
    c = F.col(source) if isinstance(source, str) else source
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), c), F.lit("")))
    return hex_number(key, 8).cast("double") / F.lit(4294967296.0)


def hex_number(text: Column, digits: int) -> Column:
    """The first hex digits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def ranked_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, source, size, rank, source_size, target) of every document of (doc_id, source, size).

    Place in a source by size = documents of larger sizes + documents in earlier parts of the same size +
    place inside the part; parts are hash classes of doc_id. Odd places are ranked in reverse, then
    even ones, so the largest documents meet in the middle.
    """
    part = F.pmod(hex_number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8), F.lit(PARTS)).alias("part")
    rows = checkpointed(docs.select("doc_id", "source", F.col("size").cast("bigint").alias("size"), part))
    cells = rows.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    larger = by_size.select("source", "size", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("larger"))
    along = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = cells.select("source", "size", "part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("earlier"))
    sources = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    targets = source_targets(sources, weights, most)

    inside = Window.partitionBy("source", "size", "part").orderBy("doc_id")
    ranked = rows.select("doc_id", "source", "size", "part", F.row_number().over(inside).alias("at"))
    same = lambda x, *cols: [F.col(f"r.{c}").eqNullSafe(F.col(f"{x}.{c}")) for c in cols]
    placed = (
        ranked.alias("r").join(earlier.alias("e"), same("e", "source", "size", "part")).select("r.*", "earlier").alias("r")
        .join(larger.alias("l"), same("l", "source", "size")).select("r.*", "earlier", "larger").alias("r")
        .join(targets.alias("t"), same("t", "source")).select("r.*", "earlier", "larger", "source_size", "docs", "target")
    )
    place = F.col("larger") + F.col("earlier") + F.col("at")
    half = F.shiftright(F.col("docs") + 1, 1)
    rank = F.when(place % 2 == 1, half - F.shiftright(place, 1)).otherwise(half + F.shiftright(place, 1))
    return placed.select("doc_id", "source", "size", rank.alias("rank"), "source_size", "target")


def copies(rank: Column, seed: int) -> Column:
    """Integer boundaries that the document of this rank crosses."""
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    u, at = offset_of("source", seed), rank.cast("double")
    return (F.floor(u + at * each) - F.floor(u + (at - 1) * each)).cast("bigint")


def mix_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the sample takes it, in its own columns.

    Rows that share doc_id, source and size take the ranks of that group in the order of a hash.
    """
    keyed = docs.select("doc_id", "source", words_in("text").alias("size"))
    keys = ("doc_id", "source", "size")
    ranked = ranked_documents(keyed, weights, most)
    ranks = ranked.groupBy(*keys).agg(
        F.min("rank").alias("rank"), F.count(F.lit(1)).alias("equals"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
    )
    row = F.struct(*[F.col(c if c.isidentifier() else f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    d, r = docs.select(row, "doc_id", "source", words_in("text").alias("size")).alias("d"), ranks.alias("r")
    joined = d.join(r, [F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]).select("d.*", "equals", "rank", "source_size", "target")
    one = joined.where("equals = 1").select("row", copies(F.col("rank"), seed).alias("n"))
    among, group = Window.partitionBy(*keys).orderBy(F.xxhash64("row")), Window.partitionBy(*keys).orderBy("rank")
    repeated = ranked.select("*", F.row_number().over(group).alias("place")).alias("k")
    equal = d.join(r.where("equals > 1"), [F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]).select("d.*")
    equal = equal.select("*", F.row_number().over(among).alias("place")).alias("e")
    more = equal.join(repeated, [*[F.col(f"e.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys], F.col("e.place") == F.col("k.place")])
    more = more.select("e.row", "k.source", "rank", "source_size", "target").select("row", copies(F.col("rank"), seed).alias("n"))
    every = one.unionByName(more).where("n > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w FROM s),
p AS (
  SELECT *, coalesce(sum(source_size * 3) OVER up, 0) AS stopped, coalesce(sum(w) OVER up, 0) AS gone,
         sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM w WINDOW up AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - stopped AS DOUBLE) / CAST(all_w - gone AS DOUBLE) AS level FROM p),
m AS (SELECT arg_min(level, source_size / w) AS level FROM l WHERE level * w <= CAST(source_size * 3 AS DOUBLE)),
t AS (SELECT source, source_size, docs, least(m.level * w, CAST(source_size * 3 AS DOUBLE)) AS target FROM w, m),
o AS (SELECT *, CAST('0x' || substr(md5('7:' || coalesce('=' || source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS u,
             CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS each FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 1024, doc_id NULLS FIRST) AS place FROM d),
q AS (SELECT r.doc_id, r.size, o.*, CAST((docs + 1) // 2 + CASE WHEN place % 2 = 1 THEN -(place // 2) ELSE place // 2 END AS DOUBLE) AS pos
      FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(u + pos * each) - floor(u + (pos - 1) * each) AS BIGINT) * size AS taken
FROM q
"""


@llm_query("op1_mix_sources", SQL)
def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranked = ranked_documents(docs.select("doc_id", "source", words_in("text").alias("size")))
    return ranked.select("doc_id", "size", "source_size", "target", (copies(F.col("rank"), 7) * F.col("size")).alias("taken"))
