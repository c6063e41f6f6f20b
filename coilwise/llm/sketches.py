"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph (a line that isn't empty) gives a 64-bit digest. A sketch has TABLES tables of CELLS cells;
each digest falls in one cell of each table, which holds how many digests it has, their xor and the xor
of their checks. Two sketches are subtracted cell by cell: what both have cancels. Peeling then takes
cells that hold one digest, as their check tells, removes it from its other cells, and goes on: it
recovers the digests that only one version has. Likeness is the share of paragraphs that both have.

Where a sketch is too small for the difference, the digests are dealt to as many sketches as their number
asks for and compared again; what even then doesn't peel is compared digest by digest. A difference is
thus always whole. Everything is a column expression; the only shuffle brings each document next to its
neighbour, by ranges of doc_id.

Defined cases: a null text is an empty one; two texts without paragraphs are alike (1); a repeated
paragraph counts once; a null doc_id comes last in descending order; rows that share a doc_id follow each
other by a hash of their text; the only document is its own neighbour; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import llm_query

TABLES, CELLS = 3, 16
ROUNDS = 12
PER_SKETCH = 8


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _cell(digest: Column, table: Column) -> Column:
    return table * CELLS + F.pmod(F.xxhash64(digest, table), F.lit(CELLS)).cast("int")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(TABLES))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _xor(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def sketch(items: Column) -> Column:
    """Cells (n, key, check) of an array of digests."""
    placed = F.transform(items, lambda d: F.struct(d.alias("d"), F.array(*[_cell(d, F.lit(t)) for t in range(TABLES)]).alias("at")))

    def cell(own: Column, c: Column) -> Column:
        inside = F.transform(F.filter(own, lambda p: F.get(p["at"], F.floor(c / CELLS).cast("int")) == c), lambda p: p["d"])
        return _let(inside, lambda x: F.struct(F.size(x).alias("n"), _xor(x).alias("key"), _xor(F.transform(x, _check)).alias("check")))

    return _let(placed, lambda own: F.transform(F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)), lambda c: cell(own, c)))


def as_text(items: Column, cells: Column) -> Column:
    """A fingerprint: number of digests, then the cells; an empty cell is empty."""
    part = lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(F.lower(F.concat_ws(":", F.hex(c["n"]), F.hex(c["key"]), F.hex(c["check"]))))
    return F.concat(F.size(items).cast("string"), F.lit("|"), F.array_join(F.transform(cells, part), ","))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(cells: Column) -> Column:
    """(cells, only_a, only_b) after peeling; all cells are empty if it came to the end."""
    none = F.array().cast("array<bigint>")

    def step(s: Column, _: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"])))
        got = lambda p, sign: F.array_distinct(F.transform(F.filter(p, lambda c: c["n"] == sign), lambda c: c["key"]))

        def removed(found: Column) -> Column:
            def less(c: Column, i: Column) -> Column:
                here = lambda x: F.filter(x, lambda d: _cell(d, F.floor(i / CELLS).cast("int")) == i)
                return _let(F.struct(here(found["a"]).alias("a"), here(found["b"]).alias("b")), lambda h: F.struct(
                    (c["n"] - F.size(h["a"]) + F.size(h["b"])).alias("n"),
                    c["key"].bitwiseXOR(_xor(h["a"])).bitwiseXOR(_xor(h["b"])).alias("key"),
                    c["check"].bitwiseXOR(_xor(F.transform(h["a"], _check))).bitwiseXOR(_xor(F.transform(h["b"], _check))).alias("check")))

            return F.struct(F.transform(s["cells"], less).alias("cells"), F.concat(s["only_a"], found["a"]).alias("only_a"), F.concat(s["only_b"], found["b"]).alias("only_b"))

        return _let(pure, lambda p: F.when(F.size(p) == 0, s).otherwise(_let(F.struct(got(p, 1).alias("a"), got(p, -1).alias("b")), removed)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(cells.alias("cells"), none.alias("only_a"), none.alias("only_b")), step)


def _empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))


def _counts(peeled: Column) -> Column:
    """(only_a, only_b) as numbers, null if peeling stopped before the end."""
    return F.when(_empty(peeled["cells"]), F.struct(F.size(peeled["only_a"]).alias("a"), F.size(peeled["only_b"]).alias("b")))


def _dealt(a: Column, b: Column) -> Column:
    """Sizes of both differences from as many sketches as the digests ask for, dealt in two levels."""
    side = F.greatest(F.lit(2), F.ceil(F.sqrt((F.size(a) + F.size(b)) / PER_SKETCH))).cast("int")
    own = lambda items, k, salt, n: F.filter(items, lambda d: F.pmod(F.xxhash64(d, F.lit(salt)), n) == k)
    split = lambda s, salt, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(own(s["a"], k, salt, n).alias("a"), own(s["b"], k, salt, n).alias("b")))

    def sizes(s: Column) -> Column:
        exact = F.struct(F.size(F.array_except(s["a"], s["b"])).alias("a"), F.size(F.array_except(s["b"], s["a"])).alias("b"))
        return F.coalesce(_counts(peel(subtract(sketch(s["a"]), sketch(s["b"])))), exact)

    def total(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
        return F.aggregate(parts, zero, lambda x, y: F.struct((x["a"] + y["a"]).alias("a"), (x["b"] + y["b"]).alias("b")))

    both = F.struct(a.alias("a"), b.alias("b"))
    return total(F.transform(split(both, 11, side), lambda s: total(F.transform(split(s, 12, side), sizes))))


def differences(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Add ``name``, the (a, b) numbers of digests that only one side has, from ``{x}_set`` and ``{x}_cells``."""
    out = df.withColumn("__peeled", peel(subtract(F.col(f"{a}_cells"), F.col(f"{b}_cells"))))
    out = out.withColumn("__counts", _counts(F.col("__peeled"))).drop("__peeled")
    return out.withColumn(name, F.when(F.col("__counts").isNotNull(), F.col("__counts")).otherwise(_dealt(F.col(f"{a}_set"), F.col(f"{b}_set")))).drop("__counts")


def likeness(difference: str, a: str) -> Column:
    """Shared paragraphs over all paragraphs of two versions; 1 if there are none."""
    both = F.size(f"{a}_set") - F.col(f"{difference}.a")
    union = F.size(f"{a}_set") + F.col(f"{difference}.b")
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / union)


def with_neighbour(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): each text and the next one's in descending order of doc_id, the first's after the last.

    Documents are dealt to ranges of doc_id; the first row of a range is also sent to the range before it.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = d.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20_000)).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    d = d.select("*", F.when(F.col("doc_id").isNull(), -1).otherwise(part).alias("part"), F.xxhash64("text").alias("mark"))
    # one row per range; nulls sort before all ids, so the largest key is a range's first row
    heads = d.groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")).alias("head"))
    around = Window.orderBy(F.col("part"))
    heads = heads.select(F.col("part").alias("head_part"), "head", F.coalesce(F.lead("part").over(around), F.first("part").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    joined = d.join(F.broadcast(heads), (F.col("part") == F.col("head_part")) & (F.coalesce("doc_id", F.lit(0)) == F.col("head.id")) & (F.col("mark") == F.col("head.mark")), "left")
    places = F.when(F.col("to").isNotNull(), F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("foreign")), F.struct(F.col("to").alias("p"), F.lit(True).alias("foreign")))).otherwise(
        F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("foreign"))))
    dealt = joined.select("doc_id", "text", "mark", F.inline(places))
    down = Window.partitionBy("p").orderBy("foreign", F.col("doc_id").desc_nulls_last(), F.col("mark").desc())
    return dealt.select("doc_id", "text", "foreign", F.lead("text").over(down).alias("next")).where(~F.col("foreign")).select("doc_id", "text", F.coalesce("next", "text").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n, cells fingerprint) of every document."""
    d = docs.select("doc_id", "text", digests(F.coalesce("text", F.lit(""))).alias("d_set"))
    return d.select("doc_id", "text", "d_set", sketch(F.col("d_set")).alias("d_cells")).withColumn("fingerprint", as_text(F.col("d_set"), F.col("d_cells")))


@llm_query("op8_paragraph_sketches")
def op8_paragraph_sketches(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how like the edited and the next text are."""
    d = with_neighbour(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next", F.lit(1), half)))
    d = d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[digests(F.col(c)).alias(f"{c}_set") for c in ("text", "edited", "next")])
    d = d.select("*", *[sketch(F.col(f"{c}_set")).alias(f"{c}_cells") for c in ("text", "edited", "next")])
    d = differences(differences(d, "to_edited", "text", "edited"), "to_next", "text", "next")
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("text_set"), F.col("text_cells")).alias("fingerprint"), as_text(F.col("edited_set"), F.col("edited_cells")).alias("edited_fingerprint"),
        likeness("to_edited", "text").alias("near_edited"), likeness("to_next", "text").alias("near_next"),
    )
