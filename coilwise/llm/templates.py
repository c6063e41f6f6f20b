"""Benchmark decontamination by templates: questions are caught with other numbers, names or units too.

Texts become aligned lists of tokens: raw ones in lower case; canonical ones, where a number becomes
``0``, a unit behind a number UNIT (in any case), a capitalised word behind a lower-case one NAME; and
capitals, where every capitalised word is NAME. All white space counts as one blank. Windows of WINDOW
tokens are hash-joined between documents and benchmark items and compared in full, in all three forms:
literal ones of raw tokens; templates, canonical, where at least LITERALS tokens are no slots; and
templates of capitals, where a capitalised word after a sentence end is a slot if the item has it as NAME
elsewhere or no item has it in lower case, and must be the same word otherwise. The matched windows of
one document and item that lie on one diagonal are a candidate; it counts if it covers NEEDED tokens (or
all of a shorter item; of templates alone, all that the item has) and its slots are consistent: each
value in the item stands for one value in the document. Capitals are left out where the rest suffices.

Documents are read once; windows are made where the text lies and looked up there among the hashes of the
benchmark, which are broadcast up to HASHES of them. What is found goes on as the window alone, never with the
lists of its document, and meets the windows of the benchmark, which are broadcast up to BROADCAST bytes. Both
are checked; beyond them the joins shuffle.

Defined cases: null or empty texts and items match nothing; items of LITERALS to WINDOW - 1 tokens are
looked for by a window of their own length, everywhere in a document, and as templates only if LITERALS
tokens are no slots; items of fewer than LITERALS tokens, and short ones with more slots under other
values, match documents that have just their tokens; longer windows with more than WINDOW - LITERALS
slots are found with the values of the item only; rows that share a doc_id (null too) are one document
in ``leaks``, but ``decontaminated`` drops only those whose own text matches;
repeated items are reported once each item_id; empty tables give an empty result; further columns pass
through ``decontaminated`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import row_key, stored

WINDOW = 8
NEEDED = 13
LITERALS = 4
HASHES = 3_000_000  # some 56 bytes each
BROADCAST = 48 << 20
ITEMS = 500  # small rows, much work: not left to the size of partitions
NAME, UNIT = "ℕ", "ℚ"  # letters that texts don't use as words
TOKEN = r"\d+(?:[.,]\d+)*|[\p{L}\p{M}]+"
#: Units that may follow a number.
UNITS = (
    "km", "m", "cm", "mm", "mi", "miles", "mile", "feet", "ft", "inches", "kg", "g", "mg", "lb", "lbs", "oz", "tons", "l", "ml", "liters", "litres", "hours", "hour",
    "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "years", "year", "dollars", "euros", "cents", "percent", "degrees",
)


def _even(text: Column) -> Column:
    """The text with one blank for all white space between words."""
    return F.regexp_replace(text, r"[\s\p{Z}]{2,}|[\t-\r\x85\p{Z}&&[^ ]]", " ")


def _typed(text: Column) -> Column:
    t = F.regexp_replace(text, r"\d+(?:[.,]\d+)*", "0")
    return F.regexp_replace(t, r"(?<=0 ?)(?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{M}])", UNIT)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def canonical(typed: Column) -> Column:
    """The text with typed placeholders, token by token in the place of the raw ones."""
    return _tokens(F.regexp_replace(typed, r"(?<=[\p{Ll}" + UNIT + r"],? )\p{Lu}[\p{Ll}\p{M}]+(?![\p{L}\p{M}])", NAME))


def capitals(typed: Column) -> Column:
    """As ``canonical``, with every capitalised word a NAME, after a sentence end too."""
    return _tokens(F.regexp_replace(typed, r"(?<![\p{L}\p{M}])\p{Lu}[\p{Ll}\p{M}]+(?![\p{L}\p{M}])", NAME))


def literal(text: Column) -> Column:
    """The tokens as they stand, in lower case; as many as ``canonical`` gives."""
    return _tokens(text)


def is_slot(token: Column) -> Column:
    return token.isin("0", NAME, UNIT)


def _forms(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, raw, tokens, caps, and the hash of each of their tokens) of the texts that have tokens."""
    forms = ("raw", "tokens", "caps")
    df = df.select(*keys, "text", _typed(_even(F.col("text"))).alias("typed"))
    df = df.select(*keys, literal(F.col("text")).alias("raw"), canonical(F.col("typed")).alias("tokens"), capitals(F.col("typed")).alias("caps"))
    df = df.select("*", *[F.transform(f, lambda x: F.xxhash64(x)).alias(f"{f}_hashes") for f in forms])
    # exploded, since conditions on a list would otherwise be moved down to the text and make the list once more
    one = F.explode(F.array(F.struct(*forms, *[f"{f}_hashes" for f in forms]))).alias("form")
    return df.select(*keys, one).select(*keys, "form.*").where(F.size("raw") > 0)


def _of_few_tokens(df: DataFrame) -> DataFrame:
    """The rows whose text has under WINDOW tokens; most texts have more in their first 400 letters, which a cut adds none to."""
    return df.where((F.size(_tokens(F.substring("text", 1, 400))) < WINDOW) & (F.size(literal(F.col("text"))) < WINDOW))


def _windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per window of each length ``len``, from its place ``at``."""
    rows = rows.withColumn("len", F.explode(F.array(*map(F.lit, lengths))) if len(lengths) > 1 else F.lit(lengths[0]))
    return rows.where(F.size("raw") >= F.col("len")).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("raw") - F.col("len"))))


def _hash(form: str) -> Column:
    return F.xxhash64("len", *[F.when(F.col("len") > j, F.get(f"{form}_hashes", F.col("at") + j)) for j in range(WINDOW)])


def _text(form: str) -> Column:
    return F.array_join(F.slice(form, F.col("at") + 1, F.col("len")), " ")


def _proper(items: DataFrame) -> DataFrame:
    """(item_id, proper): words of each item that no item has in lower case."""
    words = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("cased")).withColumn("word", F.lower("cased"))
    common = words.where("cased = word").select("word").distinct()
    return words.join(common, "word", "left_anti").groupBy("item_id").agg(F.collect_set("word").alias("proper"))


def _small(df: DataFrame, *lists: str) -> DataFrame:
    """Broadcast what holds up to BROADCAST bytes, as rows with these lists come to."""
    held = F.length("window") + sum((64 * F.size(c) for c in lists), F.lit(200))
    return F.broadcast(df) if (df.agg(F.sum(held)).first()[0] or 0) <= BROADCAST else df


def _looked_up(probed: DataFrame, each: DataFrame, *keys: str) -> DataFrame:
    """(keys, len, at, hash, words, and the window in each form) of the windows that may be in the benchmark."""
    hashes = each.select("hash").distinct()
    if hashes.count() <= HASHES:
        probed = probed.join(F.broadcast(hashes), "hash", "left_semi")
    words = F.slice("raw", F.col("at") + 1, F.col("len")).alias("words")
    return probed.select(*keys, "len", "at", "hash", words, *[_text(f).alias(f"{f}_window") for f in ("raw", "tokens", "caps")])


def benchmark_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of the items, as literal ones and as templates, and the items of under WINDOW tokens in whole.

    Items of LITERALS to WINDOW - 1 tokens have one window, of their own length.
    """
    tasks = min(items.count() // ITEMS + 1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = _forms(items.repartition(tasks, "item_id") if tasks > 1 else items, "item_id").join(_proper(items), "item_id", "left")
    mid = F.transform(F.filter(F.arrays_zip("raw", "tokens"), lambda x: x["tokens"] == NAME), lambda x: x["raw"])
    t = t.withColumn("known", F.array_union(F.coalesce("proper", F.array().cast("array<string>")), mid)).drop("proper")
    w = _windows(t.where(F.size("raw") >= LITERALS).withColumn("own", F.least(F.size("raw"), F.lit(WINDOW))), list(range(LITERALS, WINDOW + 1))).where("len = own")
    places = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda j: is_slot(F.get("tokens", F.col("at") + j)))
    slots = F.transform(places, lambda j: F.struct(j.alias("j"), F.get("tokens", F.col("at") + j).alias("type"), F.get("raw", F.col("at") + j).alias("value")))
    named = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda j: is_slot(F.get("caps", F.col("at") + j)))
    named = F.transform(named, lambda j: F.struct(j.alias("j"), F.get("caps", F.col("at") + j).alias("type"), F.get("raw", F.col("at") + j).alias("value")))
    free = lambda s: is_slot(F.get("tokens", F.col("at") + s["j"])) | F.array_contains("known", s["value"])
    w = w.select("*", slots.alias("slots"), F.filter(named, free).alias("named"), F.filter(named, lambda s: ~free(s)).alias("kept")).withColumn("open", F.size("slots") <= F.col("len") - LITERALS)
    # the words that must be the same, each in its place
    fixed = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda j: F.get(F.transform(F.filter("kept", lambda s: s["j"] == j), lambda s: s["value"]), F.lit(0)))
    none = F.array().cast("array<string>")
    kinds = [
        F.struct(_hash("raw").alias("hash"), _text("raw").alias("window"), (F.size("slots") == 0).alias("template"), F.lit(False).alias("start"), "slots", none.alias("fixed")),
        F.when(F.col("open") & (F.size("slots") > 0), F.struct(_hash("tokens").alias("hash"), _text("tokens").alias("window"), F.lit(True).alias("template"), F.lit(False).alias("start"), "slots", none.alias("fixed"))),
        F.when((F.size("named") <= F.col("len") - LITERALS) & (_text("caps") != _text("tokens")), F.struct(_hash("caps").alias("hash"), _text("caps").alias("window"), F.lit(True).alias("template"), F.lit(True).alias("start"), F.col("named").alias("slots"), fixed.alias("fixed"))),
    ]
    kept = w.groupBy("item_id").agg(F.size(F.collect_set("at")).alias("all"), F.size(F.collect_set(F.when(F.col("open"), F.col("at")))).alias("templates"))
    each = w.select("item_id", "at", "len", F.inline(F.filter(F.array(*kinds), lambda k: k.isNotNull())))
    short = t.where(F.size("raw") < WINDOW).select("item_id", F.array_join("tokens", " ").alias("window"), "tokens", "raw")
    return each.join(kept, "item_id"), short


def _found(docs: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """(keys, item_id, windows, slots, changed) of the documents told apart by ``keys``."""
    each, short = benchmark_windows(items)
    each, _ = stored(each, "windows")
    lengths = sorted(r[0] for r in each.select("len").distinct().collect()) or [WINDOW]
    d = _forms(docs, *keys)
    b = _small(each.withColumnRenamed("at", "item_at").withColumnRenamed("len", "item_len"), "slots", "fixed")
    h = [F.col(f"h{i}") for i in range(3)]
    probes = F.explode(F.array(h[0], F.when(h[1] != h[0], h[1]), F.when(h[2] != h[1], h[2])))
    probed = _windows(d, lengths).withColumns({"h0": _hash("raw"), "h1": _hash("tokens"), "h2": _hash("caps")}).withColumn("hash", probes).where("hash IS NOT NULL")
    hit = _looked_up(probed, each, *keys).join(b, "hash").where(F.col("len") == F.col("item_len"))
    plain = (F.col("raw_window") == F.col("window")) | (F.col("tokens_window") == F.col("window"))
    for j in range(WINDOW):
        hit = hit.where(F.coalesce(F.get("fixed", F.lit(j)) == F.get("words", F.lit(j)), F.lit(True)))
    hit = hit.where(plain | (F.col("caps_window") == F.col("window")))
    hit = hit.withColumn("start", F.col("start") | ~plain)
    pairs = F.transform("slots", lambda s: F.struct(s["type"].alias("type"), s["value"].alias("item"), F.get("words", s["j"]).alias("doc")))
    found = hit.select(*keys, "item_id", "len", (F.col("at") - F.col("item_at")).alias("diagonal"), "at", "all", "templates", "template", "start", pairs.alias("pairs"))
    union = lambda when: F.array_distinct(F.flatten(F.collect_set(F.when(when, F.col("pairs")))))
    places = lambda when: F.size(F.collect_set(F.when(when, F.col("at"))))
    plain = ~F.col("start")
    runs = found.groupBy(*keys, "item_id", "len", "diagonal").agg(
        F.max("all").alias("all"), F.max("templates").alias("templates"),
        # a name after a sentence end counts if the others alone don't do: it may be a word as well
        *[F.struct(places(w).cast("bigint").alias("windows"), places(w & F.col("template")).alias("open"), union(w & F.col("template")).alias("pairs"), union(w).alias("shown")).alias(name)
          for name, w in (("plain", plain), ("starts", F.lit(True)))])
    most = F.lit(NEEDED - WINDOW + 1)

    def counts(r: str) -> Column:
        enough = (F.col(f"{r}.windows") >= F.least(most, "all")) | ((F.col(f"{r}.open") > 0) & (F.col(f"{r}.open") >= F.least(most, "templates")))
        return enough & (F.size(F.array_distinct(F.transform(f"{r}.pairs", lambda p: F.struct(p["type"], p["item"])))) == F.size(f"{r}.pairs"))

    runs = runs.select(*keys, "item_id", F.when(counts("plain"), F.col("plain")).when(counts("starts"), F.col("starts")).alias("run")).where("run IS NOT NULL").select(*keys, "item_id", "run.*")

    whole = _forms(_of_few_tokens(docs), *keys).select(*keys, F.array_join("tokens", " ").alias("window"), F.col("raw").alias("doc_raw"))
    zipped = F.zip_with(F.arrays_zip("tokens", "raw"), "doc_raw", lambda i, r: F.struct(i["tokens"].alias("type"), i["raw"].alias("item"), r.alias("doc")))
    # what has a window of its own is found above
    few = (F.size("raw") < LITERALS) | ((F.size(F.filter("tokens", is_slot)) > F.size("raw") - LITERALS) & (F.col("raw") != F.col("doc_raw")))
    same = whole.join(_small(short, "tokens", "raw"), "window").where(few).select(*keys, "item_id", F.lit(1).cast("bigint").alias("windows"), F.array_distinct(F.filter(zipped, lambda p: is_slot(p["type"]))).alias("pairs"))
    runs = runs.select(*keys, "item_id", "windows", "pairs", "shown").unionByName(same.withColumn("shown", F.col("pairs")))
    of_item = F.array_distinct(F.transform("pairs", lambda p: F.struct(p["type"], p["item"])))
    runs = runs.where(F.size(of_item) == F.size("pairs"))
    changed = F.size(F.filter("shown", lambda p: p["item"] != p["doc"])).cast("bigint")
    return runs.groupBy(*keys, "item_id").agg(
        F.sum("windows").alias("windows"), F.max(F.size("shown")).cast("bigint").alias("slots"), F.min(changed).alias("changed"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, slots, changed): which documents hold which items.

    ``changed`` counts slots whose value differs between item and document.
    """
    return _found(docs, items, "doc_id")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item, whatever other rows of their doc_id hold."""
    rows = docs.withColumn("__row", row_key())
    bad = _found(rows.select("__row", "text"), items, "__row").select(F.col("__row").alias("__leak")).distinct()
    return rows.join(bad, rows["__row"].eqNullSafe(bad["__leak"]), "left_anti").drop("__row")


@llm_query("op2_template_decontamination")
def op2_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, as they are or with other numbers, names and units."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
