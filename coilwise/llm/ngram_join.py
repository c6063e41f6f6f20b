"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct shingles of ``words`` words (WORDS); documents link when
their sets' Jaccard similarity is ``share`` percent or more (SHARE). Work is done on distinct sets, so exact copies cost nothing.

* Two sets of n shingles that link share at least ``need = ceil(share n / 100)``. In one global order of
  shingles, their first ``n - need + l`` shingles share ``l`` or more. Each document chooses its own l: the
  more its shingles occur elsewhere (an estimate of its candidates from corpus counts), the longer its
  prefix and the more shared prefix shingles a pair must show before its sets are compared.
* The global order is by hash, with the frequent shingles last. Frequent ones are found by counting every
  shingle in the lowest third of the hashes over the whole corpus; all others keep their hash order. Which
  shingles go last changes only the cost. The bound on the count is such that at most FREQUENT of them
  exist (there are only so many occurrences), so they may be broadcast.
* Postings of one shingle form a list. Lists of up to LIST sets emit their pairs, which are counted per
  pair. Longer lists, as large groups of near copies make them, emit only pairs with a hub: first the set
  with the fewest prefix shingles outside such lists, which lies nearest the middle of its group, then in
  ROUNDS rounds a random one that each list draws for itself, so that a set meets as many random others as
  it has such lists. Sets that are connected by then need no comparison. Sets of different components that share
  the l shingles in such lists are still candidates, so no link is lost that connects two components; of
  those pairs, the ones whose parity sketches differ too much are left out where the lists meet. A sketch
  holds, in each of its BITS bits, whether an odd number of the set's shingles fall there, so two sketches
  differ in at most as many bits as the sets in shingles, and no pair that links is left out.

Pairs that pass are verified on their whole sets. Hashes have 64 bits; a set's identity is a 64-bit digest
with its size.

Defined cases: null or empty texts have empty sets and link with nothing; texts of fewer words than a
shingle have one; rows that share a doc_id are compared each and reported each; a null doc_id is never the smallest
of its component unless alone; an empty table gives an empty result; further columns pass through
``one_of_each`` untouched. By row, rows are told apart by doc_id and text, and all texts without words stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import drop, row_key, slices, stored
from .words import LOWER, mix, spans, text_bytes, window_hashes, word_hashes

WORDS = 4
SHARE = 85
FREQUENT = 1_000_000
OFTEN = 64
LIST = 16
ROUNDS = 2
BITS = 1024
SKETCH = [f"s{i}" for i in range(BITS // 64)]
LOW = np.uint64(2**64 // 3)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and each text's offset."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    n = len(offsets) - 1
    start, end, doc = spans(data, offsets)
    h = word_hashes(data, start, end)
    full = np.flatnonzero(doc[: max(len(doc) - words + 1, 0)] == doc[words - 1 :])
    keys, owner = [window_hashes(h, words)[full]], [doc[full]]
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if n else np.zeros(0, np.int64)
    for k in range(1, words):
        short = np.flatnonzero(count == k)
        if len(short):
            keys.append(window_hashes(h, k)[first[short]])
            owner.append(short)
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort([key, own])
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    return key, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int64)


def set_digests(key: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit identity of each set: a mixed sum, the same in any order."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(key ^ np.uint64(0xA0761D6478BD642F)))])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def parity_sketches(key: np.ndarray, offsets: np.ndarray, rows: int = 1000) -> np.ndarray:
    """BITS bits of each set, as rows of 64-bit words: the parity of the number of its shingles at each bit."""
    n, bit = len(offsets) - 1, (mix(key ^ np.uint64(0x8BB84B93962EACC9)) % np.uint64(BITS)).astype(np.int64)
    out = np.zeros((n, BITS // 64), np.int64)
    for a in range(0, n, rows):
        z = min(a + rows, n)
        own = np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))
        odd = np.bincount(own * BITS + bit[offsets[a] : offsets[z]], minlength=(z - a) * BITS) & 1
        out[a:z] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(z - a, -1)
    return out


def prefixes(key: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, times: np.ndarray, often: float, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in ``key`` of all prefix shingles, their text, l of each text)."""
    n = np.diff(offsets)
    own = np.repeat(np.arange(len(n)), n)
    at = np.minimum(np.searchsorted(frequent, key), max(len(frequent) - 1, 0))
    last = (frequent[at] == key) if len(frequent) else np.zeros(len(key), bool)
    cost = np.bincount(own[last], weights=times[at[last]] / often, minlength=len(n)) if len(frequent) else np.zeros(len(n))
    need = (share * n + 99) // 100
    match = np.minimum(need, 2 + np.ceil(np.log2(1 + cost)).astype(np.int64))
    order = np.argsort(own * 2 + last, kind="stable")
    rank = np.arange(len(key)) - offsets[own]  # texts stay in turn, so their places do
    taken = rank < (n - need + match)[own]
    return order[taken], own[taken], match


def _mapped(docs: DataFrame, words: int, fn, schema: str, *more: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield fn(b, *shingle_sets(b.column(b.schema.get_field_index("text")), words))

    return docs.select("text", *more).mapInArrow(run, schema)


def _nodes(b, key, offsets):
    return pa.RecordBatch.from_arrays([b.column(1), pa.array(set_digests(key, offsets)), pa.array(np.diff(offsets))], ["doc_id", "sid", "n"])


def _low_counts(b, key, offsets):
    t, c = np.unique(key[key < LOW], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c)], ["t", "c"])


def _sets(b, key, offsets):
    sid, sketch = set_digests(key, offsets), parity_sketches(key, offsets)
    keys = pa.array([key[a:z].tobytes() for a, z in zip(offsets, offsets[1:], strict=False)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(sid), keys, *map(pa.array, sketch.T.copy())], ["sid", "keys", *SKETCH])


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted hashes, counts, bound): shingles of the lowest third that occur in more than ``bound`` texts."""
    counts, path = stored(_mapped(docs, words, _low_counts, "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c")).where(f"c > {OFTEN}"), "counts")
    # at most FREQUENT shingles can hold more than total / FREQUENT occurrences each
    often = max(OFTEN, (counts.agg(F.sum("c")).first()[0] or 0) / FREQUENT)
    rows = counts.where(F.col("c") > often).toArrow()
    drop(docs.sparkSession, path)
    t, c = rows.column("t").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(t)
    return t[order], c[order].astype(float), float(often)


def postings(docs: DataFrame, words: int, share: int) -> DataFrame:
    """(t, sid, n, l): the prefix shingles of every distinct set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))

    def post(b, key, offsets):
        sid = set_digests(key, offsets)
        places, own, match = prefixes(key, offsets, *shared.value, share)
        new = np.zeros(len(sid), bool)
        new[np.unique(sid, return_index=True)[1]] = True  # a set once a slice; the aggregation drops the other repeats
        kept = new[own]
        own = own[kept]
        return pa.RecordBatch.from_arrays([pa.array(key[places[kept]].view(np.int64)), pa.array(sid[own]), pa.array(np.diff(offsets)[own]), pa.array(match[own])], ["t", "sid", "n", "l"])

    return _mapped(docs, words, post, "t bigint, sid bigint, n bigint, l bigint").dropDuplicates(["t", "sid", "n"])


def _alike(a: str, b: str, share: int):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * share)


def _near(a: str, b: str, share: int):
    """False only for pairs that can't link: of s shingles that differ, 100 (n_a + n_b - s) >= share (n_a + n_b + s)."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{s}_{a}").bitwiseXOR(F.col(f"{s}_{b}"))) for s in SKETCH])
    return differ * (100 + share) <= (F.col(f"n_{a}") + F.col(f"n_{b}")) * (100 - share)


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("keys").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("keys").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                inter = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * inter >= share * (len(p) + len(q) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node of each component, by alternating large and small stars."""
    spark = edges.sparkSession
    now, path = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        then, new_path = stored(small, label)
        # edges that stay the same in number and in content have become stars
        mark = tuple(then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(spark, path)
        now, path = then, new_path
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _hub_pairs(lists: DataFrame, order, share: int) -> DataFrame:
    hub = lists.groupBy("t").agg(F.min(F.struct(order.alias("order"), F.xxhash64("sid").alias("h"), "sid", "n", "comp")).alias("hub"))
    pairs = lists.join(hub, "t").where((F.col("sid") != F.col("hub.sid")) & (F.col("comp") != F.col("hub.comp")) & _alike("n", "hub.n", share))
    return pairs.select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b")).distinct()


def links(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(nodes, components): (doc_id, sid, n) of every document, and (sid, comp) of every linked set."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    nodes, _ = stored(_mapped(docs, words, _nodes, f"doc_id {kind}, sid bigint, n bigint", "doc_id"), "nodes")
    posted, p0 = stored(postings(docs, words, share), "postings")
    many = posted.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists, p1 = stored(posted.join(many, "t"), "lists")
    drop(spark, p0)

    wide = lists.where(F.col("c") > LIST)
    big = wide.groupBy("sid").agg(F.count(F.lit(1)).alias("big"))
    few = lists.where(F.col("c") <= LIST)
    a, b = few.select("t", *[F.col(c).alias(f"{c}_a") for c in ("sid", "n", "l")]), few.select("t", *[F.col(c).alias(f"{c}_b") for c in ("sid", "n", "l")])
    counted = a.join(b, "t").where((F.col("sid_a") < F.col("sid_b")) & _alike("n_a", "n_b", share)).groupBy("sid_a", "sid_b").agg(
        F.count(F.lit(1)).alias("shared"), F.first(F.least("l_a", "l_b")).alias("l"))
    left, right = big.select(F.col("sid").alias("sid_a"), F.col("big").alias("big_a")), big.select(F.col("sid").alias("sid_b"), F.col("big").alias("big_b"))
    counted = counted.join(left, "sid_a", "left").join(right, "sid_b", "left").na.fill(0, ["big_a", "big_b"])
    counted = counted.where(F.col("shared") >= F.col("l") - F.least("big_a", "big_b")).select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))
    members = wide.select("t", "sid", "n", "l").join(big, "sid").withColumn("comp", F.col("sid"))
    outside = F.expr(f"n - (n * {share} + 99) div 100 + l - big")
    pairs, p2 = stored(counted.union(_hub_pairs(members, outside, share)).distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).union(wide.select("sid")).distinct()
    one = nodes.join(wanted, "sid").groupBy("sid").agg(F.min("doc_id").alias("one")).select("one").distinct()
    sets, p3 = stored(_mapped(docs.select("doc_id", "text").join(one, docs["doc_id"].eqNullSafe(one["one"]), "left_semi"), words, _sets, ", ".join(["sid bigint", "keys binary", *[f"{s} bigint" for s in SKETCH]])).dropDuplicates(["sid"]), "sets")
    found, _ = stored(verified(pairs, sets, share), "links")
    comps = components(found)
    if not wide.isEmpty():
        for turn in (*range(1, ROUNDS + 1), None):
            held = wide.select("t", "sid", "n", "l").join(comps.select(F.col("node").alias("sid"), F.col("component").alias("comp")), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
            mixed = held.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("t")
            held, path = stored(held.join(mixed, "t", "left_semi"), "held")
            if turn is None:
                # a pair that shares a shingle of a short list as well was counted there, with these lists allowed for
                x, y = (held.join(sets.select("sid", *SKETCH), "sid").select("t", *[F.col(c).alias(f"{c}_{e}") for c in ("sid", "n", "l", "comp", *SKETCH)]) for e in "ab")
                shared = x.join(y, "t").where((F.col("comp_a") < F.col("comp_b")) & _alike("n_a", "n_b", share) & _near("a", "b", share)).groupBy(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b")).agg(
                    F.count(F.lit(1)).alias("shared"), F.first(F.least("l_a", "l_b")).alias("l"))
                next_pairs = shared.where("shared >= l").select("a", "b")
            else:
                next_pairs = _hub_pairs(held, F.xxhash64("sid", "t", F.lit(turn)), share)
                for e in "ab":
                    next_pairs = next_pairs.join(sets.select(F.col("sid").alias(e), F.octet_length("keys").alias(f"n_{e}"), *[F.col(s).alias(f"{s}_{e}") for s in SKETCH]).withColumn(f"n_{e}", F.expr(f"n_{e} div 8")), e)
                next_pairs = next_pairs.where(_near("a", "b", share)).select("a", "b")
            more, _ = stored(verified(next_pairs, sets, share), "links")
            drop(spark, path)
            if not more.isEmpty():
                found = reduce(DataFrame.union, [found, more])
                comps = components(found)
    drop(spark, p1, p2, p3)
    return nodes, comps.select(F.col("node").alias("sid"), F.col("component").alias("comp"))


def component_table(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    nodes, comps = links(docs, words, share)
    grouped = nodes.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("low")).join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    low = grouped.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_set = grouped.join(low, "comp").select("sid", "n", "component_id")
    out = nodes.join(of_set, ["sid", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, share: int = SHARE, by_row: bool = False) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, one row per doc_id.

    With ``by_row``, rows with different texts are different whatever their doc_id: the smallest row of each
    component stays, by doc_id (null last) and digest of the text, so no text goes with another's doc_id.
    """
    if by_row:
        rows = docs.withColumn("__row", row_key())
        table = component_table(rows.select(F.col("__row").alias("doc_id"), "text"), words, share)
        kept = table.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
        return rows.join(kept, rows["__row"].eqNullSafe(kept["__kept"]), "left_semi").dropDuplicates(["__row"]).drop("__row")
    kept = component_table(docs, words, share).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi").dropDuplicates(["doc_id"])


@llm_query("op9_ngram_join")
def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return component_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
