"""Spelling variants by search schemes on bidirectional FM-indexes of the vocabulary.

1. ``vocabulary``: runs of letters, counted per task and then per word.
2. Words one edit apart share the half before the edit or the half behind it, so a word is looked for twice:
   its first half exactly and one error behind it, then its last half exactly and one error before it.
   Words that share a first half are neighbours in the sorted vocabulary, words that share a last half are
   neighbours in the vocabulary sorted from the end. So there are two sets of shards, ranges of the one and
   of the other order, each of about SHARD code points; a search goes to the shards that its exact half
   reaches. A frequent beginning is spread over many shards and its words are searched where they lie.
3. ``Index``: a shard's words between delimiters, with the ranks of its suffixes and of its reversed text's.
   A state is a pair of intervals of suffix ranks; it can be extended by a letter on either side. All
   searches of a shard move on together, letter by letter.

A pair that both schemes find is counted by the first alone, so pairs need no shuffle to be told apart. A
word of m letters has at most a few letters times m near words, so nothing collects more than that.

Range bounds come from a sample of the vocabulary, about SAMPLE words a shard by hash, first KEY code points
each: they only balance the shards.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty string in the checksum;
repeated rows count each; a word of any length is searched whole; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import ceil, log2, log10
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import stored

LEAST = 7
OFTEN = 2
TIMES = 10
SHARD = 1 << 18
SAMPLE = 32
KEY = 40
STEP = 16  # ranks are kept at every STEP-th place
CELLS = 1 << 17  # letters of the words that are searched at once
END = "\0"
_LAST = "\U0010ffff"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST letters that occur OFTEN or more."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST},}}"), 0)).alias("run"))
    runs = runs.select("id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"), F.length("run").alias("m"))
    k = F.expr("cast(h % m as int)")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), k), F.substring("run", k + 2, F.col("m")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)


class Ranks:
    """Suffix ranks of a text taken as a ring: the letter before each suffix, and how often each occurs above a rank."""

    def __init__(self, text: np.ndarray, letters: int):
        n, rank, k = len(text), text.astype(np.int64), 1
        while True:  # ranks by the first k letters, doubled
            key = rank * (n + 1) + np.roll(rank, -k)
            self.place = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[self.place]) != 0)])
            rank = np.empty(n, np.int64)
            rank[self.place] = new
            k *= 2
            if new[-1] == n - 1 or k >= 2 * n:
                break
        self.before = np.concatenate([text[self.place - 1], np.zeros(STEP, text.dtype)]).astype(np.int64)
        count = np.zeros((n // STEP + 2, letters), np.int32)
        np.add.at(count, (np.arange(n) // STEP + 1, self.before[:n]), 1)
        self.count = np.cumsum(count, axis=0, dtype=np.int32)
        total = np.bincount(text, minlength=letters)
        self.first = np.cumsum(total) - total

    def above(self, rank: np.ndarray) -> np.ndarray:
        """How often each letter occurs before the suffixes above each rank: one row a rank."""
        out = self.count[rank // STEP]
        rest = rank % STEP
        for k in range(STEP - 1):
            row = np.flatnonzero(rest > k)
            out[row, self.before[rank[row] - rest[row] + k]] += 1
        return out


class Index:
    """A bidirectional index of words; ``flip`` is the index of the same words read from their ends."""

    def __init__(self, words: list[str]):
        code = np.frombuffer((END + END.join(words) + END).encode("utf-32-le"), "<u4")
        self.alphabet, text = np.unique(code, return_inverse=True)
        self.sides = Ranks(text, len(self.alphabet)), Ranks(text[::-1], len(self.alphabet))
        self.words = np.cumsum(text == 0) - 1, np.cumsum(text[::-1] == 0) - 1  # number of the word behind a delimiter

    def letters(self, word: str) -> np.ndarray:
        """Numbers of the word's letters; those no word has are -1."""
        code = np.frombuffer(word.encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, code), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == code, at, -1)

    def extended(self, state: np.ndarray, side: int, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own, other, size) of the states (rows of own, other, size) extended by every letter on one side.

        ``own`` is the first rank in the text that ``side`` names, where a letter goes in front.
        """
        near, far = (1, 0) if right else (0, 1)
        ranks = self.sides[side if not right else 1 - side]
        low, high = ranks.above(state[:, near]), ranks.above(state[:, near] + state[:, 2])
        size = high - low
        moved = {near: ranks.first + low, far: state[:, [far]] + np.cumsum(size, axis=1) - size}
        return moved[0], moved[1], size

    def step(self, state: np.ndarray, letter: np.ndarray, side: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(states, rows kept) after one given letter each."""
        row = np.flatnonzero(letter >= 0)
        own, other, size = self.extended(state[row], side, right)
        at = np.arange(len(row)), letter[row]
        new = np.column_stack([own[at], other[at], size[at]])
        kept = new[:, 2] > 0
        return new[kept], row[kept]

    def one_error(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, found): numbers of pairs one edit apart, where the edit lies behind the first half.

        With ``side`` 1 the words are read from their ends, so it lies before the last half.
        """
        spelled = [self.letters(w)[:: -1 if side else 1] for w in words]
        half = np.array([len(w) // 2 if not side else len(w) - len(w) // 2 for w in words])
        rest = np.array([len(w) for w in words]) - half + 1  # with the delimiter behind it
        full = np.zeros((len(words), int((half + rest).max()) + 1), np.int64)
        for i, w in enumerate(spelled):
            full[i, 1 : 1 + len(w)] = w  # a delimiter (0) on either side
        # the exact half: from its last letter to the delimiter in front
        query = np.arange(len(words))
        state = np.tile(np.array([0, 0, len(self.sides[0].place)]), (len(words), 1))
        for k in range(int(half.max()) + 1):
            still = half[query] >= k
            new, row = self.step(state[still], full[query[still], half[query[still]] - k], side, False)
            state, query = np.concatenate([state[~still], new]), np.concatenate([query[~still], query[still][row]])
        wrong, at = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)  # states with their error behind them
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(int(rest.max())):
            on = rest[query] > j
            state, query = state[on], query[on]
            wanted = full[query, half[query] + 1 + j]
            last = rest[query] == j + 1
            own, other, size = self.extended(state, side, True) if len(query) else (np.zeros((0, 1), np.int64),) * 3
            r, c = np.nonzero(size)
            child = np.column_stack([own[r, c], other[r, c], size[r, c]])
            letter = c > 0
            changed = letter & (c != wanted[r]) & ~last[r]
            exact = c == wanted[r]
            # an inserted letter stands before the wanted one, which then has to follow
            wrong, at = np.concatenate([wrong, child[letter]]), np.concatenate([at, query[r[letter]]])
            new, row = self.step(wrong, full[at, half[at] + 1 + j], side, True) if len(at) else (wrong, at)
            wrong, at = new, at[row]
            ended = rest[at] == j + 1
            done.append((wrong[ended, 0], at[ended]))
            left_out = ~last
            wrong = np.concatenate([wrong[~ended], child[changed], state[left_out]])
            at = np.concatenate([at[~ended], query[r[changed]], query[left_out]])
            state, query = child[exact], query[r[exact]]
        rank, word = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        number = self.words[side][self.sides[side].place[rank]]
        found = number if not side else self.words[0][-1] - 1 - number
        pairs = np.unique(np.column_stack([word, found]), axis=0)
        return pairs[:, 0], pairs[:, 1]


def near_pairs(words: list[str], searched: list[str], side: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of (searched, word) one edit apart: those of the first scheme, or those of the second alone."""
    index = Index(words)
    order, first = sorted(range(len(searched)), key=lambda i: len(searched[i])), 0
    while first < len(order):  # blocks of words of like length
        last = first + 1
        while last < len(order) and (last + 1 - first) * len(searched[order[last]]) <= CELLS // 8:
            last += 1
        block = np.array(order[first:last])
        a, b = index.one_error([searched[i] for i in block], side)
        a = block[a]
        if side and len(a):
            own = np.array([not words[y].startswith(searched[x][: len(searched[x]) // 2]) for x, y in zip(a, b, strict=True)])
            a, b = a[own], b[own]
        yield a, b
        first = last


def _bounds(words: DataFrame, shards: int, total: int) -> list[list[str]]:
    """Lower bounds of the shards in either order; the first is the empty string."""
    if shards == 1:
        return [[""], [""]]
    every = max(1, total // (SAMPLE * shards))
    some = [r.word[:KEY] + "\n" + r.word[::-1][:KEY] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word").toLocalIterator()]
    out = []
    for side in (0, 1):
        keys = sorted(x.split("\n")[side] for x in some)
        out.append(sorted({"", *(keys[i * len(keys) // shards] for i in range(1, shards) if keys)}))
    return out


def variant_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of every ordered pair of words one edit apart in (word, n)."""
    spark = words.sparkSession
    total, size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    bounds = spark.sparkContext.broadcast(_bounds(words, ceil(size / SHARD) or 1, total))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for side, low in enumerate(bounds.value):
                    whole, part = (w, w[: len(w) // 2]) if not side else (w[::-1], w[len(w) // 2 :][::-1])
                    lies = bisect_right(low, whole) - 1
                    for shard in range(bisect_right(low, part) - 1, bisect_right(low, part + _LAST)):
                        rows.append((side, shard, w, n, shard == lies))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["side", "shard", "word", "n", "lies"])

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("word")
        side, lies = group.column("side")[0].as_py(), group.column("lies").to_numpy()
        searched = group.column("word").to_pylist()
        words, n = [w for w, x in zip(searched, lies, strict=True) if x], group.column("n").to_numpy()[lies]
        out = [near_pairs(words, searched, side)] if words else []
        found = [x for pairs in out for x in pairs]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"word": group.column("word").take(pa.array(a)), "near": pa.array(words, pa.string()).take(pa.array(b)), "near_n": pa.array(n[b])})

    dealt = words.select("word", "n").mapInArrow(deal, "side int, shard int, word string, n bigint, lies boolean")
    return dealt.groupBy("side", "shard").applyInArrow(search, "word string, near string, near_n bigint")


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    words, _ = stored(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    near = variant_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    frequent = -F.col("best.m") >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n"))
    rows, _ = stored(rows, "forms")
    # a form occurs TIMES as often, which bounds the number of steps; each round doubles them
    most = rows.agg(F.max("n")).first()[0] or OFTEN
    hops = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(1 + log10(max(most / OFTEN, 1))))):
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("on"))
        hops, _path = stored(hops.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root")), "roots")
    return rows.join(hops, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: CRC-32 of UTF-8 bytes, bit by bit, with its reversed polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(t)), lambda i: ('0x' || substr(hex(encode(t)), 2 * i + 1, 2))::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT)"""
SQL = f"""WITH RECURSIVE rn AS (SELECT doc_id, translate(run, '{ascii_uppercase}', '{ascii_lowercase}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST},}}')) AS run FROM documents)),
oc AS MATERIALIZED (SELECT run, c, {_CRC} AS h FROM (SELECT run, count(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS t FROM rn GROUP BY doc_id, run)),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM oc) WHERE length(word) >= {LEAST} GROUP BY 1 HAVING sum(c) >= {OFTEN}),
dl AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS x FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
nr AS MATERIALIZED (SELECT dl.word, v.word AS near FROM dl JOIN v ON dl.x = v.word UNION SELECT v.word, dl.word FROM dl JOIN v ON dl.x = v.word UNION SELECT a.word, b.word FROM dl a JOIN dl b ON a.x = b.x AND a.i = b.i AND a.word <> b.word),
bs AS (SELECT nr.word, count(*) AS n_near, arg_min(v.word, (-v.n, v.word)) AS near, max(v.n) AS m FROM nr JOIN v ON v.word = nr.near GROUP BY 1),
fm AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * v.n THEN near END AS form, CASE WHEN m >= {TIMES} * v.n THEN m END AS form_n FROM v LEFT JOIN bs USING (word)),
hp AS (SELECT word, word AS root, 0 AS k FROM fm UNION ALL SELECT hp.word, fm.form, k + 1 FROM hp JOIN fm ON fm.word = hp.root WHERE fm.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM fm JOIN (SELECT word, arg_max(root, k) AS root FROM hp GROUP BY 1) USING (word)"""


@llm_query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the corpus."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
