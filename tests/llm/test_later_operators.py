"""Merkle manifest, sentence pieces and spelling variants against brute force, on odd rows and hot keys."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from coilwise.llm import merkle, pieces, variants
from coilwise.llm.merkle import F
from tests.llm.test_operators import DOCS, ROWS, row

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows):
    """Rows of the manifest, one per (doc_id, text, lang, source, n_chars), by plain lists."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha(*map(value, (r[0], r[3], r[2], r[4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            a = i // 8 * 8
            yield i - a, nodes[a:i] + nodes[i + 1 : a + 8]
            i //= 8

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {x: levels([leaf(r, r[1]) for r in by[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            proof = [*path(trees[x], i), *path(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, r[1].translate(LOWER)) if bad and r[1] is not None else trees[x][0][i]
            for digit, others in proof:
                now = sha(*others[:digit], now, *others[digit:])
            yield r[0], trees[x][0][i], trees[x][-1][0], top[-1][0], sha(*(s for _, o in proof for s in o)), now, now == top[-1][0]


def checked(df):
    rows = merkle.proofs(df).withColumn("p", F.array_join(F.flatten(F.transform("proof", lambda x: x["others"])), ""))
    return sorted(map(str, ((r.doc_id, r.leaf, r.subroot, r.root, sha(r.p), r.folded_root, r.folded_root == r.root) for r in rows.collect())))


def test_manifest_of_odd_rows(docs, none):
    assert checked(docs) == sorted(map(str, manifest(ROWS)))
    assert merkle.proofs(none).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 600])
def test_manifest_of_any_size(spark, n):
    rows = [(i, f"Text {i}", [None, "", "de", "Ü"][i % 4] if n > 64 else "en", None if i % 5 else "s", i) for i in range(n)]
    got = checked(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert got == sorted(map(str, manifest(rows)))


def test_manifest_of_many_languages_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SHELF", 16)
    rows = [(None, "Same", "en", "s", 4)] * 700 + [(i, "x", f"l{i}", "s", 1) for i in range(20)]
    got = checked(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5))
    assert got == sorted(map(str, manifest(rows)))


def test_manifest_finds_only_what_was_asked(spark):
    nodes = spark.range(100).select(F.lit("t").alias("tree"), F.col("id").alias("at"), F.lit(100).cast("bigint").alias("n"), merkle.digest(F.col("id").cast("string")).alias("digest"))
    records, tops = merkle.grow(nodes)
    tops = tops.withColumn("path", F.array().cast("array<struct<digit:int,others:array<string>>>"))
    asked = nodes.where("at % 37 = 5").select("tree", F.col("at").alias("rank"), F.col("at").alias("request"))
    got = {r.request: (r.digest, [x.digit for x in r.path], [len(x.others) for x in r.path]) for r in merkle.descend(records, tops, asked).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: sha(str(i)) for i in (5, 42, 79)}
    assert got[79][1:] == ([1, 1, 7], [1, 4, 7])


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n\nb", "\n a", " \n", "x\ty", "▁", "▁▁a▁b", "a ▁ b", "<s> </s> <unk> <0x0A>", "中文 字", "日本", "é", " x y", "😀 😀😀", "İ.", "1234 567", "\r\n", "a" * 3000, "   " * 50 + "x", "\u0000 b", "ﬁ Å",
]


def piece_rows(rows):
    tool = pieces.model_of(pieces.default_model())
    for r in rows:
        ids = [tool.bos_id(), *tool.encode(r[1] or ""), tool.eos_id()]
        yield r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(tool.decode(ids))


def test_pieces_equal_the_library(spark, docs, none, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 5000)
    monkeypatch.setattr(pieces, "FREQUENT", 40)
    assert sorted(map(str, map(tuple, pieces.piece_digest(docs).collect()))) == sorted(map(str, piece_rows(ROWS)))
    rng = np.random.default_rng(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "".join(TEXTS[k] for k in rng.integers(0, len(TEXTS) - 5, 6))) for i in range(300)] + [(None, "the the"), (None, "the the"), (None, None)]
    got = pieces.piece_digest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, piece_rows(rows)))
    assert pieces.piece_digest(none).count() == 0


def test_chunks_cut_nowhere_or_at_all_places():
    tool = pieces.model_of(pieces.default_model())
    whole, cut = pieces.Cutter(pieces.default_model()), pieces.Cutter(pieces.default_model())
    whole.exact = False
    for text in TEXTS:
        for c in (whole, cut):
            assert b"".join(map(c.ids, c.chunks(text))) == np.array(tool.encode(text), "<u4").tobytes()
        assert len(whole.chunks(text)) <= 1


def test_many_chunks_need_wide_numbers(spark):
    text = " ".join(f"w{i}" for i in range(70_000))
    got = pieces.piece_digest(spark.createDataFrame([(1, text), (2, "w5 w69999")], "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(piece_rows([(1, text), (2, "w5 w69999")]))


def spellings(rows):
    """Rows of the spelling table over all pairs of words."""
    count = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            count[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]

    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: f for w, v in beside.items() if v and n[f := min(v, key=lambda x: (-n[x], x))] >= 10 * n[w]}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        yield w, n[w], len(beside[w]), form.get(w), n.get(form.get(w)), root


@pytest.mark.parametrize("shard", [200, 1 << 18])
def test_variants(spark, docs, none, monkeypatch, shard):
    monkeypatch.setattr(variants, "SHARD", shard)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abÀÿ×"), rng.integers(7, 10))) for _ in range(150)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "bbbaaaa", "abcdefgh" * 30, "abcdefgh" * 29 + "abcdefg"]
    rows = [row(i, " ".join(rng.choice(words, 60))) for i in range(25)] + [row(100 + i, "aaaaaaa," * 40 + "Connection connectio") for i in range(12)] + [row(None, None), row(None, "aaaaaaab aaaaaaab")]
    rows += [row(200 + i, " ".join(w for k, w in enumerate(["abcdefghi", "abcdefghj", "abcdefgkj", "abcdelgkj"]) for _ in range(12**k))) for i in range(20)]
    got = variants.variants(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(str, ((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got))) == sorted(map(str, spellings(rows)))
    assert any(r.form not in (None, r.root) for r in got)  # chains are followed
    assert sorted(r.word for r in variants.variants(docs).collect()) == sorted(x[0] for x in spellings(ROWS))
    assert variants.variants(none).count() == 0


def test_one_error_in_either_half():
    words = ["kettles", "kettle", "settles", "kettels", "kettlesx", "xkettles", "kttles", "kettlle", "kettleß", "battles"]
    want = {("kettles", x) for x in ("kettle", "settles", "kettlesx", "xkettles", "kttles", "kettleß")}
    got = {(s, w) for side in (0, 1) for a, b in variants.near_pairs(words, ["kettles"], side) for s, w in ((["kettles"][i], words[j]) for i, j in zip(a, b, strict=True))}
    assert got == want
    twice = [(i, j) for side in (0, 1) for a, b in variants.near_pairs(["aaaaaaa", "aaaaaaaa"], ["aaaaaaa", "aaaaaaaa"], side) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(twice) == [(0, 1), (1, 0)]


def test_driver_gives_memory_back(spark, monkeypatch):
    from coilwise.llm import shared

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    monkeypatch.setattr(shared, "HEAP", 2.0)
    shared.stored(spark.range(3), "tidy")
    assert full() == before
    monkeypatch.setattr(shared, "HEAP", 0.0)
    shared.stored(spark.range(3), "tidy")
    assert full() > before


def test_driver_gives_a_grown_heap_back(spark, monkeypatch):
    from coilwise.llm import shared

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    spark._jvm.System.gc()
    before = full()
    # little of the heap is in use, but it has grown to its limit
    monkeypatch.setattr(shared, "HEAP", 0.99 * heap.totalMemory() / heap.maxMemory())
    shared.stored(spark.range(3), "tidy")
    assert full() > before
