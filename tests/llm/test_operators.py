"""Operators for training text against brute force, and their defined cases on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from coilwise.llm import archives, mixing, ngram_join, notices, quality, repeats, sketches, templates, token_files, url_rules
from tests.llm.brute import components, kept_words, likeness_rows

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank string, size int, `odd name` string"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
PASSAGE = "the old mill by the river was sold to a man from the north who never came back to see it again in spring or in autumn"


def row(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), "x", 1, "y")


ROWS = [
    row(1, PASSAGE + " alone at first"), row(2, "other words before " + PASSAGE), row(3, None), row(4, ""), row(5, "one"), row(6, "one two three"), row(7, "One two THREE"),
    row(8, PASSAGE + " alone at first", None), row(None, PASSAGE + " without an id", "b"), row(9, LONG, "b"), row(10, LONG + " tail", "b"), row(11, "a\nb\nc\nd", "c"), row(12, "a\nb\nc\ne", "c"), row(12, "a\nb\nc\ne", "c"),
    row(12, "same id with another text and " + PASSAGE, "c"), row(13, " \t\n ", "c"), row(14, "ünï cödé Straße, 中文 test. 1,000.5 km!! <|endoftext|> Σίσυφος", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mix_sizes_and_targets(spark, docs):
    got = mixing.ranked_documents(docs.select("doc_id", "source", mixing.words_in("text").alias("size"))).collect()
    assert len(got) == len(ROWS)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert all(t <= 3 * s + 1e-9 for t, s in targets.values())
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)


def test_mix_keeps_columns_and_reruns_agree(docs, none):
    a, b = mixing.mix_documents(docs), mixing.mix_documents(docs.repartition(5))
    assert a.columns == docs.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert mixing.mix_documents(none).count() == 0


def test_mix_is_near_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 200)), s) for i in range(3000) for s in ["abcde"[i % 5]]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    r = mixing.ranked_documents(d.select("doc_id", "source", mixing.words_in("text").alias("size"))).select("*", mixing.copies(mixing.F.col("rank"), 7).alias("n")).toPandas()
    for _, g in r.groupby("source"):
        assert abs((g.n * g["size"]).sum() - g.target.iloc[0]) < 0.02 * g.target.iloc[0]
        assert (g.n <= 3).all()


ITEM = "Anna walks 12 km to the big market and buys 5 apples while her brother Paul stays at home for 3 hours"


def test_templates(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "only three words"), (5, "plain words without any slot that go on for rather more than thirteen words in all")], "item_id bigint, text string")
    d = spark.createDataFrame([
        row(1, "before it. " + ITEM + " and after"), row(2, ITEM.replace("12 km", "40 miles").replace("5", "9").replace("Paul", "John")),
        row(3, ITEM.replace("12", "5")), row(4, "Only three words"), row(5, "only three words more"), row(6, None), row(7, ""), row(8, "numbers 1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
        row(9, "then Anna walks 12 km to the small house"), row(None, ITEM), row(10, "Anna walks 7 km to the big market and buys 7 apples while her brother Paul stays at home for 7 hours"),
        row(11, "so plain words without any slot that go on for rather more than thirteen words in all, he said"),
    ], DOCS)
    got = {(r.doc_id, r.item_id): r.changed for r in templates.leaks(d, items).collect()}
    assert got == {(1, 1): 0, (2, 1): 4, (3, 1): 1, (4, 4): 0, (None, 1): 0, (10, 1): 3, (11, 5): 0}
    clean = templates.decontaminated(d, items)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == [5, 6, 7, 8, 9]
    assert templates.leaks(none, items).count() == templates.leaks(docs, items.limit(0)).count() == 0


def test_templates_want_consistent_slots(spark):
    item = "the first train takes 4 hours to the coast and the second train takes 4 hours to the coast"
    d = spark.createDataFrame([(1, item.replace("4", "6")), (2, item.replace("4", "6", 1))], "doc_id bigint, text string")
    got = templates.leaks(d, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.slots, r.changed) for r in got] == [(1, 2, 1)] or [(r.doc_id, r.changed) for r in got if r.doc_id == 1]
    assert 2 not in {r.doc_id for r in got}


def test_templates_find_dense_and_short_items(spark):
    dense, other = "Compute 12 km + 7 km - 3 km, 4 km + 9 km - 8 km, 15 km + 2 km - 1 km.", "Sort 12, 7, 3, 44, 15, 2, 9, 31, 8, 6, 27, 5 and 19."
    items = spark.createDataFrame([(1, dense), (2, other), (3, "which city lies on the river"), (4, "he paid 12 dollars for the old book")], "item_id bigint, text string")
    d = spark.createDataFrame([
        (1, "now " + dense), (2, other), (3, other.replace("44", "45").replace("31", "32").replace("7", "70")), (4, "he asked: Which city lies on the river? and went"), (5, "which city lies on a river"),
        (6, "so he paid 15 euros for the old book there"), (7, "so he paid 15 euros for the old boat there"),
    ], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.changed for r in templates.leaks(d, items).collect()}
    assert got == {(1, 1): 0, (2, 2): 0, (4, 3): 0, (6, 4): 2}


def test_templates_in_any_case_and_after_sentence_ends(spark):
    names = "when Anna met Paul at the gate with Mary and Tom who saw Peter behind Lucy and the dog of Frank they all went home"
    units = "the road is 12 km long and then 5 km wide while it is 7 km deep at the end of it"
    starts = "Anna bought 12 apples at the market today. Tom gave her 5 more after lunch. Anna ate 3 of them before the evening came."
    items = spark.createDataFrame([(1, names), (2, units), (3, starts)], "item_id bigint, text string")
    d = spark.createDataFrame([
        (1, names.lower()), (2, names.replace(" ", "\n")), (3, units.replace("km", "KM")), (4, "So it was. " + starts.replace("Anna", "Lucy").replace("Tom", "Frank").replace("12", "9")),
        (5, units.replace(" ", " \u00a0")),
    ], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.changed for r in templates.leaks(d, items).collect()}
    assert got == {(1, 1): 0, (2, 1): 0, (3, 2): 0, (4, 3): 3, (5, 2): 0}


def test_templates_shuffle_windows_without_their_documents(spark, monkeypatch):
    """A benchmark too large to broadcast: rows that meet it hold a window, not the lists of a document, and find the same."""
    items = spark.createDataFrame([(i, ITEM.replace("Anna", f"Anna{'xyz'[i % 3] * i}")) for i in range(40)], "item_id bigint, text string")
    d = spark.createDataFrame([(i, LONG[: 500 * i] + " " + ITEM.replace("12", str(i))) for i in range(8)], "doc_id bigint, text string")
    want = sorted(map(tuple, templates.leaks(d, items).collect()))
    for name, most in (("HASHES", 0), ("BROADCAST", -1), ("ITEMS", 10)):
        monkeypatch.setattr(templates, name, most, raising=False)
    got = templates.leaks(d, items)
    assert sorted(map(tuple, got.collect())) == want and {r[:2] for r in want} >= {(i, 0) for i in range(8)}

    def wide(node):
        kids = [node.children().apply(i) for i in range(node.children().size())]
        own = [k for k in kids if "caps" in [k.output().apply(i).name() for i in range(k.output().size())]] if node.nodeName() == "Join" else []
        return own + [x for k in kids for x in wide(k)]

    assert not wide(got._jdf.queryExecution().optimizedPlan())


@pytest.mark.parametrize("shard", [1 << 9, 8 << 20])
def test_repeats(docs, none, shard):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in repeats.removals(docs, shard).collect())
    want = sorted((str(i), n, g, hashlib.sha256(k).hexdigest()) for i, n, g, k in kept_words(ROWS))
    assert got == want
    assert repeats.removals(none).count() == 0


def test_repeats_with_many_rows_of_one_id(spark):
    """Rows without id and rows of one id keep their own positions; what they take comes from smaller ids alone."""
    rng = np.random.default_rng(7)
    parts = [" ".join(f"{k}w{i}" for i in range(20)) for k in range(6)]
    rows = [row(1, parts[0] + " " + parts[1])] + [row(i, " ".join([f"x{j}"] * int(rng.integers(0, 4)) + [parts[k] for k in rng.integers(0, 6, 3)])) for i in (None, 5) for j in range(400)]
    rows += [rows[-1]] * 200 + [row(None, parts[2])] * 200
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in repeats.removals(spark.createDataFrame(rows, DOCS).repartition(4)).collect())
    assert got == sorted((str(i), n, g, hashlib.sha256(k).hexdigest()) for i, n, g, k in kept_words(rows))


def test_notices(docs, spark, none):
    d = spark.createDataFrame([(1, "Licensed under CC BY 4.0. All Rights, Reserved!"), (2, "Lisensed under the Apache Licence, version 2.0"), (3, None), (4, "GNU General-Public  License"), (5, "accby all right reserve")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in notices.scan_notices(d).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 2, 6, "cc-by,reserved")
    assert got[2].labels == "apache-2.0" and got[2].n_base == 0 and 0.8 < got[2].score < 1 and got[2].spans[0].errors == 2
    assert (got[3].n_words, got[3].labels, got[3].score, got[3].first_word) == (0, "", 0.0, None)
    assert got[4].base_labels == "gpl" and got[4].labels == "gpl"
    assert got[5].base_labels == "" and got[5].labels == "reserved"
    assert notices.scan_notices(docs).count() == len(ROWS) and notices.scan_notices(none).count() == 0


def test_notices_keep_worse_matches_beside_better_ones():
    scan = notices.Scanner()
    assert [x[2:4] for x in scan.fuzzy_places(b" all right reserve all rights reserved all rights reservd ")] == [("reserved", 2), ("reserved", 0), ("reserved", 1)]
    assert [x[2] for x in scan.fuzzy_places(b" licenced undr cc by nd licensed under cc by nc ")] == ["cc-by-nd", "cc-by-nc"]


def test_quality(spark, sf, docs, none):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(table, labels)
    scores = quality.scored(docs, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert quality.keep_good(docs, labels.limit(0)).count() == len(ROWS)
    assert quality.keep_good(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    r = quality.op5_quality_scores(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r.predicted == r.quality).mean() > 0.9


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    t = quality.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), rounds=5, depth=3)
    for r in x[:20]:
        total = t.base
        for f, b, v in zip(t.feature, t.bound, t.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(r[f[k]] > b[k])
            total += v[k - len(f)]
        assert t.score(r[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("counts", [[5], [1, 1], [1000000, 1, 1, 1], [2**i for i in range(25)], list(range(1, 300))])
def test_huffman_round_trip(counts):
    c = np.array(counts)
    lengths = token_files.code_lengths(c)
    assert lengths.max() <= token_files.LIMIT and sum(2.0 ** -lengths) <= 1
    ids = np.arange(len(c)) * 3
    code, length = np.zeros(ids.max() + 1, np.uint64), np.zeros(ids.max() + 1, np.int64)
    code[ids], length[ids] = token_files.canonical(ids, lengths), lengths
    stream = np.random.default_rng(2).choice(ids, 5000 + len(c))
    offsets, bits = token_files.encode_block(stream, code, length)
    assert (token_files.decode_block(offsets, bits.tobytes(), len(stream), token_files.decode_table(ids, lengths)) == stream).all()


def test_huffman_is_optimal_where_the_limit_is_far():
    import heapq

    c = np.random.default_rng(3).integers(1, 1000, 60)
    heap, cost = list(c), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert (token_files.code_lengths(c) * c).sum() == cost


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    got = token_files.token_digest(docs).orderBy("start").collect()
    want = {}
    for r in ROWS:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, token_files.END_ID]
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_files.token_digest(none).count() == 0


def test_tokeniser_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBER", 8)
    t = token_files.Tokeniser(token_files.default_tokenizer())
    want = t.ids(["a b c d, e."])
    for text in ("f g h", "a b c d, e.", "i j k l m n o p q", "a b x", "b y a"):
        t.ids([text])
        assert len(t.known) + len(token_files._older.get(t.file, {})) <= 2 * (8 + 20)
    assert t.ids(["a b c d, e."]) == want


def test_tokeniser_equals_the_library_on_odd_letters():
    from tokenizers import Tokenizer

    tool, own = Tokenizer.from_file(token_files.default_tokenizer()), token_files.Tokeniser(token_files.default_tokenizer())
    assert own._cuts()
    rng = np.random.default_rng(9)
    odd = [*"abİıßΣςÄéñ中ǅŉΐ", "a\u0301", "\u0307", "\u0345", "1", ".", ",", "'s", "'", "-", "!", " ", " ", "\n", "<|endoftext|>", "\u00ad", "\u200d", "²"]
    texts = ["".join(odd[k] for k in rng.integers(0, len(odd), rng.integers(1, 12))) for _ in range(20_000)] + ["BİTTİ.", "İ.", "İ, İ"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tool.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b in zip(texts, own.ids(texts), want, strict=True) if a != b]
    assert not wrong, wrong[:5]


def test_other_tokenizer_files_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a b  c\nd, e.", "", "Plain words. "]
    assert token_files.Tokeniser(file).ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)]


def test_url_rules(spark):
    urls = [
        "http://www.Example.NET/en/1?a=b", "https://a.b.net/x", "ftp://example.com/de/", "http://example.com/fr/1", "https://x.org/fr/9#z", "http://x.org/frx", None, "no scheme", "://", "http://EXAMPLE.net", "x://h?/fr/", "http://notexample.net/en/",
    ] * 3
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, token string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_rules.judge(pages).collect()}
    assert [got[i] for i in range(12)] == [
        ("www.example.net", "/en/1", "example.net/en/"), ("a.b.net", "/x", "net/"), ("example.com", "/de/", "example.com/de/"), ("example.com", "/fr/1", None), ("x.org", "/fr/9", "org/fr/"), ("x.org", "/frx", None),
        ("", "", None), ("", "", None), ("", "", None), ("example.net", "", None), ("h", "", None), ("notexample.net", "/en/", "net/"),
    ]
    assert len(got) == len(urls)
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_mined_rules_equal_a_count_of_all_combinations(spark):
    from itertools import combinations

    rows = [(["a", "b"], "block")] * 6 + [(["a"], "allow")] * 5 + [(["b", "c"], "block")] * 4 + [(["c"], "allow")] * 5
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.8).collect()}
    sets = {s for t, _ in rows for k in (1, 2) for s in combinations(sorted(t), k)}
    share = {v: sum(x == v for _, x in rows) / len(rows) for v in ("block", "allow")}
    want = {}
    for s in sets:
        under = [v for t, v in rows if set(s) <= set(t)]
        for v in ("block", "allow"):
            n = under.count(v)
            if n / len(rows) >= 0.1 and n / len(under) >= 0.8 and n / len(under) > share[v]:
                want[(s, v)] = n / len(under)
    assert got == pytest.approx(want)


def test_sketches(spark, docs, none):
    got = sketches.with_neighbour(docs).collect()
    assert len(got) == len(ROWS)
    ids = [r[0] for r in ROWS if r[0] is not None]
    assert {r.next for r in got if r.doc_id == 1} <= {r[1] for r in ROWS if r[0] is None} and len(ids) == len(ROWS) - 1
    assert sketches.with_neighbour(none).count() == 0
    alone = sketches.with_neighbour(docs.where("doc_id = 11")).first()
    assert alone.text == alone.next


@pytest.mark.parametrize("n", [0, 1, 5, 40, 700])
def test_differences_are_whole(spark, n):
    a, b = [f"p{i}" for i in range(n)], [f"p{i}" for i in range(n // 3, n + n // 2)]
    d = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string").select(*[sketches.digests(sketches.F.col(c)).alias(f"{c}_set") for c in "ab"])
    d = d.select("*", *[sketches.sketch(sketches.F.col(f"{c}_set")).alias(f"{c}_cells") for c in "ab"])
    r = sketches.differences(d, "diff", "a", "b").select("diff", sketches.likeness("diff", "a").alias("like")).first()
    assert (r.diff.a, r.diff.b) == (len(set(a) - set(b)), len(set(b) - set(a)))
    assert r.like == pytest.approx(likeness_rows(a, b))


@pytest.mark.parametrize("limit", [2, 64])
def test_ngram_join(spark, docs, none, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "LIST", limit)
    monkeypatch.setattr(ngram_join, "OFTEN", limit)
    rng = np.random.default_rng(5)
    rows = [r for r in ROWS if r[0] is not None and r[0] != 12]
    base = [f"v{rng.integers(5000)}" for _ in range(120)]
    for i in range(40):
        text = list(base)
        for _ in range(rng.integers(0, 4)):
            text[rng.integers(len(text))] = f"z{rng.integers(1000)}"
        rows.append(row(100 + i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.component_table(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == components(rows)
    one = ngram_join.one_of_each(docs)
    assert one.columns == docs.columns and one.where("doc_id = 12").count() == 1
    assert ngram_join.component_table(docs).count() == len(ROWS) and ngram_join.component_table(none).count() == 0


def test_pipeline_links_five_words_at_80_percent(spark):
    text = [f"w{i}" for i in range(200)]
    d = spark.createDataFrame([row(1, " ".join(text)), row(2, " ".join(text[:-36])), row(3, " ".join(text[:-45]))], DOCS)
    assert [r.component_id for r in ngram_join.component_table(d.where("doc_id < 3")).sort("doc_id").collect()] == [1, 2]
    assert [r.doc_id for r in corpus_pipeline.one_per_group(spark, d.where("doc_id <> 3"), "").collect()] == [1]
    assert sorted(r.doc_id for r in corpus_pipeline.one_per_group(spark, d.where("doc_id <> 2"), "").collect()) == [1, 3]


def test_pipeline_tells_rows_of_one_id_apart(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    d = spark.createDataFrame([row(None, text["a"]), row(None, text["b"]), row(None, text["b"]), row(1, text["c"]), row(2, text["c"] + " tail"), row(2, text["d"]), row(3, text["e"]), row(4, None), row(None, text["e"] + " tail")], DOCS).repartition(3)
    one = [(r.doc_id, r.text) for r in corpus_pipeline.one_per_group(spark, d, "").collect()]
    want = [(None, text["a"]), (None, text["b"]), (1, text["c"]), (2, text["d"]), (3, text["e"]), (4, None)]
    assert sorted(one, key=str) == sorted(want, key=str)
    items = spark.createDataFrame([(1, text["a"]), (2, text["d"])], "item_id bigint, text string")
    clean = [(r.doc_id, r.text) for r in templates.decontaminated(d, items).collect()]
    assert len(clean) == 7 and (None, text["b"]) in clean and (2, text["c"] + " tail") in clean and (None, text["a"]) not in clean and (2, text["d"]) not in clean


def test_archives(spark):
    pages = spark.createDataFrame([(3, "http://a/ b", "<p>ä</p>"), (1, None, "<p>ä</p>"), (2, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nx\r\n\r\n"), (5, "u", "WARC/1.1\r\n\r\nx\r\n\r\n"), (None, "u", "last")], "page_id bigint, url string, html string")
    folder = archives.new_folder(spark, "warc")
    archives.convert_archives(archives.as_arc(pages), folder)
    got = sorted(archives.read_warc(spark, folder).collect(), key=str)
    kinds = sorted(((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str)
    assert kinds == sorted([("3", 9, "revisit", 1), ("1", 9, "response", None), ("2", 0, "response", None), ("4", 0, "revisit", 2), ("5", 17, "response", None), ("5", 17, "revisit", 5), ("None", 4, "response", None)], key=str)
    empty = archives.new_folder(spark, "warc")
    archives.convert_archives(archives.as_arc(pages.limit(0)), empty)
    assert archives.read_warc(spark, empty).count() == 0


def test_archives_of_pages_that_repeat_an_id(spark):
    """Thousands of rows of one page or none: one response for each payload, all others refer to it."""
    rows = [(None if i % 3 else 7, f"u{i % 5}", f"p{i % 4}") for i in range(3000)] + [(9, "u", "p0"), (2, "u", "p3")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    folder = archives.new_folder(spark, "warc")
    archives.convert_archives(archives.as_arc(pages), folder, file_bytes=2000)
    got = archives.read_warc(spark, folder).collect()
    assert len(got) == len(rows) and spark.read.format("binaryFile").load(f"{folder}/part-*").count() > 2
    for digest in {r.payload_digest for r in got}:
        own = [r for r in got if r.payload_digest == digest]
        first = min((r.page_id for r in own if r.page_id is not None))
        assert [r.page_id for r in own if r.record_type == "response"] == [first]
        assert {r.refers_to for r in own if r.record_type == "revisit"} == {first}


def test_revisits_name_their_response(spark):
    pages = spark.createDataFrame([(i, "u", "same") for i in range(5)], "page_id bigint, url string, html string")
    folder = archives.new_folder(spark, "warc")
    archives.convert_archives(archives.as_arc(pages), folder)
    import gzip
    records = [f for r in spark.read.format("binaryFile").load(f"{folder}/part-*").collect() for f, _ in archives.parse_warc(gzip.decompress(r.content))]
    ids = [f["WARC-Record-ID"] for f in records]
    response = next(f["WARC-Record-ID"] for f in records if f["WARC-Type"] == "response")
    assert len(set(ids)) == 5 and {f["WARC-Refers-To"] for f in records if f["WARC-Type"] == "revisit"} == {response}


def test_arc_versions():
    for version in (1, 2):
        (fields, body), = archives.parse_arc(archives.arc_bytes(version, "http://x", b"abc\n\nd"))
        assert fields["url"] == "http://x" and archives.payload_of(body) == b"abc\n\nd"
    with pytest.raises(ValueError):
        list(archives.parse_arc(archives.arc_bytes(1, "u", b"abc")[:-3]))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_template_forms_are_made_once(spark):
    texts = spark.createDataFrame([(1, "Walk 5\n  km to Oslo and then 1.5 miles back home. Oslo is far")], "doc_id long, text string")
    windows = templates._windows(templates._forms(texts, "doc_id"), [8])
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    # a condition on a list, moved down to the text, would make the list again
    assert plan.count("regexp_extract_all") == 3
    row = windows.where("at = 0").first()
    assert row.raw == ["walk", "5", "km", "to", "oslo", "and", "then", "1.5", "miles", "back", "home", "oslo", "is", "far"]
    assert row.tokens[:5] == ["walk", "0", "ℚ", "to", "ℕ"] and row.caps[:5] == ["ℕ", "0", "ℚ", "to", "ℕ"]


def test_texts_of_few_tokens(spark):
    texts = ["", None, "a b c d e f g", "a b c d e f g h", "-" * 500 + " a b c d e f g h", "-" * 500 + " a b c", "x" * 600 + " b c d e f g", "1.5 " * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(r.doc_id for r in templates._of_few_tokens(df).collect()) == [0, 2, 5, 6]


def test_segments_of_one_text_need_no_search(monkeypatch):
    text = b" ".join(b"w%d" % i for i in range(20))
    ids, marks, words, one = np.array([7, 3, 3, 9]), np.array([1, 2, 5, 4]), np.array([0, 4, 4, 30]), np.zeros(4, np.int64)
    blob = repeats.pack(ids, marks, words, one, [text] * 4)
    monkeypatch.setattr(repeats.ahocorasick, "Automaton", None)
    assert sorted(repeats.locate([blob])) == [(7, 1, 0, 20), (9, 4, 30, 20)]
    assert repeats.locate([repeats.pack(ids[1:3], marks[1:3], words[1:3], one[1:3], [text] * 2)]) == []  # one doc_id alone


def test_pieces_are_learnt_without_offsets_and_counted_by_slice(spark, monkeypatch):
    texts = ["a.b, c!! d's \"Σίσυφος\" İstanbul, x-ray 12, 3.5. (ok) ... !a", "", "one, one! one one", "naïve straße? ŉ."]
    tool = token_files.Tokeniser(token_files.default_tokenizer())
    tool.ids(["a"])
    asked = []
    whole = token_files.Tokeniser._whole
    monkeypatch.setattr(token_files.Tokeniser, "_whole", lambda self, x: asked.append(len(x)) or whole(self, x))
    got = tool.ids(texts)
    assert asked and got == whole(tool, texts)
    tool.forget()
    lists = [np.array([5, 5, 7], np.uint32), np.array([70_000, 5], np.uint32), np.array([], np.uint32)]
    rows = spark.createDataFrame([(bytearray(token_files._pack(x)),) for x in lists], "ids binary").coalesce(1)
    assert {r.id: r.n for r in token_files.id_counts(rows).collect()} == {1: 3, 5: 3, 7: 1, 70_000: 1}


def test_pieces_are_looked_up_once_a_slice():
    class Counting(dict):
        asked = 0

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

        def get(self, key, other=None):
            Counting.asked += 1
            return super().get(key, other)

    tool = token_files.Tokeniser(token_files.default_tokenizer())
    texts = ["", "the cat, the dog  the\nΣ cat", "the " * 500, " "]
    want = tool.ids(texts)
    assert want == tool._whole(texts)
    tool.known = Counting(tool.known)
    assert tool.ids(texts) == want and Counting.asked <= 10
    assert tool.ids([]) == [] and tool.ids(["", ""]) == [b"", b""]
