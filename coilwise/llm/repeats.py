"""Substring dedup with repeated-phrase automata.

A window is 13 consecutive words. Windows that also start in a document of smaller doc_id are located
and their words removed. Work is split so that each window is looked at in one shard:

1. Every window has a least 5-word gram (its minimiser, by hash). Consecutive windows with the same
   minimiser form a segment, so equal windows of different documents always go to the same shard, and each
   window goes to one shard only. Segments travel as compressed blobs, one per task flush and shard.
2. A shard confirms which windows recur in several documents, compiles them into an Aho-Corasick automaton
   over word numbers (pyahocorasick), and streams the segments of all documents through it. Each match
   gives the window's first document; where that is smaller than the segment's own, the words are covered.
   Equal segments are streamed once.
3. Covered ranges meet the whole texts again by doc_id and a 64-bit digest of the text.

Words are compared as they are, hashes only choose the shard. Shards are sized from the bytes of the
corpus to about SHARD bytes of segments, however large it is; the segments of one minimiser stay together.

Defined cases: null or empty texts have no words; a null doc_id is larger than any other, and documents
without id take nothing from each other; rows that share a doc_id take nothing from each other and each
keep their own positions; a window twice in one document alone stays; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import slices, stored
from .words import spans, window_hashes, word_hashes

WINDOW = 13
GRAM = 5
SHARD = 8 << 20
FLUSH = 12 << 20
NO_ID = 2**63 - 1


def normal(text: str | None) -> bytes:
    """The words with one blank between them."""
    return b" ".join((text or "").encode().split())


def mark() -> Column:
    """64 bits that tell rows of one doc_id apart by their texts."""
    return F.xxhash64("text").alias("mark")


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, minimiser, first byte, end byte) of each segment; bytes count over all texts joined."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, end, doc = spans(data, offsets)
    none = np.zeros(0, np.int64)
    if len(start) < WINDOW:
        return none, none, none.astype(np.uint64), none, none
    grams = window_hashes(word_hashes(data, start, end), GRAM)
    n = len(start) - WINDOW + 1
    least = grams[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[j : j + n], out=least)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    if not len(at):
        return none, none, none.astype(np.uint64), none, none
    m, own = least[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    word_one = np.searchsorted(doc, np.arange(len(texts)))
    return own[first], at[first] - word_one[own[first]], m[first], start[at[first]], end[at[last] + WINDOW - 1]


def pack(docs: np.ndarray, marks: np.ndarray, words: np.ndarray, minimisers: np.ndarray, texts: list[bytes]) -> bytes:
    head = docs.astype("<i8").tobytes() + marks.astype("<i8").tobytes() + words.astype("<u4").tobytes() + minimisers.astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(texts)) + head + b"\n".join(texts))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    docs, marks = (np.frombuffer(raw, "<i8", n, 4 + 8 * n * k) for k in range(2))
    words, minimisers = (np.frombuffer(raw, "<u4", n, 4 + 16 * n + 4 * n * k) for k in range(2))
    return docs, marks, words, minimisers, raw[4 + 24 * n :].split(b"\n") if n else []


def shard_blobs(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): all segments of ``docs``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(held)
            blobs = [pack(*[np.concatenate(x) for x in list(zip(*held[k], strict=True))[:4]], [t for part in held[k] for t in part[4]]) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for b in slices(batches, "text"):
            ids = b.column(b.schema.get_field_index("doc_id")).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [normal(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            own, word, m, first, end = segments(texts)
            if len(own):
                joined = b"".join(texts)
                marks = b.column(b.schema.get_field_index("mark")).to_numpy()
                shard = (m % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                edges = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
                for a, z in zip(edges, edges[1:], strict=False):
                    i = order[a:z]
                    parts = [joined[x:y] for x, y in zip(first[i].tolist(), end[i].tolist(), strict=True)]
                    held.setdefault(int(shard[i[0]]), []).append((ids[own[i]], marks[own[i]], word[i], (m[i] // np.uint64(shards)) & np.uint64(0xFFFFFFFF), parts))
                size += len(joined)
            if size >= FLUSH:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return docs.select("doc_id", "text", mark()).mapInArrow(cut, "shard int, blob binary")


def locate(blobs: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(doc_id, mark, first word, words) covered in the segments of one shard."""
    texts: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
    for blob in blobs:
        for d, k, w, m, t in zip(*(x.tolist() if isinstance(x, np.ndarray) else x for x in unpack(blob)), strict=True):
            texts.setdefault(m, {}).setdefault(t, []).append((d, k, w))
    out: list[tuple[int, int, int, int]] = []
    numbers: dict[bytes, int] = {}
    first: dict[tuple, int] = {}
    recurring: set[tuple] = set()
    streams: list[tuple[tuple, list[tuple[int, int, int]]]] = []
    for group in texts.values():
        if len(group) == 1:
            # all windows of a minimiser are here, so those of its only text start in these places alone
            (t, places), = group.items()
            if len(places) > 1:
                low, size = min(places)[0], t.count(b" ") + 1
                out.extend((d, k, w, size) for d, k, w in sorted(set(places)) if d > low)
            continue
        for t, places in group.items():
            ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in t.split(b" "))
            low, high = min(places)[0], max(places)[0]
            for i in range(len(ids) - WINDOW + 1):
                w = ids[i : i + WINDOW]
                f = first.get(w)
                if f is None:
                    first[w] = low
                    if high != low:
                        recurring.add(w)
                elif high != f or low != f:
                    recurring.add(w)
                    if low < f:
                        first[w] = low
            streams.append((ids, sorted(set(places))))  # rows that repeat ask the same
    if not recurring:
        return out
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w in recurring:
        automaton.add_word(w, first[w])
    automaton.make_automaton()
    for ids, places in streams:
        hits = [(end - WINDOW + 1, f) for end, f in automaton.iter(ids)]
        if not hits:
            continue
        for d, k, w in places:
            a = z = -1
            for at, f in hits:
                if f < d:
                    if at > z:
                        if z > a:
                            out.append((d, k, w + a, z - a))
                        a = at
                    z = at + WINDOW
            if z > a:
                out.append((d, k, w + a, z - a))
    return out


def covered(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """(doc_id, mark, ranges): words to remove from the rows of that id and digest, as (first word, words)."""
    # a segment holds about 3.5 times the words that its own windows start at
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blobs = shard_blobs(docs, max(16, int(total * 3.5 / shard_bytes)))
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("word", pa.int64()), ("words", pa.int64())])

    def stream(table: pa.Table) -> pa.Table:
        rows = locate(table.column("blob").to_pylist())
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    spans_ = blobs.groupBy("shard").applyInArrow(stream, "doc_id bigint, mark bigint, word bigint, words bigint")
    # as many ranges as one text has
    return spans_.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("word", "words")).alias("ranges"))


def removals(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document; ``kept`` is the text that stays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges, _ = stored(covered(docs, shard_bytes), "ranges")

    r = ranges.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), "ranges")
    rows = docs.select("doc_id", "text", mark()).join(r, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("__doc")) & (F.col("mark") == F.col("__mark")), "left").select("doc_id", "text", "ranges")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n, gone, sha, left = [], [], [], []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                stay = np.ones(len(words), bool)
                for x in own or ():
                    stay[x["word"] : x["word"] + x["words"]] = False
                kept = b" ".join(words if stay.all() else [w for w, s in zip(words, stay.tolist(), strict=True) if s])
                n.append(len(words)), gone.append(int(len(words) - stay.sum())), sha.append(hashlib.sha256(kept).hexdigest()), left.append(kept.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(keep, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


@llm_query("op3_repeated_phrases")
def op3_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    """Words of every document, how many of them recur from earlier documents, and the digest of the rest."""
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
