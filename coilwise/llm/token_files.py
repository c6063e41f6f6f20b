"""Token ids as canonical, length-limited Huffman code in independent blocks.

1. ``tokenised``: every text becomes ids, where it lies; ids are dealt to contiguous ranges of doc_id
   (bounds from a quantile sketch of doc_id alone), sorted there and stored once.
2. ``code_lengths``: counts of all ids, summed per task and then per id; the package-merge method gives
   optimal lengths of at most LIMIT bits. The codebook has one entry per id of the vocabulary.
3. ``write_token_files``: a block holds whole documents, about BLOCK ids. Its payload is one bit stream;
   the bit offset of every STEP-th id is kept, so the block decodes from any checkpoint.
4. ``read_token_files``: the table of LIMIT-bit prefixes decodes all checkpoints of a block side by side.

File format: Parquet, so any store that Spark writes to will do. ``blocks`` has (range, first, docs,
lengths, offsets, bits): range number, the first document's place in it, doc_ids, ids per document, uint64
bit offsets, the stream as big-endian 32-bit words. ``codebook`` has (id, length, n). ``ranges`` has
(range, start): ids of all ranges before.

Defined cases: a null text is encoded as an empty one, so it holds the end id alone; a null doc_id comes
first; rows that share a doc_id are written each, ordered by their text's ids; an empty table writes no
block; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import drop, keeps, new_folder, slices, stored

END_ID = 1
LIMIT = 18
BLOCK = 1 << 18
STEP = 256
REMEMBER = 1_100_000  # pieces that a worker learns before it lets go of those not seen since it last did
SLICE = 4 << 20

_known: dict[str, dict[str, bytes]] = {}
_older: dict[str, dict[str, bytes]] = {}
_tools: dict[str, object] = {}
_ends: dict[str, np.ndarray] = {}
_apart: dict[str, bool] = {}
PROBE = "the cat's 12 cats, sat. don't x-ray naïve straße 中文 (ok) a.b,c #1 w"


class Tokeniser:
    """Ids of texts by a public tokenizer file; ids of words are remembered, of the words seen last.

    A tokenizer that drops white space treats the pieces between blanks and line ends independently, so a text's ids are
    its pieces' ids in turn. ASCII marks after letters are a piece of their own. Where the file's
    tokenizer works otherwise, which a probe finds out, texts are encoded whole.
    """

    def __init__(self, file: str):
        self.file = file
        self.known = _known.setdefault(file, {"": b""})
        if file not in _tools:
            from tokenizers import Tokenizer

            tool = _tools[file] = Tokenizer.from_file(file)
            vocabulary = tool.get_vocab()
            _ends[file] = np.zeros(max(vocabulary.values()) + 1, bool)
            _ends[file][[i for p, i in vocabulary.items() if p.endswith("</w>")]] = True

    def forget(self) -> None:
        self.known = {"": b""}
        _known.pop(self.file, None)
        _older.pop(self.file, None)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in _tools[self.file].encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self) -> bool:
        """Whether the file's tokenizer treats pieces between blanks by themselves and ends every word with a mark of its own."""
        texts = [PROBE, PROBE.upper(), PROBE.title(), PROBE.replace(" ", "\n"), PROBE.replace(" ", "  ")]
        pieces = [p for p in PROBE.split(" ") if p]
        apart = [b"".join(self._whole(pieces)), b"".join(self._whole([p.upper() for p in pieces]))]
        whole = self._whole(texts)
        words = self._whole([p for p in pieces if p.isalpha()])
        once = all(_ends[self.file][np.frombuffer(w, "<u4")].sum() == 1 and _ends[self.file][np.frombuffer(w, "<u4")[-1]] for w in words)
        return once and whole == [apart[0], apart[1], apart[0], apart[0], apart[0]]

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces, with their words encoded together: each word ends with an id that ends words."""
        known, cut, words, rest = self.known, {}, set(), []
        for p in pieces:
            stem = p.rstrip(punctuation)
            # letters whose lower case ends in a mark are not cut: the tokenizer joins that mark with what follows
            if not (stem.isalpha() and (stem.isascii() or stem.lower().isalpha())):
                rest.append(p)
            else:
                if len(stem) < len(p):
                    cut[p] = stem
                if stem not in known:
                    words.add(stem)
        rest.extend({p[len(stem) :] for p, stem in cut.items()}.difference(known, rest))
        words = list(words)
        ids = self._whole([" ".join(words)])[0]
        last = np.flatnonzero(_ends[self.file][np.frombuffer(ids, "<u4")]) + 1
        if len(last) == len(words):
            ends = (4 * last).tolist()
            known.update(zip(words, map(ids.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        else:
            rest += words
        known.update(zip(rest, self._whole(rest), strict=True))
        for p, stem in cut.items():
            known[p] = known[stem] + known[p[len(stem) :]]

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.file not in _apart:
            _apart[self.file] = self._cuts()
        if not _apart[self.file]:
            return self._whole(texts)
        if not texts:
            return []
        # the tokenizer lower-cases letter by letter; the two letters whose case hangs on context or length stay
        low = [(t if "Σ" in t or "İ" in t else t.lower()).replace("\n", " ") for t in texts]
        cut = pc.split_pattern(pa.array(low, pa.large_string()), " ")
        pieces = cut.values.dictionary_encode()  # each distinct piece is looked up once
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBER:
            _older[self.file], self.known = self.known, {"": b""}
            _known[self.file] = self.known
        found = list(map(self.known.get, distinct))
        unknown = [i for i, x in enumerate(found) if x is None]
        if unknown:
            older = _older.get(self.file, {})
            new = {distinct[i] for i in unknown}
            again = {p: older[p] for p in new if p in older}
            self.known.update(again)
            new.difference_update(again)  # never of all that is known, which would be walked through
            if new:
                self._learn(new)
            for i in unknown:
                found[i] = self.known[distinct[i]]
        ids = pa.array(found, pa.large_binary()).take(pieces.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[cut.offsets.to_numpy()].tolist()
        data = memoryview(b"" if ids.buffers()[2] is None else ids.buffers()[2])
        return [bytes(data[a:z]) for a, z in zip(at, at[1:], strict=False)]


def tokenised(docs: DataFrame, file: str, ranges: int) -> tuple[DataFrame, str]:
    """Stored (range, doc_id, ids): uint32 bytes with the end id, each range in one sorted file."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20_000)).first()[0] if ranges > 1 else None
    bounds = np.array(got or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Tokeniser(file)
        keeps("token ids", tool.forget)
        for b in slices(batches, "text", SLICE, keep="token ids"):
            keys = b.column(b.schema.get_field_index("doc_id"))
            at = np.searchsorted(bounds, keys.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "left")
            ids = tool.ids([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            packed = pa.array([_pack(np.frombuffer(x, "<u4")) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), keys, packed], ["range", "doc_id", "ids"])

    rows = docs.select("doc_id", "text").mapInArrow(encode, f"range int, doc_id {kind}, ids binary")
    # a range may share its partition with others; the sort keeps each of them together
    ordered = rows.repartition(ranges, "range").sortWithinPartitions("range", "doc_id", "ids")
    return stored(ordered.mapInArrow(_numbered, f"range int, place bigint, doc_id {kind}, ids binary"), "ids")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each row's place in its range; a range's rows come in turn."""
    part, place = None, 0
    for b in batches:
        ranges = b.column(b.schema.get_field_index("range")).to_numpy()
        places = np.empty(len(ranges), np.int64)
        for i, r in enumerate(ranges):
            place = place + 1 if r == part else 0
            part, places[i] = r, place
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places), b.column(1), b.column(2)], ["range", "place", "doc_id", "ids"])


def _pack(ids: np.ndarray) -> bytes:
    """Ids with the end id: one flag byte, then 16 bits each if they fit, else 32."""
    ids = np.append(ids, np.uint32(END_ID))
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype(np.uint32)


def id_counts(ids: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in slices(batches, "ids"):
            rows = b.column(b.schema.get_field_index("ids")).to_pylist()
            for flag, kind in ((2, "<u2"), (4, "<u4")):
                n = np.bincount(np.frombuffer(b"".join([x[1:] for x in rows if x[0] == flag]), kind))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    return ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge over the sorted counts."""
    m = len(counts)
    if m <= 1:
        return np.ones(m, np.int64)
    if m > 2**limit:
        raise ValueError("more ids than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.int64)
    levels, merged = [], leaf
    for _ in range(limit):
        levels.append(merged)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.sort(np.concatenate([leaf, pairs]), kind="stable")
    # walk down: of each list the first 2t packages are used; a leaf among them is one bit longer
    length, used = np.zeros(m, np.int64), 2 * (m - 1)
    for level in range(limit - 1, -1, -1):
        if level:
            below = levels[level - 1]
            pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
            kind = np.concatenate([np.zeros(m, np.int8), np.ones(len(pairs), np.int8)])
            kind = kind[np.argsort(np.concatenate([leaf, pairs]), kind="stable")][:used]
        else:
            kind = np.zeros(used, np.int8)
        leaves = int((kind == 0).sum())
        length[:leaves] += 1
        used = 2 * int((kind == 1).sum())
    out = np.empty(m, np.int64)
    out[order] = length
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Code of each id: shorter codes first, equal lengths in the order of ids."""
    order = np.lexsort([ids, lengths])
    sorted_lengths = lengths[order]
    codes = np.zeros(len(ids), np.uint64)
    top = int(sorted_lengths[-1]) if len(ids) else 0
    steps = np.uint64(1) << (top - sorted_lengths).astype(np.uint64)
    left = np.concatenate([[np.uint64(0)], np.cumsum(steps)[:-1]]) if len(ids) else steps
    codes[order] = left >> (top - sorted_lengths).astype(np.uint64)
    return codes


def encode_block(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit offset of every STEP-th id, stream of big-endian 32-bit words)."""
    n = length[ids].astype(np.int64)
    at = np.cumsum(n) - n
    shifted = code[ids] << (64 - n - (at & 31)).astype(np.uint64)
    word, words = at >> 5, int((at[-1] + n[-1] + 31) >> 5) + 2
    # each bit of the stream is set by one id, so the sums below carry nothing
    stream = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(float), minlength=words)
    stream += np.bincount(word + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(float), minlength=words)
    return at[::STEP].astype(np.uint64), stream.astype(">u4")


def decode_table(ids: np.ndarray, lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and length behind every ``limit``-bit prefix."""
    symbol, length = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
    order = np.lexsort([ids, lengths])
    reach = np.left_shift(1, limit - lengths[order])
    if len(ids):
        many = int(reach.sum())
        symbol[:many], length[:many] = np.repeat(ids[order], reach), np.repeat(lengths[order], reach)
    return symbol, length


def decode_block(offsets: np.ndarray, bits: bytes, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """All ids of a block: every checkpoint is a lane, and each round reads one id in every lane."""
    symbol, length = table
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    both = (words[:-1] << np.uint64(32)) | words[1:]
    at, out = offsets.astype(np.int64), np.zeros((STEP, len(offsets)), np.uint32)
    rest = n - STEP * (len(offsets) - 1)  # the last lane may be short
    for k in range(STEP):
        if k == rest:
            at = at[:-1]
        if not len(at):
            break
        prefix = (both[at >> 5] << (at & 31).astype(np.uint64)) >> np.uint64(64 - limit)
        out[k, : len(at)] = symbol[prefix]
        at = at + length[prefix]
    return out.T.reshape(-1)[:n]


BLOCKS = "range int, first bigint, docs array<bigint>, lengths array<bigint>, offsets binary, bits binary"


def write_token_files(docs: DataFrame, folder: str, file: str, ranges: int | None = None) -> None:
    """Write all ids of ``docs`` (doc_id, text) in ascending order of doc_id to ``folder``."""
    spark = docs.sparkSession
    ids, path = tokenised(docs, file, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    # one row per id of the vocabulary: bounded by the tokenizer
    counts = sorted((r.id, r.n) for r in id_counts(ids).collect())
    symbols, n = np.array([c[0] for c in counts], np.int64), np.array([c[1] for c in counts], np.int64)
    lengths = code_lengths(n)
    spark.createDataFrame([(int(i), int(k), int(c)) for i, k, c in zip(symbols, lengths, n, strict=True)], "id bigint, length int, n bigint").coalesce(1).write.parquet(f"{folder}/codebook")
    most = int(symbols.max()) + 1 if len(symbols) else 1
    code, length = np.zeros(most, np.uint64), np.zeros(most, np.int64)
    code[symbols], length[symbols] = canonical(symbols, lengths), lengths
    shared = spark.sparkContext.broadcast((code, length))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = shared.value
        held, keys, size, part, first = [], [], 0, None, 0  # a block starts anew wherever rows don't follow on

        def block() -> pa.RecordBatch:
            flat = np.concatenate(held)
            offsets, bits = encode_block(flat, code, length)
            row = {"range": [part], "first": [first], "docs": [keys], "lengths": [[len(x) for x in held]], "offsets": [offsets.tobytes()], "bits": [bits.tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("range", pa.int32()), ("first", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.binary()), ("bits", pa.binary())]))

        for b in slices(batches, "ids"):
            for r, at, k, packed in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("range", "place", "doc_id", "ids")), strict=True):
                if held and (r != part or at != first + len(held) or size >= BLOCK):
                    yield block()
                    held, keys, size = [], [], 0
                if not held:
                    part, first = r, at
                held.append(_unpack(packed))
                keys.append(k)
                size += len(held[-1])
        if held:
            yield block()

    ids.mapInArrow(blocks, BLOCKS).write.parquet(f"{folder}/blocks")
    written = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    totals = written.groupBy("range").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("start")).coalesce(1).write.parquet(f"{folder}/ranges")
    drop(spark, path)
    shared.unpersist()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    book = sorted((r.id, r.length) for r in spark.read.parquet(f"{folder}/codebook").collect())
    table = decode_table(np.array([b[0] for b in book], np.int64), np.array([b[1] for b in book], np.int64))
    shared = spark.sparkContext.broadcast(table)
    blocks, ranges = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), spark.read.schema("range int, start bigint").parquet(f"{folder}/ranges")
    size = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    before = Window.partitionBy("range").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("range", "first", size.alias("n")).select("range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    starts = places.join(ranges, "range").select("range", "first", (F.col("ahead") + F.col("start")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in slices(batches, "bits"):
            for row in b.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ids = decode_block(np.frombuffer(row["offsets"], np.uint64), row["bits"], int(lengths.sum()), table).astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["range"]] * len(lengths), pa.int32()), pa.array([row["first"]] * len(lengths), pa.int64()), pa.array(row["docs"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["range", "first", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = blocks.mapInArrow(decode, "range int, first bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["range", "first"]).select("doc_id", (F.col("start") + F.col("inside")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_digest(docs: DataFrame, file: str | None = None) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_token_files(docs, folder, file or default_tokenizer())
    return read_token_files(docs.sparkSession, folder)


@llm_query("op6_token_files")
def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, as read back from the files."""
    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
