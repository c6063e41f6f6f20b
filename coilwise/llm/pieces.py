"""SentencePiece ids by a table of distinct chunks.

No merge crosses the place between two letters that stand side by side in no piece: before a marker, around a
line end, around marks and digits, and at rare pairs inside a word. A text is the sequence of its chunks, cut at
all such places.

1. ``cut``: texts of about SLICE bytes make a slice: its distinct chunks, the most frequent first, and each
   place's number among them. Slices are stored in buckets, so the places never move.
2. The table: every distinct chunk of the corpus is encoded once by the library. The FREQUENT chunks that most
   slices hold are encoded first and broadcast (their number and length are bounded). The others of all slices
   meet in sorted partitions (``segmented``), and their ids go back to the slices that hold them.
3. ``encoded``: ids are put in their places; begin and end ids go around every document.

A chunk moves once per slice that holds it, however often it occurs there, so a frequent word is not a hot
key. For a model whose normaliser changes texts (``Cutter.exact``) whole texts are the chunks.

Defined cases: a null text is encoded as an empty one, with begin and end ids alone; a null or repeated
doc_id makes a row each; equal texts share their chunks; a text without a place to cut is one chunk; an empty
table gives an empty result; columns other than doc_id and text are not read. A slice is held in memory whole,
with a text of any length as its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import drop, in_buckets, slices, stored

MARK = "▁"
SLICE = 16 << 20
FREQUENT, LONGEST = 250_000, 64
_ZSTD = pa.Codec("zstd")
_models: dict[str, object] = {}
_cutters: dict[str, "Cutter"] = {}


def model_of(file: str):
    """The library's processor, one per worker."""
    if file not in _models:
        from sentencepiece import SentencePieceProcessor

        _models[file] = SentencePieceProcessor(model_file=file)
    return _models[file]


class Cutter:
    """Where texts may be cut, from the pieces of the model."""

    def __init__(self, file: str):
        tool = self.tool = model_of(file)
        pieces = [tool.id_to_piece(i) for i in range(tool.vocab_size()) if not (tool.is_byte(i) or tool.is_control(i) or tool.is_unknown(i))]
        pairs = {p for piece in pieces for p in zip(piece, piece[1:], strict=False)}
        letters = sorted({c for p in pairs for c in p})
        self.number = np.zeros(0x110000, np.int64)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1,) * 2, bool)
        for a, b in pairs:
            self.together[self.number[ord(a)], self.number[ord(b)]] = True
        probe = " a  B\té́\n ﬁ "
        #: Whether the model keeps texts as they are, puts one marker in front, and has no piece with a line end.
        self.exact = tool.normalize(probe) == MARK + probe.replace(" ", MARK) and tool.piece_to_id(MARK) != tool.unk_id() and not any("\n" in p for p in pieces)

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text, in turn."""
        if not text:
            return []
        if not self.exact:
            return [text]
        text = MARK + text.replace(" ", MARK)
        number = self.number[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        edges = (np.flatnonzero(~self.together[number[:-1], number[1:]]) + 1).tolist()
        return [text[a:z] for a, z in zip([0, *edges], [*edges, len(text)], strict=True)]

    def ids(self, chunk: str) -> bytes:
        """Ids of a chunk that stands inside a text, as uint32; the library puts a marker in front of what it encodes."""
        tool = self.tool
        if not self.exact:
            ids = tool.encode(chunk)
        elif chunk == MARK:
            ids = [tool.piece_to_id(MARK)]
        else:
            ids = tool.encode(chunk[1:]) if chunk[0] == MARK else tool.encode("\n" + chunk)[2:]
        return np.array(ids, "<u4").tobytes()


def cutter_of(file: str) -> Cutter:
    if file not in _cutters:
        _cutters[file] = Cutter(file)
    return _cutters[file]


def packed(refs: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    return _ZSTD.compress(refs.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, 4 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


class Slice:
    """Texts gathered until they are written as one row."""

    def __init__(self) -> None:
        self.keys: list[pa.Array] = []
        self.counts: list[int] = []
        self.refs: list[np.ndarray] = []
        self.chunks: dict[str, int] = {}
        self.size = 0

    def add(self, keys: pa.Array, texts: list[str | None], cutter: Cutter) -> None:
        self.keys.append(keys)
        number = self.chunks
        for text in texts:
            found = cutter.chunks(text or "")
            self.counts.append(len(found))
            self.refs.append(np.fromiter((number.setdefault(c, len(number)) for c in found), "<u4", len(found)))
            self.size += len(text or "")

    def row(self, number: int) -> pa.RecordBatch:
        refs = np.concatenate(self.refs)
        order = np.argsort(-np.bincount(refs, minlength=len(self.chunks)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, chunks = pa.concat_arrays(self.keys), pa.array(list(self.chunks), pa.string()).take(pa.array(order))
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([self.counts], pa.list_(pa.int64())),
            pa.array([packed(rank[refs])], pa.binary()), pa.ListArray.from_arrays([0, len(chunks)], chunks),
        ], ["slice", "docs", "counts", "refs", "chunks"])


def cut(docs: DataFrame, file: str) -> DataFrame:
    """(slice, docs, counts, refs, chunks): a row per slice of texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, number, held = cutter_of(file), TaskContext.get().partitionId() << 33, Slice()
        for b in slices(batches, "text"):
            held.add(b.column(0), b.column(1).to_pylist(), cutter)
            if held.size >= SLICE:
                yield held.row(number)
                number, held = number + 1, Slice()
        if held.keys:
            yield held.row(number)

    return docs.select("doc_id", "text").mapInArrow(run, f"slice bigint, docs array<{kind}>, counts array<bigint>, refs binary, chunks array<string>")


def segmented(used: DataFrame, file: str) -> DataFrame:
    """(slice, at, ids) of (slice, at, chunk); rows of a chunk follow each other, and it is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last, ids = cutter_of(file), None, b""
        for b in slices(batches, "chunk"):
            out = []
            for chunk in b.column(2).to_pylist():
                if chunk != last:
                    last, ids = chunk, cutter.ids(chunk)
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["slice", "at", "ids"])

    return used.select("slice", "at", "chunk").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "slice bigint, at int, ids binary")


def frequent_ids(parts: DataFrame, file: str) -> dict[str, bytes]:
    """Ids of the chunks that most slices hold, more than one each; which chunks these are changes only the cost."""
    held = parts.select(F.explode("chunks").alias("chunk")).where(F.length("chunk") <= LONGEST).groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts, path = stored(held, "chunks")
    most = counts.orderBy(F.desc("n"), "chunk").limit(FREQUENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = cutter_of(file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([cutter.ids(c) for c in b.column(0).to_pylist()], pa.binary())], ["chunk", "ids"])

    table = most.select("chunk").repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "chunk string, ids binary").toArrow()
    drop(parts.sparkSession, path)
    return dict(zip(table.column("chunk").to_pylist(), table.column("ids").to_pylist(), strict=True))


def in_place(counts: np.ndarray, refs: np.ndarray, flat: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of each document of a slice; ``flat`` holds the chunks' ids end to end, ``size`` their numbers."""
    first = np.cumsum(size) - size
    edges = np.concatenate([[0], np.cumsum(counts)])
    for a, z in zip(edges, edges[1:], strict=False):
        r = refs[a:z]
        n = size[r]
        ends = np.cumsum(n)
        yield flat[np.repeat(first[r] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def encoded(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids, text) of every document: uint32 bytes with begin and end ids, and the decoded text."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = in_buckets(cut(docs, file), "slice", "slices")
    shared = spark.sparkContext.broadcast(frequent_ids(parts, file))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for number, chunks in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                chunks = chunks.values
                at = np.array([i for i, c in enumerate(chunks.to_pylist()) if c not in known], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(at), chunks.take(pa.array(at))], ["slice", "at", "chunk"])

    ids = segmented(parts.select("slice", "chunks").mapInArrow(rare, "slice bigint, at int, chunk string"), file)
    # as many entries as the slice has chunks, which its size bounds
    tables = ids.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("at", "ids")))["ids"].alias("table"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = model_of(file), shared.value
        begin, end = [np.array([i], "<u4") for i in (tool.bos_id(), tool.eos_id())]
        for b in batches:
            for i in range(b.num_rows):
                keys, counts = b.column(0)[i].values, b.column(1)[i].values.to_numpy()
                others = iter(b.column(4)[i].as_py() or ())
                table = [known[c] if c in known else next(others) for c in b.column(3)[i].values.to_pylist()]
                flat, size = np.frombuffer(b"".join(table), "<u4"), np.array([len(x) // 4 for x in table], np.int64)
                rows: list[tuple[bytes, str]] = []
                held = done = 0
                for x in in_place(counts, unpacked(b.column(2)[i].as_py(), int(counts.sum())), flat, size):
                    x = np.concatenate([begin, x, end])
                    rows.append((x.tobytes(), tool.decode(x.tolist())))
                    held += 8 * len(x)
                    if held > 4 << 20 or done + len(rows) == len(keys):
                        yield pa.RecordBatch.from_arrays([keys.slice(done, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True))], ["doc_id", "ids", "text"])
                        done, held, rows = done + len(rows), 0, []

    rows = parts.select("slice", "docs", "counts", "refs", "chunks").join(tables, "slice", "left").select("docs", "counts", "refs", "chunks", "table")
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_digest(docs: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    both = encoded(docs, file or default_model())
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@llm_query("op12_sentence_pieces")
def op12_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to."""
    return piece_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
