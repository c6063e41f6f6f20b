"""License scans: fuzzy search for short notices.

Text is reduced to lower-case words. A notice that may hold k errors is split into k + 1 pieces: by the
pigeonhole principle one piece occurs exactly in every match. Exact search for the pieces gives candidate
places; the regex library's bounded-error matching verifies the text around them and reports spans.

Base labels come from exact places of three phrases, word by word.

Defined cases: null or empty texts have no words, no labels and score 0; repeated rows are scanned each;
one place may carry several labels; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .registry import llm_query
from .shared import slices

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Common notices in words, the label that they give and the errors that they may hold.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("licensed under cc by sa", "cc-by-sa", 2),
    ("licensed under cc by nd", "cc-by-nd", 2),
    ("dedicated to the public domain", "public-domain", 3),
    ("all rights reserved", "reserved", 2),
)

#: Bytes of a word, lower-cased; all others are separators.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(phrase: bytes, errors: int) -> list[tuple[int, bytes]]:
    """(place, text) of errors + 1 pieces of nearly equal length."""
    n, k = len(phrase), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str, int], ...] = NOTICES):
        self.base = [(b" " + p.encode() + b" ", p.count(" ") + 1, label) for p, label in BASE.items()]
        self.seeds: dict[bytes, list[tuple[int, int]]] = {}
        self.notices = []
        for i, (phrase, label, errors) in enumerate(notices):
            raw = phrase.encode()
            match = regex.compile(rb"(?be)(?<= )(?:" + regex.escape(raw, literal_spaces=True) + rb"){e<=" + str(errors).encode() + rb"}(?= )")
            self.notices.append((raw, label, errors, match))
            for at, piece in pieces(raw, errors):
                self.seeds.setdefault(piece, []).append((i, at))

    def words(self, text: str | None) -> bytes:
        """The words of a text with one blank around each."""
        return b" " + b" ".join((text or "").encode().translate(FOLD).split()) + b" "

    def base_places(self, s: bytes) -> list[tuple[int, int, str]]:
        """(first word, number of words, label) of each exact place."""
        out = []
        for phrase, n, label in self.base:
            at = s.find(phrase)
            while at >= 0:
                out.append((s.count(b" ", 0, at + 1) - 1, n, label))
                at = s.find(phrase, at + 1)
        return out

    def fuzzy_places(self, s: bytes) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, errors, notice length) in the bytes of the words; one for each place and notice."""
        near: dict[int, list[tuple[int, int]]] = {}
        for seed, owners in self.seeds.items():
            at = s.find(seed)
            while at >= 0:
                for i, offset in owners:
                    raw, _, errors, _ = self.notices[i]
                    a = at - offset - errors
                    near.setdefault(i, []).append((max(a - 1, 0), a + len(raw) + 2 * errors + 1))
                at = s.find(seed, at + 1)
        out = []
        for i, places in near.items():
            raw, label, errors, match = self.notices[i]
            # each window by itself: over several, the best match would hide worse ones before it
            spans = {(*m.span(), sum(m.fuzzy_counts)) for a, b in set(places) for m in match.finditer(s, a, min(b, len(s)))}
            out += [(a, b, label, e, len(raw)) for a, b, e in spans]
        # a place belongs to the notice that fits it with the fewest errors
        return _fittest(out) if len(out) > 1 else out


def _fittest(places: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """Fewest errors first, each place is compared with those kept that can overlap it; a notice keeps one of its own."""
    widest, kept = max(b - a for a, b, *_ in places), []
    for x in sorted(places, key=lambda p: (p[3], p)):
        near = kept[bisect_left(kept, (x[0] - widest,)) : bisect_left(kept, (x[1],))]
        if not any(x[0] < y[1] and (y[3] < x[3] or (y[2], y[4]) == (x[2], x[4])) for y in near):
            insort(kept, x)
    return kept


def scan_notices(docs: DataFrame, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> DataFrame:
    """Words, base places, labels and fuzzy spans of every document, where it lies: no shuffle.

    ``spans`` has (label, first_word, words, errors) of each fuzzy match.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(notices)
        schema = pa.schema([
            ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("errors", pa.int64())]))),
        ])
        for b in slices(batches, "text"):
            rows = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                words = s.words(text)
                base, fuzzy = s.base_places(words), s.fuzzy_places(words)
                starts = [x[0] for x in base]
                own, found = {x[2] for x in base}, [1 - e / n for _, _, _, e, n in fuzzy]
                rows.append({
                    "n_words": max(words.count(b" ") - 1, 0) if len(words) > 2 else 0, "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {x[2] for x in fuzzy})), "score": 1.0 if base else max(found, default=0.0),
                    "spans": [{"label": f[2], "first_word": words.count(b" ", 0, f[0]) - 1, "words": words.count(b" ", f[0], f[1]) + 1, "errors": f[3]} for f in fuzzy],
                })
            out = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *out.columns], ["doc_id", *schema.names])

    spans = "array<struct<label:string,first_word:bigint,words:bigint,errors:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {spans}")


@llm_query("op4_license_scan")
def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence labels of every document, exact places and fuzzy ones."""
    return scan_notices(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
