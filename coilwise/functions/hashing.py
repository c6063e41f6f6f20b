"""Keyed hashes that replace random number streams.

``unit_hash`` maps (seed, id) to [0, 1) with md5, so a draw depends on the id alone: it is the same
on every executor, on retries, and in any SQL engine that has md5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALE = float(1 << 60)


def _text(seed, ids) -> Column:
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in ids]
    return F.concat_ws(":", *parts)


def unit_hash(seed, *ids) -> Column:
    """Uniform [0, 1) value from the first 60 bits of md5(seed:id[:id...])."""
    return F.conv(F.substring(F.md5(_text(seed, ids)), 1, 15), 16, 10).cast("bigint") / F.lit(_SCALE)


def order_key(seed, *ids) -> Column:
    """Hex digest used to put rows in a reproducible random order."""
    return F.md5(_text(seed, ids))


_SINES = [np.array(int(abs(math.sin(i + 1)) * 2**32), np.uint32) for i in range(64)]
_TURNS = [(np.array(t, np.uint32), np.array(32 - t, np.uint32)) for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
MD5_BLOCK = 16_384  # texts at once, whose words stay in a core's cache


def _md5_prefix(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """First 8 digest bytes, as a big-endian number, of n messages of one block; words that are 0 everywhere are left out."""
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, v) for v in start)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(a, f, out=a)
        np.add(a, _SINES[i], out=a)
        if g in words:
            np.add(a, words[g], out=a)
        np.left_shift(a, _TURNS[i][0], out=t)
        np.right_shift(a, _TURNS[i][1], out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return ((a + start[0]).byteswap().astype(np.uint64) << np.uint64(32)) | (b + start[1]).byteswap()


def md5_prefixes(heads: Sequence[bytes], tails: Sequence[bytes], head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The first 16 hex digits of ``md5(heads[head[i]] + tails[tail[i]])`` as numbers, for many short texts from few parts."""
    of_head, of_tail = np.array([len(v) for v in heads]), np.array([len(v) for v in tails])
    out = np.empty(len(head), np.uint64)
    for n in np.unique(of_head).tolist():
        at = np.flatnonzero(of_head[head] == n)
        if n + of_tail.max() > 55:  # more than one block
            out[at] = [int.from_bytes(hashlib.md5(heads[h] + tails[t]).digest()[:8], "big") for h, t in zip(head[at], tail[at], strict=True)]
            continue
        first = np.frombuffer(b"".join(v[:n].ljust(64, b"\0") for v in heads), "<u4").reshape(-1, 16)
        rest = b"".join((b"\0" * n + v + b"\x80").ljust(56, b"\0") + (8 * (n + len(v))).to_bytes(8, "little") for v in tails)
        rest = np.frombuffer(rest, "<u4").reshape(-1, 16)
        used = np.flatnonzero(first.any(0) | rest.any(0)).tolist()
        for i in range(0, len(at), MD5_BLOCK):
            part = at[i : i + MD5_BLOCK]
            h, t = head[part], tail[part]
            out[part] = _md5_prefix({g: first[h, g] | rest[t, g] for g in used}, len(part))
    return out


def in_holdout(seed, frac: float, *ids) -> Column:
    """Stable hold-out membership; nested in ``frac``."""
    if frac >= 1:
        return F.lit(True)
    if frac <= 0:
        return F.lit(False)
    return unit_hash(seed, *ids) < F.lit(float(frac))


@F.pandas_udf(T.DoubleType())
def blake2b_unit(keys: pd.Series) -> pd.Series:
    """8-byte blake2b of the text as a fraction of 2^64, for splits that must agree with existing ones."""
    return keys.map(
        lambda k: None if k is None else int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big") / 2.0**64
    )


def blake2b_holdout(seed: str, frac: float, stem) -> Column:
    if frac >= 1:
        return F.lit(True)
    if frac <= 0:
        return F.lit(False)
    stem = F.col(stem) if isinstance(stem, str) else stem
    return blake2b_unit(F.concat(F.lit(f"{seed}:"), stem.cast("string"))) < F.lit(float(frac))


def split_by_hash(seed, ids, cuts: dict[str, float]) -> Column:
    """Split label from the unit hash; ``cuts`` holds ascending upper bounds, the last one open."""
    u = unit_hash(seed, *ids)
    names = list(cuts)
    expr = None
    for name in names[:-1]:
        cond = u < F.lit(float(cuts[name]))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(names[-1])
