"""Sums per key over all buckets of a table, given back to the buckets that hold the key.

Buckets are bounded groups of rows, worked on one at a time by Python. A bucket names each
of its keys once, with what it adds to the key's sum, so a key found everywhere travels
once per bucket and not once per row. Keys are unsigned 64-bit hashes; they are cut into
ranges of about equal size, and travel sorted, as differences in few bytes.
"""

from __future__ import annotations



import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 4 << 20

PIECES = "bucket bigint, part int, keys binary, sums binary"
RETURNS = "bucket bigint, keys binary, sums binary"
ALIGNED = "bucket bigint, part int, sums binary"

_CODES = ("<u1", "<u2", "<u4", "<u8", "<f4")


def bucket_count(df: DataFrame, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """How many buckets of about ``bucket_bytes`` of text a table fills."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return 1 + total // bucket_bytes


def range_count(buckets: int) -> int:
    """Ranges of keys for so many buckets; a range then holds the keys of about two."""
    return buckets // 2 + 1


def bucketed(df: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """``bucket, key, id, text``: rows dealt by their key, a hash of id and text, so that
    null ids spread too."""
    key = F.xxhash64(id_col, text_col)
    return df.select(
        F.pmod(key, F.lit(buckets)).cast("bigint").alias("bucket"), key.alias("key"),
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"),
    )


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys, equal ones too: width, shift, first key, then the
    differences without their ``shift`` lowest bits, which are all 0, in ``width`` bytes, the
    lowest bytes of all first."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    used = int(np.bitwise_or.reduce(steps)) if len(steps) else 0
    shift = (used & -used).bit_length() - 1 if used else 0
    width = max(1, (used.bit_length() - shift + 7) // 8) if len(steps) else 0
    planes = (steps >> np.uint64(shift)).astype("<u8").view("u1").reshape(-1, 8)[:, :width].T
    return bytes([width, shift]) + keys[:1].astype("<u8").tobytes() + planes.tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.uint64)
    width, shift = packed[0], packed[1]
    first = np.frombuffer(packed, "<u8", 1, 2)
    if not width:
        return first.astype(np.uint64)
    planes = np.frombuffer(packed, "u1", offset=10).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), "u1")
    steps[:, :width] = planes.T
    steps = steps.view("<u8").ravel() << np.uint64(shift)
    return np.cumsum(np.concatenate([first, steps]), dtype=np.uint64)


def key_bits(buckets: int, keys_per_bucket: int = BUCKET_BYTES // 4) -> int:
    """Bits of a hash that tell so many keys apart but for one in 16,384."""
    return min(64, (buckets * keys_per_bucket).bit_length() + 14)


def cut_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys with all but their upper ``bits`` bits cleared."""
    return keys & np.uint64(~((1 << (64 - bits)) - 1) & (2**64 - 1))


def pack_sums(sums: np.ndarray) -> bytes:
    """Numbers in the narrowest type, their lowest bytes first, deflated: whole numbers of 0
    or more, else floats without the 8 lowest bits of their 24-bit fraction."""
    if sums.dtype.kind == "f":
        code = 4
        values = (sums.astype("<f4").view("<u4") & np.uint32(0xFFFFFF00)).view("<f4")
    else:
        top = int(sums.max()) if len(sums) else 0
        code = next(i for i, bits in enumerate((8, 16, 32, 64)) if top < 1 << bits)
        values = sums.astype(_CODES[code])
    planes = values.view("u1").reshape(len(values), -1).T if len(values) else values
    return bytes([code]) + zlib.compress(planes.tobytes(), 1)


def unpack_sums(packed: bytes) -> np.ndarray:
    kind = np.dtype(_CODES[packed[0]])
    planes = np.frombuffer(zlib.decompress(packed[1:]), "u1").reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype("f8" if kind.kind == "f" else "i8")


def ranges(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range of each sorted key, and where the keys of each range begin and end."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else np.empty(0, int)
    return part, edges, np.append(edges[1:], len(keys))


def pieces(bucket: int, keys: np.ndarray, sums: np.ndarray, parts: int, first_part: int = 0) -> pd.DataFrame:
    """A bucket's sorted distinct keys as rows of ``PIECES``, one per range that has keys.

    Ranges are numbered from ``first_part``, so kinds of keys can have ranges of their own.
    """
    part, edges, ends = ranges(keys, parts)
    return pd.DataFrame(
        {
            "bucket": np.full(len(edges), bucket, "i8"),
            "part": part[edges].astype("i4") + np.int32(first_part),
            "keys": [pack_keys(keys[a:b]) for a, b in zip(edges, ends)],
            "sums": [pack_sums(sums[a:b]) for a, b in zip(edges, ends)],
        }
    )


def no_pieces() -> pd.DataFrame:
    return pd.DataFrame({"bucket": np.empty(0, "i8"), "part": np.empty(0, "i4"), "keys": [], "sums": []})


def _summed(frame: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of each piece of a range, and the total of each of them in one row."""
    held = [unpack_keys(k) for k in frame["keys"]]
    keys = np.concatenate(held)
    sums = np.concatenate([unpack_sums(s) for s in frame["sums"]])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    summed = np.add.reduceat(sums[order], np.flatnonzero(first))
    per_key = np.empty(len(keys), summed.dtype)
    per_key[order] = summed[np.cumsum(first) - 1]
    return held, per_key


def totals(sent: DataFrame, at_least: float) -> DataFrame:
    """``RETURNS``: per bucket and range its keys with a sum of ``at_least`` over all buckets.

    A task holds one range; a hot key is in it once per bucket.
    """

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        held, per_key = _summed(frame)
        out, at = [], 0
        for bucket, own in zip(frame["bucket"], held):
            got = per_key[at : at + len(own)]
            at += len(own)
            own, got = own[got >= at_least], got[got >= at_least]
            if len(own):
                out.append((bucket, pack_keys(own), pack_sums(got)))
        return pd.DataFrame(out, columns=["bucket", "keys", "sums"]).astype({"bucket": "i8"})

    return sent.groupBy("part").applyInPandas(merge, RETURNS)


def aligned_totals(sent: DataFrame, signs: bool = False) -> DataFrame:
    """``ALIGNED``: every piece's totals over all buckets, in the order of its keys.

    The bucket knows its keys, so they do not travel back. With ``signs``, only whether a
    total is 0 or more.
    """

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        held, per_key = _summed(frame)
        if signs:
            per_key = (per_key >= 0).astype("i8")
        ends = np.cumsum([len(own) for own in held])
        return pd.DataFrame(
            {
                "bucket": frame["bucket"],
                "part": frame["part"],
                "sums": [pack_sums(per_key[b - len(own) : b]) for own, b in zip(held, ends)],
            }
        )

    return sent.groupBy("part").applyInPandas(merge, ALIGNED)


def distinct_and_total(sent: DataFrame, parts: int) -> DataFrame:
    """One row: ``distinct`` keys with a sum above 0 and the ``total`` of all sums, over the
    ranges below ``parts``. Sums are whole numbers."""

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["part"].iloc[0] >= parts:
            return pd.DataFrame({"distinct": np.empty(0, "i8"), "total": np.empty(0, "i8")})
        keys = np.concatenate([unpack_keys(k) for k in frame["keys"]])
        sums = np.concatenate([unpack_sums(s) for s in frame["sums"]])
        return pd.DataFrame({"distinct": [len(np.unique(keys[sums > 0]))], "total": [int(sums.sum())]})

    each = sent.groupBy("part").applyInPandas(measure, "distinct bigint, total bigint")
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "total")])


def lookup_table(returned: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's returned keys in order, and their sums."""
    if not len(returned):
        return np.empty(0, np.uint64), np.empty(0, "i8")
    keys = np.concatenate([unpack_keys(k) for k in returned["keys"]])
    sums = np.concatenate([unpack_sums(s) for s in returned["sums"]])
    order = np.argsort(keys, kind="stable")
    return keys[order], sums[order]


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float = 0) -> np.ndarray:
    """The sum of each key, or ``default`` for keys that are not in the table."""
    known, sums = table
    if not len(known):
        return np.full(len(keys), default, "f8" if sums.dtype.kind == "f" else "i8")
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, sums[at], default)
