"""Packing of tokenised documents into sequences by minimum bin slack.

Whole windows are cut off long documents as they are read. What is left of each document
is shorter than a window; a window is then filled from the lengths still waiting: a bitset
of reachable sums, one bit per token, grown by one length at a time in powers of two of
its count, names the fullest reachable window, and stepping back through the stored
bitsets tells how many pieces of each length it takes. When nothing fills a window to the
last token, the piece that comes next is cut there. The end of a partition becomes
sequences whose lengths are powers of two, which need no padding.

Packing happens inside the partitions of the input, in bounded blocks: no row is moved.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.llm.shipping import ship_package
from gauge_engine.llm.tokens import encoder

WINDOW = 4096
# Waiting tokens after which a block of remainders is packed: 64 windows.
BLOCK_TOKENS = 64 * WINDOW

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def fullest(counts: dict[int, int], capacity: int, first: int) -> dict[int, int]:
    """Pieces of each length that fill ``capacity`` best, ``first`` being one of them.

    ``counts`` holds the waiting pieces by length. Larger lengths are offered first, so
    equal sums are reached with fewer pieces; the search ends at an exact fill.
    """
    room = capacity - first
    keep = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        size = 1
        while left > 0 and not reached >> room & 1:
            size = min(size, left)
            steps.append((reached, length, size))
            reached |= (reached << (length * size)) & keep
            left -= size
            size *= 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    taken[first] += 1
    for before, length, size in reversed(steps):
        if not before >> total & 1:
            taken[length] += size
            total -= length * size
    return dict(taken)


class _Packer:
    """Pieces of one partition on their way into sequences."""

    def __init__(self, base: int, window: int):
        self.base = base
        self.window = window
        self.sequences = 0
        self.rows: list[tuple] = []
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.tokens = 0

    def _emit(self, piece: tuple, offset: int) -> int:
        doc_id, start, ids, doc_tokens = piece
        length = len(ids) // 4
        self.rows.append(
            (doc_id, start, length, zlib.crc32(ids), doc_tokens, self.base + self.sequences, offset)
        )
        return offset + length

    def _close(self) -> None:
        self.sequences += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        whole = len(ids) - len(ids) % step
        for at in range(0, whole, step):
            self._emit((doc_id, at // 4, ids[at : at + step], total), 0)
            self._close()
        if whole < len(ids):
            self._wait((doc_id, whole // 4, ids[whole:], total))

    def _wait(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        self.waiting[length].append(piece)
        self.tokens += length

    def _take(self, length: int) -> tuple:
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length]
        self.tokens -= length
        return piece

    def pack(self, floor: int) -> None:
        """Fill windows until fewer than ``floor`` tokens wait."""
        while self.tokens >= max(floor, self.window):
            counts = {length: len(pieces) for length, pieces in self.waiting.items()}
            offset = 0
            for length, n in fullest(counts, self.window, max(counts)).items():
                for _ in range(n):
                    offset = self._emit(self._take(length), offset)
            if offset < self.window:
                self._cut_to_fit(offset, self.window)
            self._close()

    def _cut_to_fit(self, offset: int, end: int) -> None:
        """Fill the rest of a window with the head of waiting pieces; the tail waits on."""
        while offset < end:
            doc_id, start, ids, total = self._take(max(self.waiting))
            head = 4 * (end - offset)
            offset = self._emit((doc_id, start, ids[:head], total), offset)
            if len(ids) > head:
                self._wait((doc_id, start + head // 4, ids[head:], total))

    def finish(self) -> None:
        """The rest goes into sequences of two to some power tokens each."""
        self.pack(self.window)
        while self.tokens:
            self._cut_to_fit(0, 1 << (self.tokens.bit_length() - 1))
            self._close()

    def drain(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in PIECES.split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pd.DataFrame(
            {n: pd.array(list(v), "Int64") if n == "doc_id" else np.array(v, "i8") for n, v in zip(names, columns)}
        )


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, block_tokens: int = BLOCK_TOKENS, special: bool = False,
) -> DataFrame:
    """Sequences of at most ``window`` tokens from whole documents, one row per piece.

    ``doc_id, start, length``: the piece's ids within its document; ``ids_crc32``: of the
    little-endian unsigned 32-bit ids; ``doc_tokens``: ids of the document with ``end_id``;
    ``sequence_id, offset``: its place. Each id of each row lies in exactly one piece; a
    sequence is full or has a power of two of tokens.

    With ``special``, special strings in a text get their own ids, else those of their letters.
    Null and empty texts are the end id alone. A null document id is kept as null. Repeated
    rows are packed as often as they come. An empty table gives no rows. Other columns are
    ignored. The packing depends on how the input is partitioned, the cover does not.
    ``sequence_id`` is the partition number times 2**40 plus a count, so that a task which
    is run again gives the same rows.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, special).ids
        end = end_id.to_bytes(4, "little")
        packer = _Packer(TaskContext.get().partitionId() << 40, window)
        for batch in batches:
            for doc_id, text in zip(batch["id"].astype("Int64"), batch["text"]):
                packer.add(None if doc_id is pd.NA else int(doc_id), encode(text) + end)
                if packer.tokens >= 2 * block_tokens:
                    packer.pack(block_tokens)
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(pack, PIECES)
