"""Token ids in binary files: fixed-width bit packing with random access.

A file is, all integers little-endian:

    magic ``GTOK0001``, then unsigned 64-bit: bits per id, ids per block, documents,
    documents with a null id (they come first), ids
    document ids            signed 64-bit, one per document
    document starts         unsigned 64-bit, one per document and the end
    block offsets           unsigned 64-bit, byte offset of each block and the end
    blocks                  ids of ``bits`` bits each, lowest bits first, in whole 64-bit words

``bits`` is the least number that holds every id of the vocabulary. A block is a multiple
of 64 ids long, so its 64-id rows are ``bits`` words each and one array operation per
position in the row packs or unpacks all rows of many blocks.

Files are written to a folder that all executors share. A task writes its file under a
name of its own attempt and then renames it to the name of its partition, so a task that
is run again or twice leaves one whole file. The written manifest lists them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gauge_engine.llm.shipping import ship_package
from gauge_engine.llm.tokens import encoder, vocabulary_size

MAGIC = b"GTOK0001"
BLOCK_IDS = 64 * 1024
_HEAD = 8 + 5 * 8

# Partitions of a read; with more files than this, a task reads several.
MOST_READERS = 10_000

MANIFEST = "file string, part bigint, documents bigint, ids bigint"
RECORDS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids, padded with zeros to a multiple of 64, as unsigned 64-bit words."""
    rows = np.zeros((-(-len(ids) // 64), 64), "<u8")
    rows.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(rows), bits), "<u8")
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack_bits(words: np.ndarray, bits: int) -> np.ndarray:
    """All ids of whole 64-id rows."""
    rows = words.reshape(-1, bits)
    ids = np.empty((len(rows), 64), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value |= rows[:, word + 1] << np.uint64(64 - shift)
        ids[:, i] = value & mask
    return ids.reshape(-1)


def shared_filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or URI, and the path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(), folder
    )


class _FileWriter:
    """One file in the making: packed blocks so far, and the ids of the open block."""

    def __init__(self, bits: int, block_ids: int):
        self.bits, self.block_ids = bits, block_ids
        self.doc_ids: list[int | None] = []
        self.starts = [0]
        self.blocks: list[bytes] = []
        self.open: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            self._flush(self.waiting - self.waiting % self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.empty(0, "<u4")
        for at in range(0, n, self.block_ids):
            self.blocks.append(pack_bits(ids[at : min(n, at + self.block_ids)], self.bits).tobytes())
        self.open, self.waiting = [ids[n:]], len(ids) - n

    def sink(self, file) -> None:
        self._flush(self.waiting)
        nulls = sum(d is None for d in self.doc_ids)
        sizes = np.array([0, *map(len, self.blocks)], "<u8")
        head = _HEAD + 8 * (2 * len(self.doc_ids) + 1) + 8 * len(sizes)
        file.write(MAGIC)
        file.write(np.array([self.bits, self.block_ids, len(self.doc_ids), nulls, self.starts[-1]], "<u8").tobytes())
        file.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        file.write(np.array(self.starts, "<u8").tobytes())
        file.write((head + np.cumsum(sizes)).astype("<u8").tobytes())
        for block in self.blocks:
            file.write(block)


class TokenFile:
    """Random access to one file; reads only the head and the blocks asked for."""

    def __init__(self, path: str):
        system, name = shared_filesystem(path)
        self.file = system.open_input_file(name)
        head = self._at(0, _HEAD)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.bits, self.block_ids, self.documents, self.nulls, self.ids = map(
            int, np.frombuffer(head, "<u8", offset=8)
        )
        n, blocks = self.documents, -(-self.ids // self.block_ids)
        self.doc_ids = np.frombuffer(self._at(_HEAD, 8 * n), "<i8")
        self.starts = np.frombuffer(self._at(_HEAD + 8 * n, 8 * (n + 1)), "<u8").astype("i8")
        self.offsets = np.frombuffer(self._at(_HEAD + 8 * (2 * n + 1), 8 * (blocks + 1)), "<u8").astype("i8")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        start, stop = max(0, start), min(stop, self.ids)
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids + 1
        raw = self._at(self.offsets[first], self.offsets[last] - self.offsets[first])
        ids = unpack_bits(np.frombuffer(raw, "<u8"), self.bits)
        base = first * self.block_ids
        return ids[start - base : stop - base]

    def document(self, i: int) -> np.ndarray:
        """All ids of the ``i``-th document of the file."""
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", block_ids: int = BLOCK_IDS, special: bool = False,
) -> DataFrame:
    """Write whole documents in ascending id order; returns the written manifest.

    One file per partition of the ordered rows. Null ids come first; rows with equal ids
    are ordered by a hash of their text, so the files are the same on every run. Null and empty texts
    are the end id alone. An empty table gives no file with documents. Other columns are
    ignored. With ``special``, special strings in a text get their own ids, else those of
    their letters. ``folder`` must be shared by all executors and not be written to before.
    """
    spark = docs.sparkSession
    bits = bits_for(max(vocabulary_size(tokenizer), end_id + 1))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer, special).ids
        end = end_id.to_bytes(4, "little")
        out = _FileWriter(bits, block_ids)
        for batch in batches:
            for doc_id, text in zip(batch["id"].astype("Int64"), batch["text"]):
                ids = np.frombuffer(encode(text) + end, "<u4")
                out.add(None if doc_id is pd.NA else int(doc_id), ids)
        if not out.doc_ids:
            return
        system, at = shared_filesystem(folder)
        system.create_dir(at, recursive=True)
        name = f"ids-{part:08d}.gtok"
        mine = f"{at}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(mine) as file:
            out.sink(file)
        system.move(mine, f"{at}/{name}")
        yield pd.DataFrame(
            {"file": [f"{folder}/{name}"], "part": [part], "documents": [len(out.doc_ids)], "ids": [out.starts[-1]]}
        )

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # Cuts between partitions are found from sampled sort keys: a hash of the text, not the text.
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text"))
    written = rows.orderBy(*order).mapInPandas(write, MANIFEST)
    written.write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``file, part, documents, ids`` and ``start``: the ids of all earlier files."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row per file, not per document.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from its file: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and the crc32 of its ids as little-endian unsigned 32-bit."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["file"], batch["start"]):
                held = TokenFile(path)
                # A run of documents at a time, about a megabyte of ids or one document.
                at = 0
                while at < held.documents:
                    to = max(at + 1, int(np.searchsorted(held.starts, held.starts[at] + (1 << 18), "right")) - 1)
                    ids = held.read(int(held.starts[at]), int(held.starts[to]))
                    cuts = held.starts[at : to + 1] - held.starts[at]
                    numbers = pd.array(held.doc_ids[at:to], "Int64")
                    numbers[: max(0, held.nulls - at)] = pd.NA
                    yield pd.DataFrame(
                        {
                            "doc_id": numbers,
                            "start": base + held.starts[at:to],
                            "n_tokens": np.diff(cuts),
                            "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])],
                        }
                    )
                    at = to
                held.close()

    files = read_manifest(spark, folder).select("file", "start")
    # One row per file: dealt out, so that many tasks read files at once.
    return files.repartition(min(files.count(), MOST_READERS) or 1, "file").mapInPandas(read, RECORDS)
