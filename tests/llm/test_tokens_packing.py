"""Encoding in parts, packing and token files, against whole encoding and round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gauge_engine.llm.packing import fullest, pack_documents
from gauge_engine.llm.token_files import (
    TokenFile,
    bits_for,
    pack_bits,
    read_token_files,
    unpack_bits,
    write_token_files,
)
from gauge_engine.llm.tokens import encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = [
    "", "a", "A test, it's fine.", "  two  blanks\n\nand\tlines \r\n", "İstanbul. é É ß ſ ﬁ 1٣Ⅷ", "<|endoftext|>.",
    "x" * 3000, "word " * 5000, "中文 and 🙂, ok.", "'s 'LL foo'll", "≠ a̸.",
]
ROWS = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 2), (3, TEXTS[3], 1), (90, None, 3)]
SCHEMA = "doc_id long, text string, start int"


def whole(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_parts_encode_like_the_whole(path):
    for text in TEXTS:
        assert encoder(path).ids(text) + (2).to_bytes(4, "little") == whole(path)(text).tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBé É.,'s\n\t 1İß<|>\x85", max_size=30))
def test_any_text_encodes_like_the_whole(text):
    for path in (WORD, BYTE):
        assert encoder(path).ids(text) == whole(path)(text)[:-1].tobytes()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 4), min_size=1, max_size=8), st.integers(60, 90))
def test_fullest_is_the_best_subset_sum(counts, capacity):
    first = max(counts)
    taken = fullest(counts, capacity, first)
    assert taken[first] >= 1 and all(n <= counts[k] for k, n in taken.items())
    sums = {first}
    for length, n in counts.items():
        for _ in range(n - (length == first)):
            sums |= {s + length for s in sums if s + length <= capacity}
    assert sum(k * n for k, n in taken.items()) == max(sums)


def check_pieces(pieces, texts):
    ids = {i: whole(WORD)(t) for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        own = ids[p.doc_id][p.start : p.start + p.length].tobytes()
        assert p.length > 0 and zlib.crc32(own) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    for doc, held in by_doc.items():
        starts = sorted((p.start, p.length) for p in held)
        assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
        assert sum(n for _, n in starts) == len(ids[doc])
    assert set(by_doc) == set(ids)
    for held in by_sequence.values():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == [sum(p.length for p in held[:i]) for i in range(len(held))]
        total = sum(p.length for p in held)
        assert total <= 4096 and (total == 4096 or total & (total - 1) == 0)


def test_each_token_lies_in_one_piece(spark):
    texts = TEXTS + ["w%d " % i * (i * 7 % 900) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check_pieces(pack_documents(docs, WORD).collect(), texts)
    small = pack_documents(docs.coalesce(1), WORD, block_tokens=5000).collect()
    check_pieces(small, texts)


def test_packing_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = pack_documents(docs, WORD).collect()
    assert sum(p.length for p in got if p.doc_id is None) == len(whole(WORD)("no id"))
    assert sum(p.length for p in got if p.doc_id == 3) == 2 * len(whole(WORD)(TEXTS[3]))
    assert [p.length for p in got if p.doc_id == 90] == [1]
    assert pack_documents(docs.limit(0), WORD).collect() == []


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 31])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype("<u4")
    words = pack_bits(ids, bits)
    assert len(words) == 16 * bits and (unpack_bits(words, bits)[:1000] == ids).all()
    assert bits_for(1 << bits) == bits and bits_for((1 << bits) + 1) == bits + 1


def test_token_files_read_back_in_order(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    folder = f"file://{tmp_path}/ids"
    manifest = write_token_files(docs, BYTE, folder, block_ids=128)
    got = read_token_files(spark, folder).orderBy("start").collect()
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    ids = [whole(BYTE)(r[1]) for r in want]
    assert [r.n_tokens for r in got] == [len(i) for i in ids]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(i.tobytes()) for i in ids]
    assert [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    first = manifest.orderBy("part").first()
    held = TokenFile(first.file)
    everything = held.read(0, held.ids)
    for a, b in ((0, 1), (5, 200), (127, 129), (held.ids - 3, held.ids)):
        assert (held.read(a, b) == everything[max(0, a) : b]).all()
    held.close()


def test_token_files_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    write_token_files(docs, BYTE, str(tmp_path / "none"))
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0
    assert docs.where(F.lit(True)).count() == 0
