"""Special strings in texts, against tokenizers left as they are."""

import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gauge_engine.llm.catalog import QUERIES
from gauge_engine.llm.tokens import encoder

TEXTS = [
    "<|endoftext|>", "a <|endoftext|> b", "two  <|endoftext|>  ends.<|endoftext|><|startoftext|>É x", "<|ENDOFTEXT|> <|endoftext| >",
    "word<|startoftext|>\n\nword ́<|endoftext|>́, ok", "plain text.", "",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_strings_get_their_ids(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    for text in TEXTS:
        want = b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids)
        assert encoder(path, special=True).ids(text) == want, text


def test_packing_query_encodes_special_strings(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    for r in QUERIES["op1_packing"](spark, str(tmp_path)).collect():
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
