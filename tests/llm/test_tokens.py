"""Token counts and token files against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from prefrank.llm import binary, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "  two  spaces \n\n x ", "<|endoftext|>", "a<|endoftext|> b<|ENDOFTEXT|>", "İı ǅß\u0085\x1c it's 'RE don't", "日本 x２３", "éé", "a" * 20_000, "ab " * 5_000]
PIECES = st.sampled_from(["a", "Th", " ", "  ", "\n", "\t", "'s", "'RE", "1", "é", "É", "İ", "日", ".", "##", "<|endoftext|>", "\x1c", "\u0085", " ", "ǆ", "²", "Ɛ", "Ɓ", "Ə", "Ɔ", "ɛ", "Ⱥ"])
#: Every letter below U+0250 and its lower case, alone and inside words.
LETTERS = [f"{w}{c}{x}" for w, x in (("", ""), ("", "dan"), ("ma ", "a")) for c in map(chr, range(0x20, 0x250))]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=20).map("".join))
def test_texts_equal_the_library(text):
    libs = test_texts_equal_the_library.__dict__.setdefault("libs", (Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)))
    assert tokens.vocabulary(BYTES, 1000).texts([text])[0] == len(libs[0].encode(text, add_special_tokens=False).ids)
    assert binary.encoder(WORDS, 1000).texts([text])[0].tolist() == libs[1].encode(text, add_special_tokens=False).ids


def test_letters_equal_the_library(library):
    encode = binary.Encoder(WORDS, 100).texts
    for at in range(0, len(LETTERS), 300):
        part = LETTERS[at:at + 300] + [t.lower() for t in LETTERS[at:at + 300]]
        assert [x.tolist() for x in encode(part)] == [library[1].encode(t, add_special_tokens=False).ids for t in part]


def test_token_counts(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(3, ODD[3], "x")], "doc_id long, text string, n_tokens string")
    rows = tokens.token_counts(docs, BYTES, limit=100).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        text = ODD[r["doc_id"]] or ""
        n = len(library[0].encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)
    assert tokens.token_counts(docs.limit(0), BYTES).count() == 0


def test_token_files(spark, library, tmp_path):
    docs = spark.createDataFrame([(None, "lost", 1)] + [(100 - i, t, i) for i, t in enumerate(ODD)] + [(97, "again", 2), (97, "again", 2)], "doc_id long, text string, part int")
    binary.write_tokens(docs, f"{tmp_path}/t", WORDS, row_group_bytes=1 << 16, page_rows=4)
    rows = binary.read_tokens(spark, f"{tmp_path}/t").collect()
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["tokens"]) and r["tokens"][-1] == 2
        at += len(r["tokens"])
    assert [r["doc_id"] for r in rows] == sorted([r["doc_id"] for r in docs.collect()], key=lambda i: -1 if i is None else i)
    want = sorted(library[1].encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect())
    assert sorted(r["tokens"] for r in rows) == want
    index = {r["start"]: r["ids_crc32"] for r in binary.token_index(spark, f"{tmp_path}/t").collect()}
    assert index == {r["start"]: zlib.crc32(np.array(r["tokens"], "<u4").tobytes()) for r in rows}
    assert binary.tokenize(docs.limit(0), WORDS).count() == 0


def test_token_files_have_indexes_and_dictionaries(spark, tmp_path):
    import pyarrow.parquet as pq

    binary.write_tokens(spark.range(500).selectExpr("id AS doc_id", "repeat('the end of it ', 20) AS text"), f"{tmp_path}/t", WORDS)
    file = pq.ParquetFile(next(tmp_path.glob("t/*.parquet")))
    columns = {file.metadata.row_group(0).column(i).path_in_schema.split(".")[0]: file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)}
    assert "RLE_DICTIONARY" in columns["tokens"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_offset_index and columns["tokens"].has_offset_index
