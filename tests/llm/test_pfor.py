from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallywright.llm import pfor, queries
from tests.llm.helpers import edge_documents, no_documents

SF_DIR = "/root/testdata/sf0.001"
with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
    DEFINITION = file.read()
LIBRARY = Tokenizer.from_str(DEFINITION)
WORDS = pfor.WordTokens(DEFINITION)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=300), st.sampled_from([8, 64, 512]))
def test_blocks_come_back(values, block):
    values = np.array(values, np.uint32)
    starts, body = pfor.pack(values, block)
    assert (pfor.unpack(starts, body, len(values), block) == values).all()


def test_width_holds_most_and_exceptions_the_rest():
    values = np.full(512, 1000, np.uint32)
    values[:40] += np.arange(40, dtype=np.uint32) % 4
    values[500:] = 60_000
    starts, body = pfor.pack(values)
    assert len(body) == 7 + 6 * (30 + 12)  # a width of 0, and 42 exceptions
    assert (pfor.unpack(starts, body, 512) == values).all()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text("aB's ̧́Σσİ漢½\n\x1c\x85　<|endoftext|>", max_size=60))
def test_parts_give_what_the_whole_text_gives(text):
    text = text.encode("utf-8", "ignore").decode()
    assert WORDS.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


PLAIN = "Word*** the... (sic) it's I'LL don't x@y.com a-b 3.14 50% !'s ''d _a_ \"q\" |--| <|x|> été!! Ñu?".split()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=12) | st.text("aZ9's.,-_<|>=é̸ß\x7f\xa0", max_size=12) | st.sampled_from(PLAIN))
def test_new_parts_give_what_the_library_gives(part):
    part = part.encode("utf-8", "ignore").decode()
    WORDS.memo.clear()
    assert WORDS.encode(part) == LIBRARY.encode(part, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("most", [1, 9, 1 << 20])
def test_texts_together_give_what_each_gives(kind, most):
    texts = ["x", None, "", " ", "The cat, the\xa0cat", None, " a  b ", "\u3000", "Σας été", "", "out"]
    slices = list(pfor._batches_of(pa.array(texts, kind).slice(1, 9), most))
    assert pa.concat_arrays(slices).to_pylist() == texts[1:10]
    found = []
    for own in slices:
        ids, ends = WORDS.encode_all(own)
        found += [part.tolist() for part in np.split(ids, ends[:-1])]
    assert found == [LIBRARY.encode(text or "", add_special_tokens=False).ids for text in texts[1:10]]


def test_different_parts_are_looked_up_once_a_batch():
    class Counting(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    coder = pfor.WordTokens(DEFINITION)
    coder.memo = Counting()
    ids, ends = coder.encode_all(pa.array(["so many words, so many times"] * 500))
    assert len(ends) == 500 and len(ids) == 500 * len(coder.encode("so many words, so many times"))
    assert coder.memo.asked < 50


def test_plain_parts_are_not_given_to_the_whole_library():
    class Library:
        asked = []

        def encode_batch_fast(self, parts, add_special_tokens):
            self.asked += parts
            return LIBRARY.encode_batch_fast(parts, add_special_tokens=add_special_tokens)

    coder = pfor.WordTokens(DEFINITION)
    coder.library = Library()
    assert coder.encode(" ".join(PLAIN)) == LIBRARY.encode(" ".join(PLAIN), add_special_tokens=False).ids
    assert coder.library.asked == ["<|x|>"]


def check(rows, docs):
    start = 0
    by_start = sorted(rows, key=lambda row: row["start"])
    assert [row["doc_id"] for row in by_start] == [doc_id for doc_id, _ in docs]
    for row, (_, text) in zip(by_start, docs):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]
        assert row["start"] == start
        yield row, ids
        start += len(ids)


@pytest.mark.parametrize("segment_ids", [500, 1 << 20])
def test_odd_table(spark, tmp_path, segment_ids):
    path = str(tmp_path / "ids")
    frame = edge_documents(spark, extra=True).repartition(4)
    pfor.write_ids(frame, path, DEFINITION, 1, segment_ids=segment_ids)
    rows = pfor.read_ids(spark, path).collect()
    assert len(rows) == frame.count()
    texts = {}
    for row in frame.collect():
        ids = [*LIBRARY.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        texts.setdefault(row["doc_id"], []).append(ids)
    start = 0
    for row in sorted(rows, key=lambda row: row["start"]):
        assert row["start"] == start
        texts[row["doc_id"]].remove(row["ids"])
        start += len(row["ids"])
    order = [row["doc_id"] for row in sorted(rows, key=lambda row: row["start"])]
    assert order == sorted(order, key=lambda doc_id: (doc_id is not None, doc_id))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids")
    pfor.write_ids(no_documents(spark), path, DEFINITION, 1)
    assert pfor.read_ids(spark, path).collect() == []


def test_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    for row, ids in check(queries.op4_pfor_ids(spark, SF_DIR).collect(), docs):
        assert row["n_tokens"] == len(ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
