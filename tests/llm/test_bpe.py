from __future__ import annotations

import codecs
import hashlib
import os

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywright.llm import bpe, queries
from tallywright.llm.common import tidied
from tests.llm.helpers import edge_documents, no_documents

RAW = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
RANKS = bpe.parse_ranks(RAW)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
FRESH = bpe.Transducer(RANKS)
DECODER = bpe.Decoder(RANKS, step=3)
SF_DIR = "/root/testdata/sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ehtlinorsa 'lvé漢½²\n\x1c\x85　", max_size=60))
def test_as_the_library_and_back(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = ENCODER.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert DECODER.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 20_000, "lolo" * 5000, " " * 3000 + "x", "<|endoftext|>", "\n\n a  b\n "])
def test_long_pieces_and_blanks(text):
    assert ENCODER.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_states_are_dropped_and_made_again():
    small = bpe.Transducer(RANKS, state_bytes=4000)
    for word in ("internationalization", "antidisestablishmentarianism", "x" * 300, "ehtlinorsa" * 40):
        assert small.encode(word.encode()) == LIBRARY.encode_ordinary(word)


def test_memory_is_bounded_and_renewed():
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN, memo_bytes=20_000)
    small.transducer.state_bytes = 20_000
    for at in range(300):
        text = " ".join(f"word{at * 7 % 300} again{i}" for i in range(20))
        assert small.encode(text).tolist() == LIBRARY.encode_ordinary(text)
        assert small.pieces.held + getattr(small.pieces.old, "held", 0) < 3 * 20_000
        assert small.transducer.held < 2 * 20_000


def test_a_token_no_merge_reaches_is_never_given():
    ranks = {bytes((i,)): i for i in range(256)} | {b"ab": 256, b"bcd": 257}  # b"bc" and b"cd" are missing
    assert bpe.Transducer(ranks).encode(b"bcdab") == [98, 99, 100, 256]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=24) | st.text(max_size=8).map(lambda t: t.encode("utf-8", "ignore")), st.integers(1, 5))
def test_utf8_stream_in_steps(data, step):
    stream, machine = bpe.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace")
    parts = [data[i : i + step] for i in range(0, len(data), step)]
    ours = "".join(map(stream.feed, parts)) + stream.close()
    assert ours == "".join(map(machine.decode, parts)) + machine.decode(b"", True) == data.decode("utf-8", "replace")


def test_every_row_of_an_odd_table(spark):
    encoded = bpe.encode(edge_documents(spark, extra=True), "text", RAW, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, "ids", RAW).collect()
    assert len(rows) == edge_documents(spark).count()
    for row in rows:
        assert row["ids"] == LIBRARY.encode_ordinary(row["text"] or "")
        assert row["decoded"] == (row["text"] or "")


def test_empty_table(spark):
    encoded = bpe.encode(no_documents(spark), "text", RAW, public_tokenizers.PATTERN)
    assert bpe.decode(encoded, "ids", RAW).collect() == []


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op1_byte_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_encoder_runs_once_per_text(spark, capsys):
    queries.op1_byte_bpe(spark, SF_DIR).explain()
    assert capsys.readouterr().out.count("token_ids(") == 1


def test_unknown_steps_are_seldom_kept():
    """Pieces that are met once must not fill the memory of states, or it is dropped over and over."""
    fresh, words = bpe.Transducer(RANKS), [f"vé{i * 7919 % 10_000:04d}tionth{i}eleierç" for i in range(2000)]
    for word in words:
        assert fresh.encode(word.encode()) == LIBRARY._encode_single_piece(word.encode())
    assert len(fresh._next) < len(words) / 4


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=70) | st.text("ehtlinorsavé'", min_size=1, max_size=60).map(str.encode))
def test_pieces_without_known_steps(piece):
    assert bpe.Transducer.encode(FRESH, piece) == LIBRARY._encode_single_piece(piece)
    assert FRESH._rest(-1, piece, 0) == LIBRARY._encode_single_piece(piece)


def test_a_piece_no_token_begins():
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0, b"b": 1})._rest(-1, b"abc", 0)


def test_arrow_gives_back_what_a_task_took():
    taken = []

    def run(batches):
        for size in batches:
            array = pa.array(range(size), pa.int64()).cast(pa.string())
            yield len(array)
            del array
            taken.append(_resident())

    before = _resident()
    assert list(tidied(run)(iter([3_000_000]))) == [3_000_000]
    assert _resident() <= max(taken) and _resident() - before < 40 << 20


def _resident() -> int:
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
