from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywright.llm import chat, queries

SF_DIR = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string"
TRICKY = st.lists(st.sampled_from([*chat.CONTROL, chat.ESCAPE, "<", "|", "e", "b", "s>", "[", "x", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TRICKY | st.text(max_size=20), TRICKY)
def test_escapes_can_be_undone(text, role):
    escaped = chat.escape(text)
    assert not any(control in escaped for control in chat.CONTROL)
    assert chat.unescape(escaped) == text
    written, begin, end = chat.format_turn(role, text)
    assert chat.parse_turn(written) == (role, text)
    assert chat.unescape(written[begin:end]) == text
    assert sum(written.count(control) for control in (chat.START, chat.SEP, chat.END)) == 3


def expected(rows):
    conversations = defaultdict(list)
    for row in rows:
        conversations[row[0]].append((row[1] is not None, row[1], row[2] is not None, row[2] or "", row[3] is not None, row[3] or ""))
    out = {}
    for conv_id, turns in conversations.items():
        said = [(turn[3], turn[5]) for turn in sorted(turns)]
        loss = "".join(text for role, text in said if role == "assistant")
        out[conv_id] = (
            len(said),
            hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in said).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
            sum(len(chat.format_turn(role, text)[0]) for role, text in said),
        )
    return out


def found(frame):
    rows = frame.collect()
    out = {row["conv_id"]: tuple(row)[1:] for row in rows}
    assert len(out) == len(rows)
    return out


ODD = [
    (1, 0, "user", "hello"),
    (1, 1, "assistant", "<|end|></s>" + chat.ESCAPE),
    (2, 0, "user", "hello"),
    (2, 1, "assistant", "<|end|></s>" + chat.ESCAPE),
    (2, 2, "user", ""),
    (3, 0, "user", "hello"),
    (4, 0, None, None),
    (4, None, "user", "before all"),
    (5, 7, "assistant", "x" * 300_000),
    (5, 7, "assistant", "x" * 300_000),
    (None, 0, "user", "whose?"),
    (None, 0, "tool", "whose?"),
]


def test_odd_table(spark, tmp_path):
    frame = spark.createDataFrame(ODD, TURNS).selectExpr("*", "1 AS turns", "2 AS path", "3 AS pack")
    chat.write_packs(frame, str(tmp_path / "packs"))
    assert found(chat.read_back(spark.read.parquet(str(tmp_path / "packs")))) == expected(ODD)


def test_empty_table(spark, tmp_path):
    chat.write_packs(spark.createDataFrame([], TURNS), str(tmp_path / "packs"))
    assert found(chat.read_back(spark.read.parquet(str(tmp_path / "packs")))) == {}


def test_shared_turns_are_written_once_and_seen_by_their_subtree(spark, tmp_path):
    said = {i: ["sys", f"a{i % 2}", f"b{i % 4}", f"c{i}"][: 2 + i % 3] for i in range(40)}
    rows = [(i, at, "user", text) for i, texts in said.items() for at, text in enumerate(texts)]
    chat.write_packs(spark.createDataFrame(rows, TURNS).coalesce(1), str(tmp_path / "packs"))
    packs = defaultdict(list)
    for node in spark.read.parquet(str(tmp_path / "packs")).collect():
        packs[node["pack"]].append(node)
    paths = set()
    for nodes in packs.values():
        nodes.sort(key=lambda node: node["seq"])
        here = set()
        for node in nodes:
            above, at = [], node
            while at["parent"] is not None:
                at = nodes[at["parent"]]
                above.insert(0, at)
            path = tuple(n["written"] for n in (*above, node))
            assert path not in here  # once per pack
            here.add(path)
            assert node["position"] == sum(n["end"] - n["start"] for n in above)
            seen = {x for part in node["attends"] for x in range(part["from"], part["to"])}
            assert seen == {x for n in above for x in range(n["start"], n["end"])}
            assert all(n["start"] <= node["start"] < n["subtree_end"] for n in above)
            assert all(not n["start"] <= node["start"] < n["subtree_end"] for n in nodes if n not in above and n != node)
        paths |= here
    assert paths == {
        tuple(chat.format_turn("user", text)[0] for text in texts[:k]) for texts in said.values() for k in range(1, len(texts) + 1)
    }


def test_many_equal_conversations(spark, tmp_path, monkeypatch):
    frame = spark.range(9000).selectExpr("id DIV 2 AS conv_id", "id % 2 AS turn", "'user' AS role", "'same' AS text")
    chat.write_packs(frame, str(tmp_path / "packs"))
    packs = spark.read.parquet(str(tmp_path / "packs"))
    result = found(chat.read_back(packs))
    assert sorted(result) == list(range(4500))
    assert len(set(result.values())) == 1
    assert packs.count() <= 2 * 4 * packs.rdd.getNumPartitions() + 8


def test_many_shared_turns_are_written_once(spark, tmp_path):
    """Beyond 60 turns that all share, some share more."""
    rows = [(i, at, "user", f"t{at}" if at < 60 else f"g{i % 3}" if at == 60 else f"c{i}") for i in range(40) for at in range(62)]
    chat.write_packs(spark.createDataFrame(rows, TURNS), str(tmp_path / "packs"))
    packs = spark.read.parquet(str(tmp_path / "packs"))
    assert packs.groupBy("pack", "parent", "written").count().where("count > 1").count() == 0
    assert found(chat.read_back(packs)) == expected(rows)


def test_long_conversation_goes_by_in_pieces(spark, tmp_path):
    """Without an id, beside others that begin alike; none of its turns is written or held with all others."""
    long = [(None, at, ("user", "assistant")[at % 2], f"{at if at > 2 else ''} </s>" + "x" * 400) for at in range(8000)]
    rows = [*long, *((i, at, role, text) for i in range(5) for _, at, role, text in long[: i + 1])]
    frame = spark.createDataFrame(rows, TURNS)
    sizes = []
    for batch in chat._pieces(iter([pa.RecordBatch.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), row)) for row in long])])):
        sizes += [sum(map(len, texts)) for texts in batch.column("texts").to_pylist()]
    assert len(sizes) == 4 and max(sizes) <= chat.PACK_CHARS
    chat.write_packs(frame.repartition(3), str(tmp_path / "packs"))
    packs = spark.read.parquet(str(tmp_path / "packs"))
    assert found(chat.read_back(packs)) == expected(rows)
    ends = packs.where("size(conv_ids) > 0 and conv_ids[0] is null").selectExpr("pack", "end", "depth").collect()
    assert [row["depth"] for row in ends] == [7999]
    tail = packs.where(f"pack = '{ends[0]['pack']}' and depth > 10").selectExpr("min(subtree_end) = max(subtree_end)", "max(subtree_end)")
    assert [tuple(row) for row in tail.collect()] == [(True, ends[0]["end"])]


@pytest.mark.parametrize("turns", [1, chat.PATH_TURNS + 5])
def test_query(spark, turns):
    rows = [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op8_chat_tree(spark, SF_DIR)) == expected(rows + queries.EXTRA_CONVERSATION)
