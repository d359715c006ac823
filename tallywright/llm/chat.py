"""Chat formatting into a prefix tree of shared turns.

Conversations that begin with the same turns share tree nodes, one per turn.
Sorted by their turns, they are laid out depth first in packs: a turn that the
conversation before has too, at the same place with all turns before it alike,
is not written again. Each node has its interval in the pack, the position at
which it stands in its conversations, the end of its subtree, and the intervals
of its ancestors, to which alone its text may attend. A pack is closed when it is
full, so sharing ends there; no pack depends on another.

A turn is written as <|start|>role<|sep|>text<|end|>. Control strings, these and
those of other common templates, are broken up inside roles and texts by an
escape character, which is itself escaped, so that they can be restored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import col, ship_package

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
# Control strings of common templates.
CONTROL = (START, SEP, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(ESCAPE + "(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*)" + re.escape(END), re.DOTALL)

PACK_CHARS = 1 << 20
PACK_CONVERSATIONS = 4096
# As many turns as can be shared: a pack that is open is shorter than this many empty ones.
PATH_TURNS = PACK_CHARS // len(START + SEP + END) + 1


def escape(text: str) -> str:
    """Text without any control string; `unescape` restores it."""
    text = text.replace(ESCAPE, ESCAPE + "e")
    return _CONTROL.sub(lambda found: found[0][0] + ESCAPE + "b" + found[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda found: ESCAPE if found[1] == "e" else "", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where its text begins and ends in it."""
    head, body = f"{START}{escape(role)}{SEP}", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse_turn(written: str) -> tuple[str, str]:
    found = _TURN.fullmatch(written)
    if found is None:
        raise ValueError("not a written turn")
    return unescape(found[1]), unescape(found[2])


class _Conversation:
    """One conversation while its turns go by. Pieces as long as a pack are put by in a file, whatever its length."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.digest = hashlib.sha256()
        self.path: list[bytes] = []
        self.turns: list[tuple[str, str]] = []
        self.chars = self.written = self.pieces = 0
        self.file = None

    def add(self, role: str, text: str) -> None:
        self.digest.update(b"%d %d " % (len(role.encode()), len(text.encode())) + role.encode() + text.encode())
        if len(self.path) < PATH_TURNS:
            self.path.append(self.digest.digest()[:8])
        self.turns.append((role, text))
        self.chars += len(START + SEP + END) + len(role) + len(text)
        if self.chars >= PACK_CHARS:
            self._put_by()

    def _put_by(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        pickle.dump(self.turns, self.file)
        self.written += sum(len(format_turn(*turn)[0]) for turn in self.turns)
        self.pieces += 1
        self.turns, self.chars = [], 0

    def rows(self) -> Iterator[tuple]:
        """Its pieces, each with what the conversation is sorted by: digests of its beginnings, and of the whole.

        Written characters are given for conversations longer than a piece only.
        """
        path = b"".join([*self.path, self.digest.digest()[:8]])
        if self.file is None:
            yield self.conv_id, path, None, 0, True, self.turns
            return
        if self.turns:
            self._put_by()
        with self.file:
            self.file.seek(0)
            for piece in range(self.pieces):
                yield self.conv_id, path, self.written, piece, piece == self.pieces - 1, pickle.load(self.file)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held = None
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text"))):
            if held is None or held.conv_id != conv_id:
                if held is not None:
                    yield from held.rows()
                held = _Conversation(conv_id)
            held.add(role or "", text or "")
    if held is not None:
        yield from held.rows()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; pieces go out in batches of bounded length."""
    out, chars = [], 0
    for row in _conversations(batches):
        out.append(row)
        chars += sum(len(role) + len(text) for role, text in row[-1]) + len(row[1])
        if chars >= PACK_CHARS:
            yield _piece_batch(out)
            out, chars = [], 0
    if out:
        yield _piece_batch(out)


_PIECES = "conv_id bigint, path binary, chars bigint, piece bigint, last boolean, roles array<string>, texts array<string>"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv_ids, paths, chars, pieces, lasts, turns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(conv_ids, pa.int64()),
            pa.array(paths, pa.binary()),
            pa.array(chars, pa.int64()),
            pa.array(pieces, pa.int64()),
            pa.array(lasts, pa.bool_()),
            pa.array([[role for role, _ in said] for said in turns], pa.list_(pa.string())),
            pa.array([[text for _, text in said] for said in turns], pa.list_(pa.string())),
        ],
        names=["conv_id", "path", "chars", "piece", "last", "roles", "texts"],
    )


_INTERVALS = "array<struct<from: bigint, to: bigint>>"
_NODES = (
    "pack string, seq int, parent int, depth int, start bigint, end bigint, subtree_end bigint, position bigint, "
    f"attends {_INTERVALS}, written string, loss_from int, loss_to int, conv_ids array<bigint>"
)
_ARROW_NODES = pa.schema(
    [
        ("pack", pa.string()),
        ("seq", pa.int32()),
        ("parent", pa.int32()),
        ("depth", pa.int32()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("subtree_end", pa.int64()),
        ("position", pa.int64()),
        ("attends", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
        ("written", pa.string()),
        ("loss_from", pa.int32()),
        ("loss_to", pa.int32()),
        ("conv_ids", pa.list_(pa.int64())),
    ]
)


class Pack:
    """Nodes of one pack in depth-first order; the stack leads to the last conversation's end.

    A conversation longer than a pack fills it. As its length is known before, the
    ends of all open nodes are, too, and what is complete can be taken by `ready`.
    """

    def __init__(self, name: str, loss_roles: Sequence[str]):
        self.name = name
        self.loss_roles = loss_roles
        self.nodes: list[dict] = []
        self.stack: list[tuple[tuple[str, str], dict]] = []
        self.length = 0
        self.opened = 0
        self.conversations = 0
        # Turns that the conversation shares with the one before, until it leaves it.
        self.shared: int | None = 0
        self.end: int | None = None

    def add(self, turns: Iterable[tuple[str, str]], chars: int | None = None) -> None:
        """More turns of a conversation; `chars` are its written characters if it is longer than a pack."""
        for turn in turns:
            if self.shared is not None:
                if self.shared < len(self.stack) and self.stack[self.shared][0] == turn:
                    self.shared += 1
                    continue
                self._leave(chars)
            self._open(turn)

    def finish(self, conv_id: int | None) -> None:
        if self.shared is not None:
            self._leave(None)
        self.shared = 0
        self.stack[-1][1]["conv_ids"].append(conv_id)
        self.conversations += 1

    def _leave(self, chars: int | None) -> None:
        self._close(self.shared)
        self.shared = None
        if chars is not None:
            above = self.stack[-1][1] if self.stack else {"position": 0, "start": 0, "end": 0}
            self.end = self.length + chars - (above["position"] + above["end"] - above["start"])
            for _, node in self.stack:
                node["subtree_end"] = self.end

    def _open(self, turn: tuple[str, str]) -> None:
        written, text_from, text_to = format_turn(*turn)
        loss = turn[0] in self.loss_roles
        above = self.stack[-1][1] if self.stack else None
        attends = []
        if above is not None:
            attends = [dict(part) for part in above["attends"]]
            if attends and attends[-1]["to"] == above["start"]:
                attends[-1]["to"] = above["end"]
            else:
                attends.append({"from": above["start"], "to": above["end"]})
        node = {
            "pack": self.name,
            "seq": self.opened,
            "parent": None if above is None else above["seq"],
            "depth": 0 if above is None else above["depth"] + 1,
            "start": self.length,
            "end": self.length + len(written),
            "subtree_end": self.end,
            "position": 0 if above is None else above["position"] + above["end"] - above["start"],
            "attends": attends,
            "written": written,
            "loss_from": text_from if loss else None,
            "loss_to": text_to if loss else None,
            "conv_ids": [],
        }
        self.length = node["end"]
        self.opened += 1
        self.nodes.append(node)
        if self.end is not None:
            self.stack.clear()
        self.stack.append((turn, node))

    def _close(self, depth: int) -> None:
        for _, node in self.stack[depth:]:
            node["subtree_end"] = self.length
        del self.stack[depth:]

    def full(self) -> bool:
        return self.length >= PACK_CHARS or self.conversations >= PACK_CONVERSATIONS

    def ready(self) -> pa.RecordBatch:
        """All nodes but the last, once no other conversation can come."""
        done, self.nodes = self.nodes[:-1], self.nodes[-1:]
        return pa.RecordBatch.from_pylist(done, schema=_ARROW_NODES)

    def batch(self) -> pa.RecordBatch:
        self._close(0)
        return pa.RecordBatch.from_pylist(self.nodes, schema=_ARROW_NODES)


def _packer(loss_roles: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        pack = Pack(f"{part}-{made}", loss_roles)
        for batch in batches:
            for at in range(batch.num_rows):
                conv_id, chars, last, roles, texts = (
                    batch.column(name)[at].as_py() for name in ("conv_id", "chars", "last", "roles", "texts")
                )
                pack.add(zip(roles, texts), chars)
                if pack.end is not None:
                    yield pack.ready()
                if last:
                    pack.finish(conv_id)
                if last and pack.full():
                    yield pack.batch()
                    made += 1
                    pack = Pack(f"{part}-{made}", loss_roles)
        if pack.nodes:
            yield pack.batch()

    return run


def write_packs(
    df: DataFrame,
    path: str,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> None:
    """Writes the conversations of `df`, one row per turn, as packs of tree nodes.

    Turns follow `turn`, then role and text where turns repeat, NULLs first. NULL
    roles and texts are written as empty ones; rows without a `conv_id` are one
    conversation. A conversation of any length goes by in pieces of about a pack's
    characters; only its turns' texts are each held as a whole, and its pack is
    written piece by piece. An empty table writes no packs.
    """
    ship_package(df.sparkSession)
    rows = df.select(
        col(conv_id).cast("bigint").alias("conv_id"),
        col(turn).alias("turn"),
        col(role).alias("role"),
        col(text).alias("text"),
    )
    said = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    pieces = said.select("conv_id", "role", "text").mapInArrow(_pieces, _PIECES)
    # Equal conversations may be many, so their ids share in the order.
    dealt = pieces.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id", "piece")
    packed = dealt.select("conv_id", "chars", "last", "roles", "texts")
    packed.mapInArrow(_packer(tuple(loss_roles)), _NODES).write.parquet(path)


_BACK = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pack and place; a node's digests continue those of the node above it."""
    pack, stack = None, []
    for batch in batches:
        out = []
        for node in batch.to_pylist():
            if node["pack"] != pack:
                pack, stack = node["pack"], []
            while stack and stack[-1][0] <= node["start"]:
                stack.pop()
            if stack:
                _, turns, sha, loss_chars, loss_sha, chars = stack[-1]
                sha, loss_sha = sha.copy(), loss_sha.copy()
            else:
                turns, sha, loss_chars, loss_sha, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            role, text = parse_turn(node["written"])
            sha.update(f"{role}\n{text}\n".encode())
            if node["loss_from"] is not None:
                masked = unescape(node["written"][node["loss_from"] : node["loss_to"]])
                loss_chars += len(masked)
                loss_sha.update(masked.encode())
            # What ends with this node is needed no longer, so that a long chain takes no memory.
            while stack and stack[-1][0] == node["subtree_end"]:
                stack.pop()
            stack.append((node["subtree_end"], turns + 1, sha, loss_chars, loss_sha, chars + len(node["written"])))
            _, turns, sha, loss_chars, loss_sha, chars = stack[-1]
            out += [
                {
                    "conv_id": conv_id,
                    "n_turns": turns,
                    "turns_sha256": sha.hexdigest(),
                    "loss_chars": loss_chars,
                    "loss_sha256": loss_sha.hexdigest(),
                    "formatted_chars": chars,
                }
                for conv_id in node["conv_ids"]
            ]
        yield pa.RecordBatch.from_pylist(out, schema=_BACK)


def read_back(packs: DataFrame) -> DataFrame:
    """Per conversation in `packs` its turns, its text under the loss mask and its length, as digests and counts."""
    ship_package(packs.sparkSession)
    dealt = packs.select("pack", "seq", "start", "subtree_end", "written", "loss_from", "loss_to", "conv_ids")
    dealt = dealt.repartition("pack").sortWithinPartitions("pack", "seq")
    return dealt.mapInArrow(
        _digests,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
