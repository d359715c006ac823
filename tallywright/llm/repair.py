"""Repair of conversations to alternating turns, by the cheapest edits.

The rows of a conversation are read in order. A row is kept, given another role,
or deleted, and empty turns may be inserted anywhere, so that the roles read: a
system turn or none, then user and assistant in turn, ending with the assistant.
After each row the cheapest edits are known for each of four places in that
pattern; of equally cheap ones the edits whose initials come first in ASCII.

The edits so far are kept as a tree: a node is one more edit after its parent's,
so what two candidates share is stored once. Every node has ancestors at powers
of two and a rolling hash of the whole string of initials up to it. Of equally
cheap candidates, the longest common prefix is searched along the ancestors by
their hashes, and checked edit by edit unless both end in the very same node;
the next initials decide. Two candidates for one place are never prefix and
whole: what one had more could only be insertions, which cost.

What all four candidates share is settled. It is given out and forgotten, so a
conversation of any length goes by in little memory, unless its repairs differ
from the start and stay equally likely for long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import col, ship_package

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL_PAIRS = {"su", "ua", "au"}
SETTLE_NODES = 2048
SEND_ROWS, SEND_CHARS = 2000, 4_000_000

# Where a conversation may stand: nothing yet, after a system turn, after a
# user's, after an assistant's. It may end at the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
BEFORE_USER = (START, SYSTEM, ASSISTANT)


class Audits:
    """Strings of edits that share their prefixes, as nodes of one tree.

    Node 0 is what has been settled before; depths count from there.
    """

    def __init__(self, base: int = 1_000_003, modulus: int = (1 << 61) - 1):
        self.base, self.modulus = base, modulus
        self.letters, self.rows, self.depths, self.hashes, self.up = [""], [-1], [0], [0], [()]

    def __len__(self) -> int:
        return len(self.letters)

    def add(self, parent: int, letter: str, row: int) -> int:
        """A node for `letter`, done to `row`, after all edits of `parent`."""
        node = len(self.letters)
        self.letters.append(letter)
        self.rows.append(row)
        self.depths.append(self.depths[parent] + 1)
        self.hashes.append((self.hashes[parent] * self.base + ord(letter)) % self.modulus)
        above, up = parent, [parent]
        while len(self.up[above]) >= len(up):
            above = self.up[above][len(up) - 1]
            up.append(above)
        self.up.append(tuple(up))
        return node

    def ancestor(self, node: int, depth: int) -> int:
        while self.depths[node] > depth:
            node = self.up[node][(self.depths[node] - depth).bit_length() - 1]
        return node

    def before(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether the edits of `a` and then `x` come before those of `b` and then `y`."""
        if a == b:
            return x < y
        depth = min(self.depths[a], self.depths[b])
        p, q = self.ancestor(a, depth), self.ancestor(b, depth)
        if p != q and self.hashes[p] != self.hashes[q]:
            # Up, by the largest powers of two first, as long as the prefixes differ.
            for k in range(len(self.up[p]) - 1, -1, -1):
                if k < len(self.up[p]) and self.hashes[self.up[p][k]] != self.hashes[self.up[q][k]]:
                    p, q = self.up[p][k], self.up[q][k]
            difference = self.letters[p], self.letters[q]
            p, q = self.up[p][0], self.up[q][0]
        else:
            # One is as long as the other, or the longer one goes on.
            more_a = x if self.depths[a] == depth else self.letters[self.ancestor(a, depth + 1)]
            more_b = y if self.depths[b] == depth else self.letters[self.ancestor(b, depth + 1)]
            difference = more_a, more_b
        while p != q:  # equal by hash only: the earliest edit that differs counts
            if self.letters[p] != self.letters[q]:
                difference = self.letters[p], self.letters[q]
            p, q = self.up[p][0], self.up[q][0]
        return difference[0] < difference[1]

    def common(self, nodes: list[int]) -> int:
        """The last node on the way to all of `nodes`."""
        shared = nodes[0]
        for node in nodes[1:]:
            depth = min(self.depths[shared], self.depths[node])
            p, q = self.ancestor(shared, depth), self.ancestor(node, depth)
            if p != q:
                for k in range(len(self.up[p]) - 1, -1, -1):
                    if k < len(self.up[p]) and self.up[p][k] != self.up[q][k]:
                        p, q = self.up[p][k], self.up[q][k]
                p = self.up[p][0]
            shared = p
        return shared

    def path(self, node: int) -> Iterator[tuple[str, int]]:
        """Letters and rows from the settled beginning to `node`."""
        back = []
        while node:
            back.append((self.letters[node], self.rows[node]))
            node = self.up[node][0]
        return reversed(back)

    def rooted(self, root: int, nodes: list[int]) -> tuple[Audits, list[int]]:
        """A tree of only what leads from `root` to `nodes`, and where these are in it."""
        made, places = Audits(self.base, self.modulus), {root: 0}
        for node in nodes:
            way = []
            while node not in places:
                way.append(node)
                node = self.up[node][0]
            for at in reversed(way):
                places[at] = made.add(places[self.up[at][0]], self.letters[at], self.rows[at])
        return made, [places[node] for node in nodes]


class Repair:
    """One conversation: rows in, edits out as soon as they are settled."""

    def __init__(self, settle_nodes: int = SETTLE_NODES, **hashing: int):
        self.audits = Audits(**hashing)
        self.settle_nodes = self.wait = settle_nodes
        self.rows: dict[int, tuple[str, str]] = {}
        self.count, self.given = 0, 0
        self.state = START
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        self.turns = 0
        self.first_turn = self.last_turn = None
        # Cost and node per place in the pattern; None cannot be reached.
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._insert()

    def feed(self, turn: int | None, role: str, text: str, repeated: bool) -> Iterator[tuple]:
        """Takes the next row; `repeated` if its role and text came before. Gives edits: letter, role, text."""
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = role[:1]
        seen = text.rstrip(BLANKS)
        blank = not seen
        duplicate = not blank and repeated
        truncated = not blank and not duplicate and not seen.endswith(ENDS)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        row = self.count
        self.rows[row] = (role, text)
        self.count += 1
        self._row(row, self.initial, blank or duplicate, TRUNCATED_COST * truncated)
        self._insert()
        self._drop_hopeless()
        if len(self.audits) > self.wait:
            yield from self._settle()

    def _row(self, row: int, initial: str, deleted: bool, more: int) -> None:
        options: list[list[tuple]] = [
            [] if known is None else [(known[0] + DELETE_COST, known[1], DELETE)] for known in self.best
        ]
        if not deleted:
            keep = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
            if keep == SYSTEM:
                self._reach(options[SYSTEM], (START,), KEEP, more)
            user, assistant = (KEEP if keep == place else REROLE for place in (USER, ASSISTANT))
            self._reach(options[USER], BEFORE_USER, user, more + REROLE_COST * (user == REROLE))
            self._reach(options[ASSISTANT], (USER,), assistant, more + REROLE_COST * (assistant == REROLE))
        self.best = [self._chosen(own, row) for own in options]

    def _reach(self, options: list, places: tuple, letter: str, cost: int) -> None:
        options += [(self.best[at][0] + cost, self.best[at][1], letter) for at in places if self.best[at] is not None]

    def _chosen(self, options: list[tuple], row: int) -> tuple[int, int] | None:
        if not options:
            return None
        least = options[0]
        for other in options[1:]:
            if other[0] < least[0] or other[0] == least[0] and self.audits.before(other[1], other[2], least[1], least[2]):
                least = other
        return least[0], self.audits.add(least[1], least[2], row)

    def _insert(self) -> None:
        """Places that are reached more cheaply by an empty turn, as are those after it."""
        for place, sources in ((USER, BEFORE_USER), (ASSISTANT, (USER,))):
            options: list[tuple] = []
            self._reach(options, sources, INSERT, INSERT_COST)
            known = self.best[place]
            if known is not None:
                node = known[1]
                cheaper = [
                    o
                    for o in options
                    if o[0] < known[0]
                    or o[0] == known[0]
                    and self.audits.before(o[1], o[2], self.audits.up[node][0], self.audits.letters[node])
                ]
                if not cheaper:
                    continue
                options = cheaper
            self.best[place] = self._chosen(options, -1)

    def _drop_hopeless(self) -> None:
        """Forgets the places whose every continuation is dearer than one after an assistant's turn.

        That place can be gone on from like the start, but for a system turn,
        which it would delete, and like a system turn, but for the end.
        """
        if self.best[ASSISTANT] is None:
            return
        cost = self.best[ASSISTANT][0]
        for place, more in ((START, DELETE_COST), (SYSTEM, 0)):
            if self.best[place] is not None and cost + more < self.best[place][0]:
                self.best[place] = None

    def _settle(self) -> Iterator[tuple]:
        alive = [known[1] for known in self.best if known is not None]
        root = self.audits.common(alive)
        yield from self._given(root)
        self.audits, places = self.audits.rooted(root, alive)
        moved = dict(zip(alive, places))
        self.best = [None if known is None else (known[0], moved[known[1]]) for known in self.best]
        self.wait = max(self.settle_nodes, 2 * len(self.audits))

    def _given(self, node: int) -> Iterator[tuple]:
        for letter, row in self.audits.path(node):
            place = self.state
            role, text = ("", "") if letter == INSERT else self.rows.pop(row)
            if letter == DELETE:
                yield letter, role, text
                continue
            if letter == KEEP:
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            else:
                self.state = ASSISTANT if place == USER else USER
                role = "assistant" if place == USER else "user"
            yield letter, role, text

    def close(self) -> Iterator[tuple]:
        """The edits not given out yet, of the cheapest repair."""
        ways = [self.best[at] for at in (START, ASSISTANT) if self.best[at] is not None]
        least = min(cost for cost, _ in ways)
        nodes = [node for cost, node in ways if cost == least]
        best = nodes[0]
        if len(nodes) > 1 and self.audits.before(nodes[1], "", best, ""):
            best = nodes[1]
        self.cost = least
        yield from self._given(best)

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


_EDITS = (
    "conv_id bigint, at bigint, edit string, role string, text string, "
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)
_NAMES = [part.split()[0] for part in _EDITS.split(", ")]
_TYPES = [pa.string() if part.endswith("string") else pa.int64() for part in _EDITS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, kind) for part, kind in zip(zip(*rows), _TYPES)], names=_NAMES)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; of each conversation one row may say only that it exists."""
    out, chars, key, repair, given = [], 0, None, None, 0

    def summary():
        own = (repair.gaps, repair.blank, repair.duplicate, repair.truncated, repair.illegal, repair.cost)
        return (key, None, None, None, None, *own)

    def edits(found):
        nonlocal given, chars
        for letter, role, text in found:
            out.append((key, given, letter, role, text) + (None,) * 6)
            given, chars = given + 1, chars + len(text)

    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "repeated", "dropped"))
        for conv_id, turn, role, text, repeated, dropped in zip(*columns):
            if repair is None or conv_id != key:
                if repair is not None:
                    edits(repair.close())
                    out.append(summary())
                key, repair, given = conv_id, Repair(), 0
            if not dropped:
                edits(repair.feed(turn, role, text, repeated))
            if len(out) > SEND_ROWS or chars > SEND_CHARS:
                yield _batch(out)
                out, chars = [], 0
    if repair is not None:
        edits(repair.close())
        out.append(summary())
    if out:
        yield _batch(out)


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conv_id`, `turn`, `role`, `text`, `dropped` of rows damaged by a checksum of conversation and turn.

    One in twenty each is dropped (it stays as a row that says so, without role
    and text), emptied, robbed of its full stops, exclamation and question
    marks, repeated, or given to the user. NULL is written as one space in the
    checksum, and becomes one in role and text; a NULL id or turn stays NULL.
    """
    blank = F.lit(" ")
    rows = turns.select(
        col(conv_id).cast("bigint").alias("conv_id"),
        col(turn).cast("bigint").alias("turn"),
        F.coalesce(col(role), blank).alias("role"),
        F.coalesce(col(text), blank).alias("text"),
    )
    written = [F.coalesce(F.col(name).cast("string"), blank) for name in ("conv_id", "turn")]
    hit = rows.withColumn("hit", F.crc32(F.concat(written[0], F.lit(":"), written[1]).cast("binary")) % 20)
    dropped = F.col("hit") == 0
    damaged = hit.select(
        "conv_id",
        "turn",
        F.when(dropped, None).when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(dropped, None)
        .when(F.col("hit") == 1, "")
        .when(F.col("hit") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        dropped.alias("dropped"),
        F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"),
    )
    return damaged.withColumn("times", F.explode("times")).drop("times")


def repair(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    dropped: Column | None = None,
) -> DataFrame:
    """The edits that repair every conversation, in order, and after them a row with its faults and their cost.

    `at` counts the edits of a conversation from 0; `edit` is K (kept), R (given
    another role), D (deleted; its role and text are those it had) or I (an
    inserted empty turn). The row after them has NULL there, and has `gaps`
    between the turn numbers, rows that are `blank`, `duplicate` or `truncated`
    by their first fault, `illegal` pairs of neighbours, and `cost`.

    Rows are taken by turn, NULL first, then by role and text. NULL in role or
    text is one space. Rows with a NULL `conv_id` are one conversation. Rows that
    repeat each other are duplicates. Where `dropped` is true a row only makes
    its conversation known; one without other rows has nothing to repair and
    costs nothing. An empty table gives no rows.

    Each conversation goes by in one task as a stream, sorted by Spark; texts are
    held one batch at a time, and edits until they are settled.
    """
    ship_package(turns.sparkSession)
    blank = F.lit(" ")
    rows = turns.select(
        col(conv_id).cast("bigint").alias("conv_id"),
        col(turn).cast("bigint").alias("turn"),
        F.coalesce(col(role), blank).alias("role"),
        F.coalesce(col(text), blank).alias("text"),
        F.coalesce(F.lit(False) if dropped is None else dropped, F.lit(False)).alias("dropped"),
    )
    # One exchange serves both: rows of one conversation lie together for the
    # repeats, and are then sorted as they follow each other.
    alike = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = rows.repartition("conv_id").withColumn("repeated", F.row_number().over(alike) > 1)
    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    return ordered.mapInArrow(_repaired, _EDITS)


_AUDITS = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def audits(repaired: DataFrame) -> DataFrame:
    """Per conversation its faults, cost, the initials of its edits, and a digest of the repaired turns.

    Takes what `repair` gives as it is: the edits of a conversation in order, then its faults.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, digest, lines = [], hashlib.sha256(), 0
        for batch in batches:
            found = []
            for conv_id, at, edit, role, text, *faults in zip(*(batch.column(name).to_pylist() for name in _NAMES)):
                if edit is None:
                    found.append((conv_id, *faults, "".join(letters), digest.hexdigest()))
                    letters, digest, lines = [], hashlib.sha256(), 0
                    continue
                letters.append(edit)
                if edit != DELETE:
                    digest.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
                    lines += 1
            if found:
                names = [part.split()[0] for part in _AUDITS.split(", ")]
                types = [pa.string() if part.endswith("string") else pa.int64() for part in _AUDITS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(part, kind) for part, kind in zip(zip(*found), types)], names=names)

    return repaired.mapInArrow(run, _AUDITS)
