"""Near duplicates: a join on word n-grams by Jaccard similarity, with signature trees.

Texts become sets of 64-bit shingle hashes; equal sets form one class. Two sets
as similar as asked for share some of their rarest shingles: with all shingles
in one global order, the first `n - need + shared` of each must have `shared` in
common, where `need` is the smallest overlap a set of n can be linked with. Where
few classes have a shingle among their rarest, their pairs are counted, and pairs
that meet in half of `shared` or more are put into one block. Pairs that do not
must share the other half among shingles of many classes, so both sets have that
many of these. Such sets are looked at again, by these shingles and among
themselves, where fewer classes have them; and what is left after some levels is
put together by each shingle. So a shingle taken for rare that is not, as counts
by hash tell less and less the more shingles there are, puts no texts together.
Blocks leave out no link and hold little else.

Within a block the classes are the leaves of a signature tree. A node holds the
OR of their shingle bitmaps, the range of their sizes, and the most shingles
that one of them loses to shared bits. Two nodes are compared at once: what the
bitmaps have in common, plus what may be lost, bounds every overlap below them.
Pairs of nodes that cannot reach the similarity are dropped, as are those whose
classes are linked already; leaves that remain are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.classes import SEEN_LIMIT, classes_of, digest, groups_of, short
from tallywright.llm.common import col, forget, kept_in_worker, new_table_path, release, ship_package, stored, stored_at, tidied
from tallywright.llm.links import components

WORDS = 5
PERCENT = 75
SKETCH_BITS = 21
SKETCH_BLOCK = 1 << 15
# A filter has eight bits or more for each wanted class, up to 32 MB.
FILTER_BITS = range(16, 29)
# Rows of at most some 40 bytes: the places of classes are sent to all executors up to this many.
SENT_ROWS = 200_000
BLOCK_SHINGLES = 4_000_000
MEMO_LIMIT = 200_000
TEXTS = 256
SENT_SHINGLES = 1 << 17
SHARED = 16
FEW = 8
LEVELS = 3
LEAF = 16
FANOUT = 4

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Shingler:
    """Sorted distinct shingle hashes of a text; word hashes are remembered up to a limit."""

    def __init__(self, words: int = WORDS):
        kept_in_worker("shingles")  # whatever else the worker has kept may go
        self.words = words
        self.memo = _WordHashes()

    def shingles(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: ASCII letters and blanks only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.memo) > MEMO_LIMIT:
            self.memo.clear()
        hashes = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        width = min(self.words, len(words))
        count = len(words) - width + 1
        rolled = np.full(count, width, np.uint64)
        for at in range(width):
            rolled = rolled * _U(0x9E3779B97F4A7C15) + hashes[at : at + count]
        return np.unique(_mixed(rolled))


class _WordHashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def need(n: int, percent: int = PERCENT) -> int:
    """Smallest overlap with which a set of n can be linked to any other."""
    return -(-percent * n // 100)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """The texts of a batch, some at a time as Python objects."""
    column = batch.column("text").cast(pa.large_binary())
    for at in range(0, len(column), TEXTS):
        yield from column.slice(at, TEXTS).to_pylist()


_DOCS = "doc_id bigint, tag binary, n bigint, fp binary, part int, counts binary"


def _scan(words: int, sketch_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and identity per row, and at last this task's counts of shingles by hash."""
        shingler = Shingler(words)
        counts = np.zeros(1 << sketch_bits, np.uint32)
        for batch in batches:
            sizes, prints = [], []
            for text in _texts(batch):
                found = shingler.shingles(text)
                np.add.at(counts, (found >> _U(64 - sketch_bits)).astype(np.int64), 1)
                sizes.append(len(found))
                prints.append(digest(found) if len(found) else None)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("tag").cast(pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()),
                    none.cast(pa.int32()),
                    none.cast(pa.binary()),
                ],
                names=["doc_id", "tag", "n", "fp", "part", "counts"],
            )
        counts = np.minimum(counts, 65535).astype(np.uint16)
        for part in range(0, len(counts), SKETCH_BLOCK):
            block = counts[part : part + SKETCH_BLOCK]
            if block.any():
                number, bytes_ = pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [number, bytes_, number, bytes_, pa.array([part // SKETCH_BLOCK], pa.int32()), pa.array([block.tobytes()])],
                    names=["doc_id", "tag", "n", "fp", "part", "counts"],
                )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts added up per part of the sketch; a task holds the parts dealt to it only."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            block = np.frombuffer(counts, np.uint16)
            sums[part] = sums[part] + block if part in sums else block.astype(np.uint64)
    parts = [np.minimum(block, 65535).astype(np.uint16).tobytes() for block in sums.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(sums.keys(), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"]
    )


def shared(n, percent: int = PERCENT, level: int = 0):
    """How many of their rarest shingles a set of n and any larger one it is linked with have in common, at least.

    From level to level: how many of those that many classes have, if `enough` of the others are not shared.
    """
    least = np.minimum(np.maximum(SHARED, n // SHARED), -(-percent * n // 100))
    for _ in range(level):
        least = least // 2 + 1
    return least


def enough(n, percent: int = PERCENT, level: int = 0):
    """In how many shingles of few classes two sets, the smaller of n, have to meet; it is half of those shared."""
    return (shared(n, percent, level) + 1) // 2


def common(n, percent: int = PERCENT, level: int = 0):
    """A set of n with fewer shingles of many classes has `enough` others in common with all it is linked with."""
    return shared(-(-percent * n // 100), percent, level + 1)  # as the smallest set it can be linked with asks for


def _rarest(words: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rarest shingles of each set, about once per task and set."""
        shingler, counts, seen = Shingler(words), np.frombuffer(sketch.value, np.uint16), set()
        shift = _U(65 - len(counts).bit_length())
        tokens, owners, sizes, held = [], [], [], 0
        for batch in batches:
            for text in _texts(batch):
                found = shingler.shingles(text)
                n = len(found)
                if not n or (fp := short(digest(found))) in seen:
                    continue
                if len(seen) >= SEEN_LIMIT:
                    seen.clear()
                seen.add(fp)
                order = np.argsort(counts[(found >> shift).astype(np.int64)], kind="stable")
                first = found[order[: n - need(n, percent) + int(shared(n, percent))]]
                tokens.append(first.view(np.int64))
                owners.append(np.full(len(first), fp, np.int64))
                sizes.append(np.full(len(first), n, np.int32))
                held += len(first)
                if held >= SENT_SHINGLES:
                    yield _rarest_batch(tokens, owners, sizes)
                    tokens, owners, sizes, held = [], [], [], 0
        if tokens:
            yield _rarest_batch(tokens, owners, sizes)

    return run


def _rarest_batch(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in columns], names=["token", "fp", "n"])


_MET = "token bigint, a bigint, b bigint, n bigint, least bigint"


def _meetings(percent: int, level: int):
    def pairs(owners: np.ndarray, sizes: np.ndarray, begins: np.ndarray, lengths: np.ndarray):
        """Pairs of similar size within runs of few: both owners, and how often they have to meet."""
        out = []
        for length in range(2, FEW + 1):
            at = begins[lengths == length]
            for i in range(length):
                for j in range(i + 1, length):
                    n, m = sizes[at + i], sizes[at + j]
                    near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                    out.append((owners[at + i][near], owners[at + j][near], enough(np.minimum(n, m)[near], percent, level)))
        return out

    def batch_of(few: list, many: list) -> pa.RecordBatch:
        a, b, least = (np.concatenate(part) for part in zip(*few)) if few else [np.empty(0, np.int64)] * 3
        token, owner, n = (np.concatenate(part) for part in zip(*many)) if many else [np.empty(0, np.int64)] * 3
        no_pair, no_run = pa.nulls(len(token), pa.int64()), pa.nulls(len(a), pa.int64())
        columns = [(no_run, token), (a, owner), (b, no_pair), (no_run, n), (least, common(n, percent, level))]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(part, pa.int64()) for part in both]) for both in columns],
            names=["token", "a", "b", "n", "least"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token and owner. Pairs of short runs, and the owners of long ones.

        The last run of a batch waits for the next, unless it is long already.
        """
        waiting = [np.empty(0, np.int64)] * 3
        long_token, last_owner = None, None
        for batch in (*batches, None):
            if batch is None:
                tokens, owners, sizes = waiting
            else:
                own = [batch.column(name).to_numpy().astype(np.int64) for name in ("token", "fp", "n")]
                tokens, owners, sizes = (np.concatenate(both) for both in zip(waiting, own))
            few, many = [], []
            if len(tokens):
                repeated = np.r_[
                    tokens[0] == long_token and owners[0] == last_owner, (tokens[1:] == tokens[:-1]) & (owners[1:] == owners[:-1])
                ]
                tokens, owners, sizes = tokens[~repeated], owners[~repeated], sizes[~repeated]
            if len(tokens):
                begins = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
                lengths = np.diff(np.r_[begins, len(tokens)])
                long = (lengths > FEW) | (tokens[begins] == long_token)
                whole = np.ones(len(begins), bool)
                whole[-1] = batch is None or long[-1]
                end = len(tokens) if whole[-1] else begins[-1]
                if long.any():
                    of_long = np.repeat(long, lengths)
                    many.append((tokens[of_long], owners[of_long], sizes[of_long]))
                if long[-1]:
                    long_token, last_owner = tokens[-1], owners[-1]
                few = pairs(owners, sizes, begins[whole & ~long], lengths[whole & ~long])
                waiting = [tokens[end:], owners[end:], sizes[end:]]
            else:
                waiting = [tokens, owners, sizes]
            if few or many:
                yield batch_of(few, many)

    return run


def _stars(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token and size: links owners with the first of their run, which ends where sizes are too far apart."""
        token, size, first = None, 0, 0
        for batch in batches:
            tokens, owners, sizes = (batch.column(name).to_numpy() for name in ("token", "fp", "n"))
            if not len(tokens):
                continue
            before = np.r_[size, sizes[:-1]]
            begins = np.r_[tokens[0] != token, tokens[1:] != tokens[:-1]] | (100 * before < percent * sizes)
            firsts = np.r_[first, owners[begins]][np.cumsum(begins)]
            token, size, first = tokens[-1], sizes[-1], firsts[-1]
            other = owners != firsts
            yield pa.RecordBatch.from_arrays([pa.array(firsts[other]), pa.array(owners[other])], names=["a", "b"])

    return run


def _sets(words: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sets of the classes that may be wanted, about once per task and set."""
        shingler, seen = Shingler(words), set()
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little")
        mask = len(bits) - 1
        for batch in batches:
            sets: dict[bytes, bytes] = {}
            for text in _texts(batch):
                found = shingler.shingles(text)
                if not len(found):
                    continue
                fp = digest(found)
                if bits[short(fp) & mask] and fp not in seen:
                    if len(seen) >= SEEN_LIMIT:
                        seen.clear()
                    seen.add(fp)
                    sets[fp] = found.tobytes()
                if len(sets) == 256:
                    yield _set_batch(sets)
                    sets = {}
            if sets:
                yield _set_batch(sets)

    return run


def _set_batch(sets: dict[bytes, bytes]) -> pa.RecordBatch:
    columns = [pa.array(map(short, sets), pa.int64()), pa.array(sets.keys(), pa.binary()), pa.array(sets.values(), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["fp", "whole_fp", "shingles"])


class SignatureTree:
    """Links between the sets of one block, found by traversing the tree against itself.

    Leaves are sorted by size, then by smallest shingle, which similar sets tend
    to share. A node is a range of leaves.
    """

    def __init__(self, sets: list[np.ndarray], side: list[int], percent: int = PERCENT):
        self.percent = percent
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]).bit_length(), int(sets[i][0]), len(sets[i])))
        self.order = order
        self.sets = [sets[i] for i in order]
        # In a block in two parts only pairs across the parts are compared.
        self.side = np.array([side[i] for i in order])
        self.sizes = np.array([len(s) for s in self.sets])
        self.root = np.arange(len(sets))
        width = 1 << max(8, min(16, int(4 * np.median(self.sizes)).bit_length()))
        self.bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, shingles in zip(self.bits, self.sets):
            at = (shingles & _U(width - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 6, _U(1) << (at & 63).astype(np.uint64))
        self.lost = self.sizes - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.nodes = self._levels()

    def _levels(self) -> dict:
        """Per range of leaves: children, bitmap, smallest and largest size, most lost to shared bits."""
        nodes, level = {}, []
        for low in range(0, len(self.sets), LEAF):
            high = min(low + LEAF, len(self.sets))
            part = slice(low, high)
            key = (low, high)
            nodes[key] = ((), np.bitwise_or.reduce(self.bits[part]), self.sizes[part].min(), self.sizes[part].max(), self.lost[part].max())
            level.append(key)
        while len(level) > 1:
            above = []
            for at in range(0, len(level), FANOUT):
                group = level[at : at + FANOUT]
                key = (group[0][0], group[-1][1])
                if len(group) > 1:
                    parts = [nodes[child] for child in group]
                    nodes[key] = (
                        tuple(group),
                        np.bitwise_or.reduce([p[1] for p in parts]),
                        min(p[2] for p in parts),
                        max(p[3] for p in parts),
                        max(p[4] for p in parts),
                    )
                above.append(key)
            level = above
        self.top = level[0]
        return nodes

    def linked(self) -> np.ndarray:
        """For each set, in the order given, the place of the first set it is linked with."""
        stack = [(self.top, self.top)]
        while stack:
            x, y = stack.pop()
            if not self._possible(x, y):
                continue
            below_x, below_y = self.nodes[x][0], self.nodes[y][0]
            if not below_x and not below_y:
                self._compare(x, y)
            elif x == y:
                pairs = [(a, b) for i, a in enumerate(below_x) for b in below_x[i:]]
                stack += sorted(pairs, key=lambda pair: pair[0] == pair[1])  # a node with itself comes first
            elif not below_y or (below_x and x[1] - x[0] >= y[1] - y[0]):
                stack += [(a, y) for a in below_x]
            else:
                stack += [(x, b) for b in below_y]
        place = np.empty(len(self.sets), np.int64)
        place[self.order] = self.root
        return np.array(self.order)[place]

    def _possible(self, x: tuple, y: tuple) -> bool:
        _, bits_x, least_x, most_x, lost_x = self.nodes[x]
        _, bits_y, least_y, most_y, lost_y = self.nodes[y]
        if 100 * most_x < self.percent * least_y or 100 * most_y < self.percent * least_x:
            return False
        first = self.root[x[0]]
        if (self.root[x[0] : x[1]] == first).all() and (self.root[y[0] : y[1]] == first).all():
            return False
        shared = int(np.bitwise_count(bits_x & bits_y).sum(dtype=np.int64)) + min(lost_x, lost_y)
        return (100 + self.percent) * shared >= self.percent * (least_x + least_y)

    def _compare(self, x: tuple, y: tuple) -> None:
        part = slice(*y)
        for i in range(*x):
            shared = np.bitwise_count(self.bits[i] & self.bits[part]).sum(1, dtype=np.int64)
            shared = np.minimum(shared + np.minimum(self.lost[i], self.lost[part]), np.minimum(self.sizes[i], self.sizes[part]))
            may = (100 + self.percent) * shared >= self.percent * (self.sizes[i] + self.sizes[part])
            if self.side[i] >= 0:
                may &= self.side[part] != self.side[i]
            for j in np.flatnonzero(may) + y[0]:
                if self.root[i] != self.root[j] and self._similar(i, j):
                    low, high = sorted((self.root[i], self.root[j]))
                    self.root[self.root == high] = low

    def _similar(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        overlap = int((b[at] == a).sum())
        return 100 * overlap >= self.percent * (len(a) + len(b) - overlap)


def _links(percent: int):
    def block(rows: dict[bytes, tuple[bytes, int]]) -> Iterator[tuple[bytes, bytes]]:
        prints = sorted(rows)
        sets = [np.frombuffer(rows[fp][0], np.uint64) for fp in prints]
        first = SignatureTree(sets, [rows[fp][1] for fp in prints], percent).linked()
        return ((prints[i], prints[at]) for i, at in enumerate(first) if at != i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, whose size is bounded; each is held once."""
        key, rows, found = None, {}, []
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("block", "whole_fp", "shingles", "side")]
            for at, fp, shingles, side in zip(*columns):
                if at != key:
                    if len(rows) > 1:
                        found += block(rows)
                    key, rows = at, {}
                rows[fp] = (shingles, side)
            if found:
                yield _pair_batch(found)
                found = []
        if len(rows) > 1:
            found += block(rows)
        if found:
            yield _pair_batch(found)

    return run


def _pair_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()) for ends in zip(*pairs)], names=["a", "b"])


def _blocks(members: DataFrame, percent: int, shingles_per_block: int) -> tuple[DataFrame, DataFrame]:
    """The blocks in which to compare a class (`fp`, `n`, `root`): whole ones, and pairs of parts of large ones.

    A block beyond the limit is cut into parts by size class and hash; every part
    is compared with itself and with those of the same and the next size class,
    outside of which no set is similar. Each comparison is a block of its own.
    """
    ratio = 100 / min(percent, PERCENT)  # no two similar sets differ more in size
    weights = members.groupBy("root").agg(F.sum("n").alias("weight"))
    weighed = members.join(weights, "root")
    whole = weighed.where(F.col("weight") <= shingles_per_block).select(
        "fp", F.col("root").cast("string").alias("block"), F.lit(-1).alias("side")
    )
    large = weighed.where(F.col("weight") > shingles_per_block).withColumn(
        "band", F.floor(F.log(F.col("n") + 0.0) / F.log(F.lit(ratio))).cast("int")
    )
    parts = large.groupBy("root", "band").agg(F.ceil(F.sum("n") / shingles_per_block).cast("int").alias("parts"))
    near = parts.alias("p").join(parts.alias("q"), F.expr("p.root = q.root and q.band between p.band - 2 and p.band + 2"))
    tables = near.groupBy(F.col("p.root").alias("root"), F.col("p.band").alias("band")).agg(
        F.first("p.parts").alias("parts"),
        F.array_sort(F.collect_list(F.struct(F.col("q.band").alias("band"), F.col("q.parts").alias("parts")))).alias("near"),
    )
    own = F.struct("band", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    others = F.flatten(
        F.transform(
            "near",
            lambda other: F.transform(
                F.sequence(F.lit(0), other["parts"] - 1), lambda part: F.struct(other["band"].alias("band"), part.alias("part"))
            ),
        )
    )
    split = (
        large.join(tables, ["root", "band"])
        .select("fp", "root", own.alias("own"), F.explode(others).alias("other"))
        .select(
            "fp",
            F.concat_ws(
                ":",
                F.col("root").cast("string"),
                F.to_json(F.least("own", "other")),
                F.to_json(F.greatest("own", "other")),
            ).alias("block"),
            F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") < F.col("other")).cast("int")).alias("side"),
        )
    )
    return whole, split


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    shingles_per_block: int = BLOCK_SHINGLES,
    sent_rows: int = SENT_ROWS,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` for every row of `df`.

    Two rows are linked if the intersection of their shingle sets is at least
    `percent` of the union; the component is the smallest id reachable. A text
    without words, or NULL, has no shingles, is linked with nothing and is its
    own component. A row with a NULL id is linked like any other, but never
    names a component that has an id. Repeated rows each give a row. An empty
    table gives no rows. Sets are told apart by a 128-bit digest.
    """
    found = groups(df, doc_id, text, None, words, percent, shingles_per_block, sent_rows, sketch_bits)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def groups(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tag: str | None = None,
    words: int = WORDS,
    percent: int = PERCENT,
    shingles_per_block: int = BLOCK_SHINGLES,
    sent_rows: int = SENT_ROWS,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """The same with all that is known: `doc_id`, `tag`, `n`, `fp`, `component_id`, `root`, `first` for every row.

    `tag` is a binary column of `df` that goes along, by which rows may be found
    again; `fp` is the identity of the set, NULL without words. `root` tells
    components apart where ids cannot; `first` is true in rows of the class that a
    component is named after.
    """
    spark = df.sparkSession
    ship_package(spark)
    tags = F.lit(None).cast("binary") if tag is None else col(tag)
    docs = df.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"), tags.alias("tag"))
    texts = docs.select("text")
    scanned = stored(docs.mapInArrow(tidied(_scan(words, sketch_bits)), _DOCS), "shingle_scan")
    rows = scanned.where("part is null").select("doc_id", "tag", "n", "fp")

    # How often the shingles of each hash range occur: a table of fixed size.
    summed = scanned.where("part is not null").select("part", "counts").repartition("part")
    sketch = np.zeros(1 << sketch_bits, np.uint16)
    for row in summed.mapInArrow(tidied(_added), "part int, counts binary").collect():
        at = row["part"] * SKETCH_BLOCK
        sketch[at : at + SKETCH_BLOCK] = np.frombuffer(row["counts"], np.uint16)
    counts = spark.sparkContext.broadcast(sketch.tobytes())

    # The meetings of all sets, then of those with many common shingles in these
    # alone, and so on; sets of which that is still true are linked by each of them.
    met_rows = texts.mapInArrow(tidied(_rarest(words, percent, counts)), "token bigint, fp bigint, n int")
    links, paths = [], []
    for level in range(LEVELS):
        dealt = met_rows.repartition("token").sortWithinPartitions("token", "fp")
        paths.append(new_table_path(spark, "shingle_meetings"))
        met = stored_at(dealt.mapInArrow(tidied(_meetings(percent, level)), _MET), paths[-1])
        release(spark)
        pairs = met.where("token is null").groupBy("a", "b").agg(F.min("least").alias("least"), F.count("*").alias("met"))
        links.append(pairs.where("met >= least").select("a", "b"))
        many = met.where("token is not null").select("token", F.col("a").alias("fp"), F.col("n").cast("int"), "least")
        commons = many.groupBy("fp").agg(F.min("least").alias("least"), F.count("*").alias("met")).where("met >= least")
        met_rows = many.drop("least").join(commons, "fp", "left_semi")
    runs = met_rows.repartition("token").sortWithinPartitions("token", "n", "fp")
    links.append(runs.select("token", "fp", "n").mapInArrow(tidied(_stars(percent)), "a bigint, b bigint"))
    blocks = components(reduce(DataFrame.unionAll, links))
    for path in paths:
        forget(spark, path)
    release(spark)

    classes = classes_of(rows, "shingle_classes")
    # By the first half of their identity; two classes that share it share a place.
    sizes = classes.select(F.col("owner").alias("fp"), "n")
    members = stored(blocks.select(F.col("node").alias("fp"), "root").join(sizes, "fp"), "block_members")
    bits = min(max((8 * members.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[-1])
    words_of_filter = members.select(F.col("fp").bitwiseAND(F.lit((1 << bits) - 1)).alias("bit")).groupBy(
        F.expr("cast(bit div 64 as int)").alias("word")
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    wanted = np.zeros(1 << (bits - 6), np.int64)
    for row in words_of_filter.collect():  # at most as many rows as the filter has words
        wanted[row["word"]] = row["bits"]
    shipped = spark.sparkContext.broadcast(wanted.tobytes())

    whole, split = _blocks(members, percent, shingles_per_block)
    placed = stored(whole.unionAll(split).distinct(), "block_places")
    # Sets are dealt once, to their blocks, where the places are few enough to be
    # sent to all; else they first meet their places.
    places = F.broadcast(placed) if placed.count() <= sent_rows else placed
    sets = texts.mapInArrow(tidied(_sets(words, shipped)), "fp bigint, whole_fp binary, shingles binary")
    dealt = sets.join(places, "fp").repartition("block").sortWithinPartitions("block")
    pairs = stored(
        dealt.select("block", "whole_fp", "shingles", "side").mapInArrow(tidied(_links(percent)), "a binary, b binary"), "set_links"
    )
    release(spark)
    return groups_of(rows, classes, pairs.distinct(), "shingle_groups")
