"""Near duplicates by SuperMinHash signatures, bands, verification and grouping.

Texts become sets of 64-bit shingle hashes; equal sets form one class, told
apart by a 128-bit digest. A signature has `SIZE` slots. Every element visits
the slots in a random order of its own, drawn step by step, and offers each slot
the step's number plus a random fraction; a slot keeps the least offer. Since an
element's offers are ranks of one permutation, slots are correlated in a way that
lowers the variance of the estimate, and once every slot holds an offer of an
earlier step nothing later can win, so few steps are taken.

Slots are cut into bands. Classes with a band in common meet in a shuffle: where
few meet, their pairs are counted, and pairs that share enough bands are put into
one block; where many meet, all of them are. In a block, estimates from whole
signatures leave out what cannot be similar, and what may be is confirmed on
whole sets, joining groups as links are found; classes of one group are not
compared again. What blocks find is joined across blocks.

Bands are as long as they can be for a pair at the threshold to share fewer than
those asked for at most once in 10⁷ times (`MISSED`): for 0.85 and 200 slots they
have five slots, of forty bands three must be shared. Its estimate is off by
the margin of 0.2 less often than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.classes import SEEN_LIMIT, classes_of, digest, groups_of, short, short_column
from tallywright.llm.common import col, ship_package, stored
from tallywright.llm.jaccard import Shingler, _blocks, _mixed
from tallywright.llm.links import components

WORDS = 3
PERCENT = 85
SIZE = 200
MISSED = 1e-7
LEAST_BANDS = 3
FEW = 8
MARGIN = 0.2
BLOCK_SHINGLES = 4_000_000
CHUNK = 1 << 15
# Rows of at most some 40 bytes: the places of classes are sent to all executors up to this many.
SENT_ROWS = 200_000
FILTER_BITS = range(16, 29)

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def signatures(shingles: np.ndarray, owners: np.ndarray, count: int, size: int = SIZE) -> np.ndarray:
    """SuperMinHash of `count` sets (set, slot); `owners` tells whose each shingle is.

    A slot's value is the step in its upper half and the fraction in the lower.
    """
    least = np.full((count, size), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        _offer(least, shingles[at : at + CHUNK], owners[at : at + CHUNK].astype(np.int64))
    return least


def _offer(least: np.ndarray, tokens: np.ndarray, owners: np.ndarray) -> None:
    size = least.shape[1]
    order, flat = None, least.reshape(-1)
    for step in range(size):
        drawn = _mixed(tokens + _U((step + 1) * int(_STEP) % (1 << 64)))
        # The step-th swap of a shuffle of the slots, each element's own.
        swap = (step + (((drawn >> _U(32)) * _U(size - step)) >> _U(32))).astype(np.int64)
        if order is None:
            slots = swap
        else:
            rows = np.arange(len(tokens))
            slots = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[rows, step]
        np.minimum.at(flat, owners * size + slots, _U(step << 32) | (drawn & _U(0xFFFFFFFF)))
        # A set is done once no slot can be won by a later step.
        open_ = least.max(1) >= _U((step + 1) << 32)
        goes_on = open_[owners]
        if not goes_on.any():
            return
        tokens, owners = tokens[goes_on], owners[goes_on]
        if order is None:
            order = np.tile(np.arange(size, dtype=np.int16), (len(tokens), 1))
            order[np.arange(len(tokens)), swap[goes_on]] = 0
        else:
            order = order[goes_on]


def banding(percent: int, size: int = SIZE, missed: float = MISSED) -> tuple[int, int]:
    """Slots per band, and how many bands a pair of classes must share to be compared.

    The longest bands of which a pair at the threshold shares `LEAST_BANDS` or
    more, and then the most shared ones, but for a share of `missed`. Bands of one
    slot and one shared where nothing else will do.
    """
    for slots in range(size, 0, -1):
        count, equal = size // slots, (percent / 100) ** slots
        below, shared = 0.0, 0
        while shared < count and below + (chance := comb(count, shared) * equal**shared * (1 - equal) ** (count - shared)) <= missed:
            below, shared = below + chance, shared + 1
        if shared >= LEAST_BANDS:
            return slots, shared
    return 1, 1


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit digest of every band of every signature (set, band), different bands apart."""
    count, size = signature.shape
    parts = signature[:, : size // rows * rows].reshape(count, -1, rows)
    out = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for at in range(rows):
        out = _mixed(out ^ parts[:, :, at]) * _STEP
    return _mixed(out)


_SCAN = "doc_id bigint, n bigint, fp binary, bands array<bigint>"


def _scan(words: int, size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and identity of each row's set; its bands unless this task gave them for the same set."""
        shingler, seen = Shingler(words), set()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            texts = batch.column("text").cast(pa.large_binary())
            for begin in range(0, len(texts), 256):
                sizes, prints, new, sets = [], [], [], []
                for at, text in enumerate(texts.slice(begin, 256).to_pylist()):
                    found = shingler.shingles(text)
                    sizes.append(len(found))
                    prints.append(digest(found) if len(found) else None)
                    if len(found) and prints[-1] not in seen:
                        if len(seen) >= SEEN_LIMIT:
                            seen.clear()
                        seen.add(prints[-1])
                        new.append(at)
                        sets.append(found)
                given: list = [None] * len(sizes)
                if sets:
                    owners = np.repeat(np.arange(len(sets)), [len(found) for found in sets])
                    banded = bands(signatures(np.concatenate(sets), owners, len(sets), size), rows).view(np.int64)
                    for at, own in zip(new, banded):
                        given[at] = own
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array(given, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "fp", "bands"],
                )

    return run


def _met(bands_shared: int):
    def stars(first: int, rest: np.ndarray):
        return np.full(len(rest), first), rest, np.full(len(rest), bands_shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of classes that share a band, from rows sorted by band and class.

        All pairs of few; of many, each with the first, counted as often as it takes
        to be put together. A run that a batch may not have ended waits for the next.
        """
        tokens, owners = np.empty(0, np.int64), np.empty(0, np.int64)
        long_token, long_first = None, 0
        for batch in (*batches, None):
            if batch is not None:
                tokens = np.concatenate([tokens, batch.column("token").to_numpy()])
                owners = np.concatenate([owners, batch.column("owner").to_numpy()])
            if not len(tokens):
                continue
            again = np.r_[False, (tokens[1:] == tokens[:-1]) & (owners[1:] == owners[:-1])]
            tokens, owners = tokens[~again], owners[~again]
            found = []
            if long_token is not None:
                end = int(np.searchsorted(tokens != long_token, True)) if (tokens != long_token).any() else len(tokens)
                more = owners[:end]
                found.append(stars(long_first, more[more != long_first]))
                tokens, owners = tokens[end:], owners[end:]
                if len(tokens):
                    long_token = None
            begins = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
            lengths = np.diff(np.r_[begins, len(tokens)])
            if batch is not None and len(begins):
                if lengths[-1] > FEW:
                    long_token, long_first = tokens[-1], owners[begins[-1]]
                    found.append(stars(long_first, owners[begins[-1] + 1 :]))
                    keep = len(tokens)
                else:
                    keep = begins[-1]
                begins, lengths = begins[:-1], lengths[:-1]
            else:
                keep = len(tokens)
            for length in range(2, FEW + 1):
                at = begins[lengths == length]
                found += [
                    (owners[at + i], owners[at + j], np.ones(len(at), np.int64)) for i in range(length) for j in range(i + 1, length)
                ]
            for begin, length in zip(begins[lengths > FEW], lengths[lengths > FEW]):
                found.append(stars(owners[begin], owners[begin + 1 : begin + length]))
            tokens, owners = tokens[keep:], owners[keep:]
            if found:
                columns = [np.concatenate(part).astype(np.int64) for part in zip(*found)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["a", "b", "met"])

    return run


def _bit(doc_id: Column, bits: int) -> Column:
    """The filter's bit for a document id."""
    return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - bits)


def _filter(members: DataFrame, bits: int) -> np.ndarray:
    """A bit for every class that is wanted, by the id it is known by."""
    words = members.select(_bit(F.col("least"), bits).alias("bit")).groupBy(
        F.expr("cast(bit div 64 as int)").alias("word")
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for word, own in words.collect():  # at most as many rows as the filter has words
        out[word] = own
    return out


def _wanted_sets(words: int, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sets of the rows by whose id a wanted class may be known."""
        shingler, bits, seen = Shingler(words), np.frombuffer(shipped.value, np.int64), set()
        for batch in batches:
            at = batch.column("bit").to_numpy()
            rows = np.flatnonzero(bits[at >> 6] >> (at & 63) & 1)
            texts = batch.column("text").cast(pa.large_binary())
            for begin in range(0, len(rows), 256):
                new: dict[bytes, bytes] = {}
                for row in rows[begin : begin + 256]:
                    found = shingler.shingles(texts[int(row)].as_py())
                    if len(found) and (fp := digest(found)) not in seen:
                        new[fp] = found.tobytes()
                if len(seen) >= SEEN_LIMIT:
                    seen.clear()
                seen.update(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(map(short, new), pa.int64()),
                        pa.array(new.keys(), pa.binary()),
                        pa.array(new.values(), pa.binary()),
                    ],
                    names=["owner", "fp", "shingles"],
                )

    return run


def links(sets: list[np.ndarray], sides: np.ndarray, percent: int = PERCENT, size: int = SIZE) -> np.ndarray:
    """For each set, the place of the first one of its group; sets of one side (0 or 1) are not compared.

    Sorted by size, a set is compared with those after it that are not too large
    and not in its group yet: by signatures first, then by the sets themselves.
    """
    order = np.argsort([len(found) for found in sets], kind="stable")
    sets, sides = [sets[at] for at in order], np.asarray(sides)[order]
    sizes = np.array([len(found) for found in sets])
    low = np.empty((len(sets), size), np.uint8)
    begin = 0
    while begin < len(sets):  # signatures of some sets at a time
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), CHUNK)))
        owners = np.repeat(np.arange(end - begin), sizes[begin:end])
        low[begin:end] = signatures(np.concatenate(sets[begin:end]), owners, end - begin, size).astype(np.uint8)
        begin = end
    root = np.arange(len(sets))
    enough = (percent / 100 - MARGIN) * size
    for i in range(len(sets)):
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        others = np.arange(i + 1, end)
        may = root[others] != root[i]
        if sides[i] >= 0:
            may &= sides[others] != sides[i]
        others = others[may]
        if len(others):
            others = others[(low[others] == low[i]).sum(1) >= enough]
        for j in others:
            if root[i] != root[j] and _similar(sets[i], sets[j], percent):
                first, other = sorted((root[i], root[j]))
                root[root == other] = first
    place = np.empty(len(sets), np.int64)
    place[order] = order[root]
    return place


def _similar(small: np.ndarray, large: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def _verified(percent: int, size: int):
    def block(rows: dict[bytes, tuple[bytes, int]]) -> Iterator[tuple[bytes, bytes]]:
        prints = sorted(rows)
        sets = [np.frombuffer(rows[fp][0], np.uint64) for fp in prints]
        first = links(sets, [rows[fp][1] for fp in prints], percent, size)
        return ((prints[i], prints[at]) for i, at in enumerate(first) if at != i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each block, whose rows come together and whose size is bounded."""
        key, rows, found = None, {}, []
        for batch in (*batches, None):
            columns = [] if batch is None else [batch.column(name).to_pylist() for name in ("block", "fp", "shingles", "side")]
            for at, fp, shingles, side in zip(*columns):
                if at != key:
                    found += block(rows) if len(rows) > 1 else []
                    key, rows = at, {}
                rows[fp] = (shingles, side)
            if batch is None and len(rows) > 1:
                found += block(rows)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pair[side] for pair in found], pa.binary()) for side in (0, 1)], names=["a", "b"]
                )
                found = []

    return run


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    size: int = SIZE,
    shingles_per_block: int = BLOCK_SHINGLES,
    sent_rows: int = SENT_ROWS,
) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id`, `kept` for every row of `df`.

    Two rows are linked if the intersection of their sets of distinct `words`-word
    shingles is at least `percent` of the union; `component_id` is the smallest id
    reachable. A text without words, or NULL, has no shingles, is linked with
    nothing and is its own component. `kept` is true where the row's id is its
    component's. A row with a NULL id is linked like any other, but never names a
    component that has an id; it is kept if its component has none. Repeated rows,
    and different texts under one id, each give a row. An empty table gives no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    band, bands_shared = banding(percent, size)
    docs = df.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).cast("string").alias("text"))
    scanned = stored(docs.mapInArrow(_scan(words, size, band), _SCAN), "minhash_scan")
    rows = scanned.select("doc_id", "n", "fp")

    classes = classes_of(rows, "minhash_classes")

    # Classes that may be similar, by the bands they share, in blocks.
    banded = scanned.where("bands is not null").select(short_column().alias("owner"), F.explode("bands").alias("token"))
    meetings = banded.repartition("token").sortWithinPartitions("token", "owner")
    counted = meetings.mapInArrow(_met(bands_shared), "a bigint, b bigint, met bigint").groupBy("a", "b").agg(F.sum("met").alias("met"))
    near = components(counted.where(F.col("met") >= bands_shared).select("a", "b"))
    members = stored(near.withColumnRenamed("node", "owner").join(classes, "owner"), "minhash_members")
    whole, split = _blocks(members.select(F.col("owner").alias("fp"), "n", "root").distinct(), percent, shingles_per_block)
    placed = stored(whole.unionAll(split).withColumnRenamed("fp", "owner"), "minhash_places")

    # The wanted classes' whole sets, from the rows by whose id they are known.
    wanted = members.count()
    bits = min(max((16 * wanted).bit_length(), FILTER_BITS[0]), FILTER_BITS[-1])
    shipped = spark.sparkContext.broadcast(_filter(members, bits).tobytes())
    known_by = docs.where("text is not null").select("text", _bit(F.col("doc_id"), bits).alias("bit"))
    sets = known_by.mapInArrow(_wanted_sets(words, shipped), "owner bigint, fp binary, shingles binary")
    places = F.broadcast(placed) if placed.count() <= sent_rows else placed
    dealt = sets.join(places, "owner").repartition("block").sortWithinPartitions("block")
    found = dealt.select("block", "fp", "shingles", "side").mapInArrow(_verified(percent, size), "a binary, b binary")
    pairs = stored(found.distinct(), "minhash_links")

    return groups_of(rows, classes, pairs, "minhash_groups").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
