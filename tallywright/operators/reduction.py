"""Reduction of a table to the rows whose key may occur in another, before anything is shuffled.

The keys of the other side go into a Bloom filter that is built as an ordinary
aggregation. It is cut into blocks of eight 64-bit words; a key sets a few bits
of one word, so a block is one row of eight `bit_or` sums and a lookup touches
one row. The filter is a table of at most `MOST_BLOCKS` rows, some 26 MB, which
is what makes it safe to broadcast whatever the sides' sizes: the reduced side
is filtered in its scan stage. What passes wrongly (about one row in a hundred)
is left to the join that follows, so results do not depend on the filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS_PER_KEY = 16
BITS_SET = 4
MOST_BLOCKS = 1 << 18
_BLOCK, _SLOT, _MASK = "_block", "_slot", "_mask"


def blocks_for(keys: int) -> int | None:
    """Blocks of a filter for so many keys; None if it would be too large to broadcast."""
    blocks = max(1, -(-keys * BITS_PER_KEY // (64 * WORDS)))
    return blocks if blocks <= MOST_BLOCKS else None


def key_count(df: DataFrame, on: Sequence[str]) -> int:
    """About how many different whole keys a table has, within a few percent. Runs one scan without a shuffle of rows."""
    whole = reduce(and_, [F.col(name).isNotNull() for name in on])
    return df.where(whole).agg(F.approx_count_distinct(F.xxhash64(*on), 0.02)).first()[0]


def reduce_to_keys(
    df: DataFrame, keys: DataFrame, on: Sequence[str | tuple[str, str]], expected_keys: int
) -> DataFrame:
    """The rows of `df` whose key is in `keys`, and few others; all columns as they are.

    `on` has pairs of names, in `df` and in `keys`; a row with a NULL in its key
    is left out, as it equals none. `expected_keys` sizes the filter: with more
    keys than expected more rows pass, with fewer the filter is larger than it
    need be. Beyond what may be broadcast, `df` comes back whole but for NULL keys.
    """
    pairs = [(name, name) if isinstance(name, str) else name for name in on]
    left, right = [name for name, _ in pairs], [name for _, name in pairs]
    whole = df.where(reduce(and_, [F.col(name).isNotNull() for name in left]))
    blocks = blocks_for(expected_keys)
    if blocks is None:
        return whole
    # Equal keys must hash alike, so both sides are cast to the type the join would compare them in.
    kinds = df.select(*left).limit(0).unionAll(keys.select(*right).limit(0)).schema
    cast = {name: kind.dataType for name, kind in zip(left, kinds, strict=True)}
    present = keys.where(reduce(and_, [F.col(name).isNotNull() for name in right])).select(
        *_place([F.col(name).cast(cast[own]) for own, name in pairs], blocks)
    )
    words = [f"_word_{i}" for i in range(WORDS)]
    filter_ = present.groupBy(_BLOCK).agg(
        *[F.bit_or(F.when(F.col(_SLOT) == i, F.col(_MASK)).otherwise(F.lit(0))).alias(word) for i, word in enumerate(words)]
    )
    # The rows' own columns are looked up beside the filter's, so they go by other names.
    block, slot, mask = _parts([F.col(name).cast(cast[name]) for name in left], blocks)
    placed = whole.withColumns({f"{_BLOCK}_own": block, f"{_SLOT}_own": slot, f"{_MASK}_own": mask})
    own_mask = F.col(f"{_MASK}_own")
    found = reduce(
        or_,
        [(F.col(f"{_SLOT}_own") == i) & (F.col(word).bitwiseAND(own_mask) == own_mask) for i, word in enumerate(words)],
    )
    passed = placed.join(F.broadcast(filter_), (F.col(f"{_BLOCK}_own") == F.col(_BLOCK)) & found)
    return passed.drop(_BLOCK, *words, *[f"{name}_own" for name in (_BLOCK, _SLOT, _MASK)])


def _place(key: list[Column], blocks: int) -> list[Column]:
    return [part.alias(name) for part, name in zip(_parts(key, blocks), (_BLOCK, _SLOT, _MASK))]


def _parts(key: list[Column], blocks: int) -> tuple[Column, Column, Column]:
    """Block, word within it, and the bits of that word, by two digests of the key."""
    place, bits = F.xxhash64(*key), F.xxhash64(F.lit(1), *key)
    block = F.pmod(place, F.lit(blocks)).cast("int")
    slot = F.shiftrightunsigned(bits, 61).cast("int")
    one = F.lit(1).cast("bigint")
    chosen = [
        F.call_function("shiftleft", one, F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS_SET)
    ]
    return block, slot, reduce(lambda a, b: a.bitwiseOR(b), chosen)
