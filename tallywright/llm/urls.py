"""URL rules by a cascade of Bloom filters.

A URL is looked up by its candidate keys: each parent domain of its host with
each beginning of its path that is as long as some rule's path. The candidate
keys of the whole corpus are the universe. The first filter holds the listed
keys of the universe; the second the keys that are not listed but pass the
first; the third the listed keys that pass the second; and so on until no key
passes wrongly. For every key of the universe the answer is then exact, with no
join: a key is listed if the first filter it does not pass is an even one.

Each filter is sized by the keys it holds and by the logarithm of how many others
there are for each of them, so that about as many pass wrongly as it holds. All
levels then grow with the lists that are given, and hardly with the corpus. Keys
are represented by 64-bit hashes, dealt anew if a listed and another key of the
universe have the same one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import col, hidden, ship_package, stored

BITS_PER_PROBE = 1.5
LEAST_PROBES = 6


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for NULL."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """Parent domains of the host, itself included, each with the beginnings of the path."""
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda at: F.array_join(F.slice(labels, at, F.size(labels)), ".")
    )
    begins = F.array_compact(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(path_lengths))])
    )
    keys = F.flatten(F.transform(parents, lambda parent: F.transform(begins, lambda begin: F.concat(parent, begin))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Filter:
    """One level: a bitmap of a power of two of bits."""

    level: int
    probes: int
    bits: bytes

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bitmap = np.frombuffer(self.bits, np.uint64)
        hit = np.ones(len(hashes), bool)
        for at in _places(hashes, self.level, self.probes, len(bitmap) * 64):
            hit &= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return hit


def _places(hashes: np.ndarray, level: int, probes: int, size: int):
    """The bits of each key: another mix of its hash on every level and for every probe.

    Two mixes and their multiples would not do: in a small bitmap few pairs of them differ.
    """
    for probe in range(probes):
        seed = np.uint64((0x9E3779B97F4A7C15 * ((level << 8) + probe + 1)) % (1 << 64))
        x = hashes.astype(np.uint64) ^ seed
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (x ^ (x >> np.uint64(32))) & np.uint64(size - 1)


def _bits(level: int, probes: int, size: int):
    def run(batches):
        """The bits of each batch, as words that are not zero."""
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column("h").to_numpy().view(np.uint64)
            places = np.concatenate(list(_places(hashes, level, probes, size)))
            places.sort()
            words, first = np.unique((places >> np.uint64(6)).astype(np.int64), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return run


def _build(keys: DataFrame, count: int, others: int, level: int) -> Filter:
    """A filter of `count` keys that about as many of the `others` pass."""
    probes = max(LEAST_PROBES, (others // count).bit_length())
    size = max(64, 1 << int(BITS_PER_PROBE * probes * count).bit_length())
    parts = keys.mapInArrow(_bits(level, probes, size), "word bigint, bits bigint")
    bitmap = np.zeros(size // 64, np.int64)
    table = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # no more rows than words
    bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return Filter(level, probes, bitmap.tobytes())


def _passing(filter_: Filter):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(filter_.passes(batch.column("h").to_numpy())))

    return run


def build_cascade(universe: DataFrame) -> list[Filter]:
    """Filters that tell the listed keys of `universe` (`h`, `listed`) from all others in it.

    No listed key may have the hash of another. A filter has at most 3 bits for each
    probe and key; the first holds the listed keys, with as many probes as the number
    of others per listed key has bits, and later ones hold about as many.
    """
    ship_package(universe.sparkSession)
    held, rest = universe.where("listed").select("h"), universe.where("not listed").select("h")
    count, others = held.count(), rest.count()
    filters: list[Filter] = []
    while count:
        filters.append(_build(held, count, others, len(filters)))
        passing = stored(rest.mapInArrow(_passing(filters[-1]), "h bigint"), "cascade_level")
        held, rest = passing, held
        count, others = passing.count(), count
    return filters


def listed(filters: Sequence[Filter], hashes: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed."""
    answer, open_ = np.zeros(len(hashes), bool), np.ones(len(hashes), bool)
    for filter_ in filters:
        passed = filter_.passes(hashes)
        answer[open_ & ~passed] = filter_.level % 2 == 1
        open_ &= passed
    answer[open_] = len(filters) % 2 == 1
    return answer


def _lookup(cascade):
    @F.arrow_udf("array<boolean>")
    def look(lists: pa.Array) -> pa.Array:
        answer = listed(cascade.value, lists.values.to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(lists.offsets, pa.array(answer))

    return look


def judge(
    df: DataFrame, url: str, allow: Sequence[str], block: Sequence[str], otherwise: str = "allow"
) -> DataFrame:
    """`df` with `host`, `path`, `rule` and `verdict`.

    A rule is a host and the beginning of a path, and fits the host and its
    subdomains; of those that fit, the longest wins, and of one rule on both
    lists the block. Without a fitting rule `rule` is NULL and the verdict is
    `otherwise`, as for a URL that is NULL or has no `://`. Repeated rows are
    judged alike, an empty table gives no rows, and columns of `df` called like
    the new ones are replaced. The lists are held by the driver, and the filters
    made from them are of their order of size.
    """
    rules = {"allow": sorted(set(allow)), "block": sorted(set(block))}
    lengths = [len(rule) - rule.index("/") for some in rules.values() for rule in some]
    keys, hashes = hidden("keys"), hidden("hashes")
    parsed = df.withColumns({"host": host_of(col(url)), "path": path_of(col(url))}).withColumn(
        keys, candidate_keys(F.col("host"), F.col("path"), lengths)
    )
    universe = stored(parsed.select(F.explode(keys).alias("key")).distinct(), "url_keys")
    best = hidden("best")
    seed = _seed(universe, sorted({rule for some in rules.values() for rule in some}))
    hashed = parsed.withColumn(hashes, F.transform(F.col(keys), lambda key: _hash(key, seed)))
    known = _by_cascade(hashed, universe.withColumn("h", _hash(F.col("key"), seed)), rules, keys, hashes, best)
    hit = F.col(best)
    verdict = F.when(hit.isNull(), otherwise).when(hit["block"], "block").otherwise("allow")
    return known.withColumns({"rule": hit["key"], "verdict": verdict}).drop(best, keys, hashes)


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def _seed(universe: DataFrame, rules: Sequence[str]) -> int:
    """The first by which no rule's hash is that of another key of the universe; nearly always 0."""
    seed = 0
    while True:
        own = _table(universe, rules).select("rule", _hash(F.col("rule"), seed).alias("h"))
        other = universe.join(own, (_hash(F.col("key"), seed) == F.col("h")) & (F.col("key") != F.col("rule")))
        if other.isEmpty():
            return seed
        seed += 1


def _table(parsed: DataFrame, some: Sequence[str]) -> DataFrame:
    return parsed.sparkSession.createDataFrame([(rule,) for rule in some], "rule string")


def _by_cascade(
    parsed: DataFrame, universe: DataFrame, rules: dict[str, list[str]], keys: str, hashes: str, best: str
) -> DataFrame:
    """`parsed` with the longest listed key of each row, looked up in one cascade per list."""
    found = {}
    for name, some in rules.items():
        marked = universe.join(_table(parsed, some), F.col("key") == F.col("rule"), "left").select(
            "h", F.col("rule").isNotNull().alias("listed")
        )
        cascade = build_cascade(stored(marked, "url_universe"))
        found[hidden(name)] = _lookup(parsed.sparkSession.sparkContext.broadcast(cascade))(F.col(hashes))
    allow, block = F.col(hidden("allow")).alias("allow"), F.col(hidden("block")).alias("block")
    hits = F.filter(F.arrays_zip(F.col(keys).alias("key"), allow, block), lambda hit: hit["allow"] | hit["block"])
    ranked = F.transform(hits, lambda hit: _ranked(hit["key"], hit["block"]))
    return parsed.withColumns(found).withColumn(best, F.array_max(ranked)).drop(*found)


def _ranked(key: Column, block: Column) -> Column:
    return F.struct(F.length(key).alias("n"), key.alias("key"), block.alias("block"))
