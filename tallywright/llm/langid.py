"""Language identification by multilingual mixture inference.

Each language has probabilities of letter n-grams within words. A document is
taken for a mixture: every word was drawn from one of the languages, in unknown
proportions. Expectation-maximisation estimates the proportions. Starting with
all languages, those without a proportion and then the one with the smallest are
left out step by step, and of these sets the one with the best likelihood less a
penalty per language is chosen. The answer is the language with the largest
proportion in that set, and the proportion is its score.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import col, kept_in_worker, ship_package, tidied

UNKNOWN = "und"
TRAINING_ROWS = 20_000
BUCKET_BITS = 15
SMOOTHING = 0.5
TOLERANCE = 1e-3
STEPS = 200
GONE = 1e-6
PENALTY = 6.0
FLOOR = np.float32(-50)
CHARS = 400_000
TEXTS = 1024


class _Letters:
    """Which code points are letters; worked out once per process."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, codes: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
        return cls.table[codes]


def _bucket(order: int, *codes: np.ndarray) -> np.ndarray:
    mixed = np.full(len(codes[0]), order, np.uint32)
    for code in codes:
        mixed = (mixed ^ code) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return mixed >> np.uint32(32 - BUCKET_BITS)


def grams(text: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each letter three buckets, of itself, with the one before, and with both neighbours; where words
    begin among the letters; and where in the text.

    Letters are lower-cased; whatever else there is ends a word, and all of it counts as the same.
    """
    codes = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    letter = _Letters.of(codes)
    codes = np.where(letter, codes, np.uint32(32))
    at = np.flatnonzero(letter)
    here, before = codes[at], codes[at - 1]
    buckets = [_bucket(1, here), _bucket(2, before, here), _bucket(3, before, here, codes[at + 1])]
    begins = np.flatnonzero(~letter[at - 1])
    return buckets, begins, at[begins] - 1


def _joined(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Lower-cased texts in strings of bounded length, with their places and where each begins; long ones in parts."""
    held, places, size = [], [], 0
    for place, text in enumerate(texts):
        text = text.lower() if text else ""
        while text:
            end = len(text)
            if end > CHARS:  # at the last blank, if there is one
                end = max(text.rfind(" ", 0, CHARS), text.rfind("\n", 0, CHARS)) + 1 or CHARS
            held.append(text[:end])
            places.append(place)
            size += end + 1
            text = text[end:]
            if size >= CHARS:
                yield _join(held, places)
                held, places, size = [], [], 0
    if held:
        yield _join(held, places)


def _join(held: list[str], places: list[int]) -> tuple[str, np.ndarray, np.ndarray]:
    begins = np.cumsum([0, *[len(part) + 1 for part in held[:-1]]])
    return "\n".join(held), np.array(places), begins


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams per language in this task's training texts."""
    kept_in_worker("langid")  # whatever else the worker has kept may go
    counts: dict[str, np.ndarray] = {}
    for batch in (part.slice(at, TEXTS) for part in batches for at in range(0, len(part), TEXTS)):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            table = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            for text, _, _ in _joined([texts[at] for at in np.flatnonzero(langs == lang)]):
                for buckets in grams(text)[0]:
                    table += np.bincount(buckets, minlength=1 << BUCKET_BITS)
    yield _tables(counts)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist()):
            counts[lang] = counts.get(lang, 0) + np.frombuffer(raw, np.int64)
    yield _tables(counts)


def _tables(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array([t.tobytes() for t in counts.values()], pa.binary())],
        names=["lang", "counts"],
    )


@dataclass(frozen=True)
class Model:
    """Languages in order, and log probabilities of n-gram buckets, one column per language."""

    languages: tuple[str, ...]
    log_probability: np.ndarray


def equal_parts(sizes: Sequence[int], total: int) -> list[float]:
    """What each takes of `total`: all of the smaller ones, and of the larger ones as much as is equal."""
    parts, left = [0.0] * len(sizes), float(total)
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    for done, at in enumerate(order):
        parts[at] = min(sizes[at], left / (len(order) - done))
        left -= parts[at]
    return parts


def fit(
    df: DataFrame, text: str, lang: str, training_rows: int = TRAINING_ROWS, key: Sequence[str] = ()
) -> Model:
    """A model from about `training_rows` rows that have a text and a language, as many of each language.

    Every language that any row has is learned: each gives an equal part of the
    rows, and all of them where it has fewer. Rows are picked by a hash of the
    text and of the columns in `key`, which tell rows with equal texts apart; rows
    alike in all of that are picked together. The model has a fixed number of
    figures per language. Without any such row it knows no language.
    """
    ship_package(df.sparkSession)
    draw = F.pmod(F.xxhash64(F.lit("training"), col(text), *[col(name) for name in key]), F.lit(1 << 30))
    rows = df.select(col(text).alias("text"), col(lang).alias("lang"), draw.alias("draw"))
    rows = rows.where("text is not null and lang is not null")
    # A row per language: how many rows it has, and the first that would be picked.
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")).collect()
    if sum(row["n"] for row in known) > training_rows:
        limits = [
            (row["lang"], max(row["first"], min(1 << 30, int(part / row["n"] * (1 << 30)))))
            for row, part in zip(known, equal_parts([row["n"] for row in known], training_rows))
        ]
        limited = df.sparkSession.createDataFrame(limits, "lang string, most bigint")
        rows = rows.join(F.broadcast(limited), "lang").where("draw <= most").select("text", "lang")
    else:
        rows = rows.select("text", "lang")
    schema = "lang string, counts binary"
    counted = rows.mapInArrow(tidied(_count), schema).repartition("lang").mapInArrow(tidied(_add), schema)
    tables = {row["lang"]: np.frombuffer(row["counts"], np.int64) for row in counted.collect()}  # one per language
    languages = tuple(sorted(tables))
    if not languages:
        return Model((), np.zeros((1 << BUCKET_BITS, 0), np.float32))
    counts = np.stack([tables[name] for name in languages], axis=1) + SMOOTHING
    return Model(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def word_likelihoods(model: Model, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of texts, ascending, and the log likelihood of each of their words in every language."""
    for text, places, begins in _joined(texts):
        buckets, words, at = grams(text)
        if len(words):
            table = model.log_probability
            letters = table[buckets[0]]
            letters += table[buckets[1]]
            letters += table[buckets[2]]
            yield places[np.searchsorted(begins, at, "right") - 1], np.add.reduceat(letters, words, axis=0)


def infer(likelihood: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most frequent language and its proportion, per document.

    `likelihood` has a row per word and a column per language, as logarithms; a
    document's words follow each other, and `lengths`, none of them 0, are their
    numbers.
    """
    languages, docs = likelihood.shape[1], len(lengths)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    single = np.add.reduceat(likelihood, starts, axis=0, dtype=np.float64).T
    best = single.argmax(0)
    found, share = best.copy(), np.ones(docs)
    if languages == 1:
        return found, share
    top = likelihood.max(1)
    # A row per language from here on. The floor keeps every word possible in every language.
    ratio = np.exp(np.maximum(likelihood - top[:, None], FLOOR).T)
    base = np.add.reduceat(top, starts, dtype=np.float64)
    allowed = np.ones((languages, docs), bool)
    whole, value = _mixture(ratio, starts, lengths, allowed)
    # The whole set fits best before the penalty. If it is not better than one
    # language by the penalty for a second, no other set is.
    open_ = np.flatnonzero(base + value - single[best, np.arange(docs)] > PENALTY)
    if len(open_):
        part = np.isin(np.repeat(np.arange(docs), lengths), open_)
        found[open_], share[open_] = _best_set(
            ratio[:, part], base[open_], lengths[open_], allowed[:, open_], whole[:, open_], value[open_]
        )
    return found, share


def _mixture(ratio, starts, lengths, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages by expectation-maximisation, and the log likelihood they give.

    A document is done when a step gains less than `TOLERANCE`, whatever the others need.
    """
    docs = len(lengths)
    share = allowed / allowed.sum(0)
    value = np.empty(docs)
    open_, last = np.arange(docs), np.full(docs, -np.inf)
    for step in range(STEPS + 1):
        weighed = ratio * np.repeat(share[:, open_].astype(np.float32), lengths, axis=1)
        total = weighed.sum(0)
        value[open_] = np.add.reduceat(np.log(total), starts, dtype=np.float64)
        more = (value[open_] - last >= TOLERANCE) & (allowed[:, open_].sum(0) > 1)
        if step == STEPS or not more.any():
            break
        new = np.add.reduceat(weighed / total, starts, axis=1, dtype=np.float64) / lengths
        new = np.where(allowed[:, open_], np.maximum(new, 1e-12), 0)
        share[:, open_[more]] = (new / new.sum(0))[:, more]
        last = value[open_]
        if not more.all():
            words = np.repeat(more, lengths)
            ratio, open_, lengths, last = ratio[:, words], open_[more], lengths[more], last[more]
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return share, value


def _best_set(ratio, base, lengths, allowed, share, value) -> tuple[np.ndarray, np.ndarray]:
    """Leaves out the language with the smallest proportion, step by step, and keeps the best set.

    Languages whose proportion has gone to nothing are left out all at once.
    """
    docs = np.arange(len(lengths))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    best_value, best_share = base + value - PENALTY * allowed.sum(0), share
    allowed = allowed.copy()
    while (allowed.sum(0) > 1).any():
        smallest = np.where(allowed, share, np.inf).argmin(0)
        several = allowed.sum(0) > 1
        allowed[smallest[several], docs[several]] = False
        allowed &= (share > GONE) | ~several
        share, value = _mixture(ratio, starts, lengths, allowed)
        penalised = base + value - PENALTY * allowed.sum(0)
        better = penalised >= best_value
        best_value = np.where(better, penalised, best_value)
        best_share = np.where(better, share, best_share)
    found = best_share.argmax(0)
    return found, best_share[found, docs]


def _classify(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Languages and scores, worked out for many documents at a time."""
    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        owners = np.concatenate([owner for owner, _ in parts])
        places, lengths = np.unique(owners, return_counts=True)
        found, share = infer(np.concatenate([likelihood for _, likelihood in parts]), lengths)
        for place, lang, score in zip(places.tolist(), found.tolist(), share.tolist()):
            languages[place], scores[place] = model.languages[lang], min(1.0, score)

    if not model.languages:
        return languages, scores
    for owners, likelihood in word_likelihoods(model, texts):
        # The last text may go on in the next part.
        last = np.searchsorted(owners, owners[-1])
        if last:
            flush([*held, (owners[:last], likelihood[:last])])
            held = []
        elif held and held[-1][0][-1] != owners[0]:
            flush(held)
            held = []
        held.append((owners[last:], likelihood[last:]))
    if held:
        flush(held)
    return languages, scores


def predict(df: DataFrame, text: str, model: Model, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """`df` with the predicted language and the share of the text's words that is in it.

    A text that is NULL or has no letter is `und`, with a score of 0, and so is
    every text if the model knows no language. Of equally frequent languages
    the first by name is taken. Other columns are kept; those called like the
    new ones are replaced. The model is broadcast: its size depends on the number
    of languages only.
    """
    ship_package(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast((model.languages, model.log_probability))

    def judged(texts: pa.Array) -> pa.Array:
        languages, scores = [], []
        for at in range(0, len(texts), TEXTS):
            found = _classify(Model(*shipped.value), texts.slice(at, TEXTS).to_pylist())
            languages += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays(
            [pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"]
        )

    @F.arrow_udf("struct<lang: string, score: double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept_in_worker("langid")  # whatever else the worker has kept may go
        yield from tidied(lambda parts: map(judged, parts))(batches)

    both = guess(col(text))
    kept = [col(name) for name in df.columns if name not in (lang_as, score_as)]
    return df.select(*kept, both.alias("__tw_guess")).select(
        *kept, F.col("__tw_guess.lang").alias(lang_as), F.col("__tw_guess.score").alias(score_as)
    )


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: those whose id's crc32, modulo 4, is 2; NULL ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
