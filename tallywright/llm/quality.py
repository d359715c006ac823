"""Quality rules in a short-circuit cascade, in DataFrame expressions only.

A rule rejects a document by measures of its text. Rules differ in cost and in
how many documents they reject, so both are estimated on a sample, and the rules
are put in the order of rejections per cost, each counted among what the rules
before it leave. A document meets the next rule only if the one before has let
it pass, and a measure is worked out when the first rule asks for it; it is then
handed on, with what it was made of, to the rules after. The order changes the
time, never the verdict.

Costs are counted, not timed: passes over characters and words, weighted by how
long a pass takes, so that the same table gives the same order in every run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import WORD, col, hidden

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
SAMPLE_ROWS = 2000


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value worked out once per row."""
    return F.transform(F.array(value), then)[0]


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _words(text: Column, measure: Measure) -> Column:
    return F.filter(F.split(_text(text), BLANKS), lambda word: word != "")


def _lines(text: Column, measure: Measure) -> Column:
    return F.filter(F.split(_text(text), "\n"), lambda line: line.rlike(WORD))


def n_words(text: Column, measure: Measure) -> Column:
    return F.size(measure("words")).cast("bigint")


def word_chars(text: Column, measure: Measure) -> Column:
    """Code points in words."""
    return F.length(F.array_join(measure("words"), "")).cast("bigint")


def n_symbols(text: Column, measure: Measure) -> Column:
    return F.regexp_count(_text(text), F.lit(SYMBOLS)).cast("bigint")


def n_lines(text: Column, measure: Measure) -> Column:
    """Lines with a word."""
    return F.size(measure("lines")).cast("bigint")


def n_dup_lines(text: Column, measure: Measure) -> Column:
    """Lines with a word that equal an earlier line."""
    return (F.size(measure("lines")) - F.size(F.array_distinct(measure("lines")))).cast("bigint")


def n_repeat_words(text: Column, measure: Measure) -> Column:
    """Words that lie in a window of eight words which the text has twice or more.

    Windows are compared by 64-bit hashes of their words' 64-bit hashes. Only
    texts with a repeated window pay for the sort that finds their places.
    """
    hashes = F.transform(measure("words"), lambda word: F.xxhash64(word))

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashed) - WINDOW)
        every = F.transform(starts, lambda start: F.xxhash64(*[F.get(hashed, start + i) for i in range(WINDOW)]))
        return F.when(F.size(hashed) > WINDOW, bound(every, repeated)).otherwise(F.lit(0))

    def repeated(every: Column) -> Column:
        by_hash = F.sort_array(F.transform(every, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
        return F.when(F.size(F.array_distinct(every)) < F.size(every), bound(by_hash, places)).otherwise(F.lit(0))

    def places(by_hash: Column) -> Column:
        def has_twin(window: Column, at: Column) -> Column:
            before, after = F.get(by_hash, at - 1)["h"], F.get(by_hash, at + 1)["h"]
            return F.coalesce(before == window["h"], F.lit(False)) | F.coalesce(after == window["h"], F.lit(False))

        found = F.transform(F.filter(by_hash, has_twin), lambda window: window["at"])
        return bound(F.sort_array(found), covered)

    def covered(found: Column) -> Column:
        new_words = F.transform(
            found, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(found, k + 1) - at, F.lit(WINDOW)))
        )
        return F.aggregate(new_words, F.lit(0), lambda total, n: total + n)

    return bound(hashes, windows).cast("bigint")


def n_same_words(text: Column, measure: Measure) -> Column:
    """Words that equal the word before them."""
    words = measure("words")
    return F.size(F.filter(words, lambda word, at: F.coalesce(word == F.get(words, at - 1), F.lit(False)))).cast("bigint")


Measure = Callable[[str], Column]


@dataclass(frozen=True)
class Made:
    """How a measure is made of the text and of other measures, and what that costs per character and per word."""

    of: Callable[[Column, Measure], Column]
    needs: tuple[str, ...]
    per_char: float
    per_word: float


# Costs in passes over the characters of a text by a regular expression.
MEASURES: dict[str, Made] = {
    "words": Made(_words, (), 1.0, 0.5),
    "lines": Made(_lines, (), 0.5, 0.0),
    "n_words": Made(n_words, ("words",), 0.0, 0.01),
    "word_chars": Made(word_chars, ("words",), 0.1, 0.2),
    "n_symbols": Made(n_symbols, (), 1.0, 0.0),
    "n_lines": Made(n_lines, ("lines",), 0.0, 0.01),
    "n_dup_lines": Made(n_dup_lines, ("lines",), 0.2, 0.0),
    "n_repeat_words": Made(n_repeat_words, ("words",), 0.2, 8.0),
    "n_same_words": Made(n_same_words, ("words",), 0.0, 2.0),
}
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a document if `rejects` is true of its measures."""

    name: str
    rejects: Callable[[Measure], Column]

    def asks_for(self) -> list[str]:
        """The measures it looks at, in order."""
        asked: list[str] = []

        def noted(name: str) -> Column:
            asked.append(name)
            return F.lit(1)

        self.rejects(noted)
        return list(dict.fromkeys(asked))


BASE = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_windows", lambda m: m("n_repeat_words") * 100 > m("n_words") * 30),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: m("n_symbols") * 100 > m("n_words") * 10),
    Rule("repeated_lines", lambda m: (m("n_dup_lines") > 2) & (m("n_dup_lines") * 100 > m("n_lines") * 30)),
    Rule("repeated_words", lambda m: m("n_same_words") * 100 > m("n_words") * 30),
    Rule("word_length", lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 15)),
)


def _missing(names: Sequence[str], known: Sequence[str]) -> list[str]:
    """What has to be worked out for these measures, each after what it is made of."""
    out: list[str] = []
    for name in names:
        for own in [*_missing(MEASURES[name].needs, [*known, *out]), name]:
            if own not in known and own not in out:
                out.append(own)
    return out


def measured(text: Column, names: Sequence[str], known: dict[str, Column], then: Callable[[dict[str, Column]], Column]) -> Column:
    """`then` of the known measures and `names`; each that is missing is worked out once per row."""
    missing = _missing(names, list(known))
    if not missing:
        return then(known)
    first = missing[0]
    value = MEASURES[first].of(text, lambda name: known[name])
    return bound(value, lambda own: measured(text, names, {**known, first: own}, then))


def order_rules(df: DataFrame, text: str, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, as estimated on about `sample_rows` documents, picked by a hash of the text.

    A rule costs what it adds to the measures that rules before it have asked for.
    """
    total = df.count()
    if not total:
        return list(rules)
    texts = df.select(col(text).alias("text"))
    if total > sample_rows:
        share = int(sample_rows / total * (1 << 40))
        texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share)

    def verdicts(known: dict[str, Column]) -> Column:
        tests = [F.coalesce(rule.rejects(lambda name: known[name]), F.lit(False)).alias(rule.name) for rule in rules]
        return F.struct(*tests, known["n_words"].alias(hidden("words")))

    names = [*dict.fromkeys(name for rule in rules for name in rule.asks_for()), "n_words"]
    judged = texts.select(
        measured(F.col("text"), names, {}, verdicts).alias("v"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")
    )
    # How many documents each combination of rules rejects; there are few combinations.
    met = [
        (row["n"], row["chars"], row["words"], {rule.name for rule in rules if row[rule.name]})
        for row in judged.groupBy(*[F.col("v")[rule.name].alias(rule.name) for rule in rules])
        .agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum(F.col("v")[hidden("words")]).alias("words"))
        .collect()
    ]
    ordered, left, known = [], list(rules), []

    def gain(rule: Rule) -> float:
        made = [MEASURES[name] for name in _missing(rule.asks_for(), known)]
        cost = sum(m.per_char * chars + m.per_word * words for _, chars, words, _ in met for m in made)
        return sum(n for n, _, _, by in met if rule.name in by) / (cost + 0.01 * sum(n for n, *_ in met) + 1e-9)

    while left:
        best = max(left, key=gain)
        ordered.append(best)
        left.remove(best)
        known += _missing(best.asks_for(), known)
        met = [own for own in met if best.name not in own[3]]
    return ordered


def rejected_by(ordered: Sequence[Rule], text: Column, known: dict[str, Column] | None = None) -> Column:
    """Name of the first rule that rejects, NULL if none does; later rules and their measures are not worked out."""
    if not ordered:
        return F.lit(None).cast("string")
    rule, *others = ordered

    def judged(now: dict[str, Column]) -> Column:
        test = F.coalesce(rule.rejects(lambda name: now[name]), F.lit(False))
        return F.when(test, F.lit(rule.name)).otherwise(rejected_by(others, text, now))

    return measured(text, rule.asks_for(), known or {}, judged)


def keep(df: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    NULL and empty texts have no words and go by the rule on few words. A table
    without rows gives none. Equal rows meet the same verdict.
    """
    ordered = order_rules(df, text, rules)
    return df.where(rejected_by(ordered, col(text)).isNull())


def judge(df: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`df` with the base measures, `base_failed` and `kept`; columns of these names are replaced.

    The measures returned are worked out for every row; those that only rules ask
    for, where a rule is reached that does.
    """
    ordered = order_rules(df, text, rules)

    def verdict(known: dict[str, Column]) -> Column:
        failed = rejected_by(BASE, col(text), known).isNotNull()
        passed = F.when(failed, F.lit(False)).otherwise(rejected_by(ordered, col(text), known).isNull())
        return F.struct(*[known[name].alias(name) for name in RETURNED], failed.alias("base_failed"), passed.alias("kept"))

    found = hidden("verdict")
    judged = df.withColumn(found, measured(col(text), RETURNED, {}, verdict))
    return judged.withColumns({name: F.col(found)[name] for name in (*RETURNED, "base_failed", "kept")}).drop(found)
