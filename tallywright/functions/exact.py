"""Sums and means of doubles that do not depend on the order of the rows.

A double is a whole number of at most 53 bits times a power of two. It is cut at
multiples of 32 bits into three whole numbers, and its bin is the place of the
highest. Rows are summed per key and bin in whole decimals, which is exact in any
order and combined on the map side; at most `MOST_BINS` rows per key and measure
are left. These are merged by carrying from digit to digit in base 2**32, divided
by the number of rows digit by digit, and rounded once, at the end.

All of it is built-in expressions. Sums stay exact up to 10**18 rows per key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.semantics import WHOLE, data_type, shifted

DIGIT = 32
# From the lowest bit of the smallest double (2**-1074) to the highest of the largest (2**1023).
MOST_BINS = 67
# Smaller doubles are multiplied up before they are cut, so that no power of two leaves the range.
SMALL = 2.0**-500
LIFTED = 19
# Bin of the largest doubles.
HIGHEST = 31
# Digits a mean is worked out to below the sum's own: three for the divisor, three for 53 bits and what follows.
BELOW = 6
# Digits above the highest bin that sums can carry into.
ABOVE = 3

PARTS = ("high", "middle", "low")
FLAGS = ("nan", "plus", "minus")
_MERGED = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def is_binary(df: DataFrame, name: str) -> bool:
    """Whether a column holds binary fractions, whose plain sums depend on the order."""
    return isinstance(data_type(df, name), T.DoubleType | T.FloatType)


def exact_aggregate(
    df: DataFrame,
    keys: Mapping[str, Column],
    doubles: Mapping[str, Column],
    plain: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """One row per combination of `keys`, with a total of each double and plain aggregates.

    `plain` names a kind (count, sum, min, max) and what it is taken of; sums must be
    of integers or decimals. A total is a struct for `exact_mean`.
    """
    kinds = {name: kind for name, (kind, _) in plain.items()}
    return merge_bins(sum_by_bins(df, keys, doubles, plain), list(keys), list(doubles), kinds)


def sum_by_bins(
    df: DataFrame,
    keys: Mapping[str, Column],
    doubles: Mapping[str, Column],
    plain: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """The first step of `exact_aggregate`: a row per key, measure (`slot`) and bin.

    Keys are called `k_…` and plain aggregates, which the slot 0 carries, `p_…`.
    """
    measured = [F.lit(None), *doubles.values()]
    slots = [F.struct(F.lit(at).alias("slot"), value.cast("double").alias("x")) for at, value in enumerate(measured)]
    rows = df.select(
        *[value.alias(f"k_{name}") for name, value in keys.items()],
        *[value.alias(f"p_{name}") for name, (_, value) in plain.items()],
        F.inline(F.array(*slots)),
    )
    return _cut(rows).groupBy(*[f"k_{name}" for name in keys], "slot", "bin").agg(
        *[
            _PARTIAL[kind](F.when(F.col("slot") == 0, F.col(f"p_{name}"))).alias(f"p_{name}")
            for name, (kind, _) in plain.items()
        ],
        F.count("x").alias("n"),
        *[F.sum(part).cast(WHOLE).alias(part) for part in PARTS],
        F.max(F.isnan("x").cast("int")).alias("nan"),
        F.max((F.col("x") == float("inf")).cast("int")).alias("plus"),
        F.max((F.col("x") == float("-inf")).cast("int")).alias("minus"),
    )


def merge_bins(bins: DataFrame, keys: Sequence[str], doubles: Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    """The second step: the bins of each key put together; `MOST_BINS` per measure at most, so lists are short."""

    def total(slot: int) -> Column:
        own = F.col("slot") == slot
        part = F.when(own & F.col("bin").isNotNull(), F.struct("bin", *PARTS))
        flags = [F.max(F.when(own, F.col(flag))).alias(flag) for flag in FLAGS]
        return F.struct(F.sum(F.when(own, F.col("n"))).alias("n"), F.collect_list(part).alias("parts"), *flags)

    merged = bins.groupBy(*[f"k_{name}" for name in keys]).agg(
        *[_MERGED[kind](f"p_{name}").alias(f"p_{name}") for name, kind in kinds.items()],
        *[total(slot).alias(f"d_{name}") for slot, name in enumerate(doubles, 1)],
    )
    return merged.select(
        *[F.col(f"k_{name}").alias(name) for name in keys],
        *[
            (F.coalesce(f"p_{name}", F.lit(0)) if kind == "count" else F.col(f"p_{name}")).alias(name)
            for name, kind in kinds.items()
        ],
        *[F.col(f"d_{name}").alias(name) for name in doubles],
    )


def _cut(rows: DataFrame) -> DataFrame:
    """`rows` with the bin of `x` and its three whole parts; NULL for zero and what is not finite."""
    size = F.abs("x")
    lifted = size < SMALL
    finite = (size > 0) & (size < float("inf"))
    scaled = F.when(finite, F.when(lifted, size * 2.0 ** (DIGIT * LIFTED)).otherwise(size))
    cut = rows.withColumn("size", scaled).withColumn(
        # Near a power of two the logarithm may be one off, which the three parts allow.
        "at", F.least(F.floor(F.log2("size") / DIGIT).cast("int"), F.lit(HIGHEST))
    )
    powers = F.array(*[F.lit(2.0 ** (DIGIT * at)) for at in range(-HIGHEST, HIGHEST + 1)])

    def power(digits: Column) -> Column:
        return F.get(powers, digits + HIGHEST)

    # Products with powers of two are exact, and so are these differences: they drop leading bits.
    for part, before, below in (("high", "size", 0), ("middle", "rest_high", 1), ("low", "rest_middle", 2)):
        at = F.col("at") - below
        cut = cut.withColumn(part, F.floor(F.col(before) * power(-at)))
        cut = cut.withColumn(f"rest_{part}", F.col(before) - F.col(part).cast("double") * power(at))
    signed = {part: (F.col(part) * F.when(F.col("x") < 0, -1).otherwise(1)).cast("decimal(18,0)") for part in PARTS}
    return cut.withColumns({"bin": F.col("at") - F.when(lifted, LIFTED).otherwise(0), **signed})


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def _whole(number: int) -> Column:
    return F.lit(Decimal(number)).cast(WHOLE)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact_mean(total: Column, scale: int | None = None) -> Column:
    """The mean of a total's values as the nearest double, or rounded half away from zero to `scale` digits first.

    NULL without values. Infinities and NaN give what adding them gives. A zero is
    positive. Means from 2**96 / 10**scale on have no digits to round and stay.
    """

    def of(total: Column) -> Column:
        mean = _let(_quotient(total, 1), _nearest)
        if scale is not None:
            mean = _let(_quotient(total, 10**scale), lambda q: F.coalesce(_rounded(q, scale), mean))
        return (
            F.when(F.coalesce(total["n"], F.lit(0)) == 0, F.lit(None).cast("double"))
            .when((total["nan"] == 1) | ((total["plus"] == 1) & (total["minus"] == 1)), F.lit(float("nan")))
            .when(total["plus"] == 1, F.lit(float("inf")))
            .when(total["minus"] == 1, F.lit(float("-inf")))
            .when(F.size(total["parts"]) == 0, F.lit(0.0))
            .otherwise(mean)
        )

    return _let(total, of)


def _quotient(total: Column, times: int) -> Column:
    """`times` the sum over the number of rows: sign, digits from the highest on, place of the first, and whether more follow."""
    parts = total["parts"]
    first = F.array_min(F.transform(parts, lambda part: part["bin"])) - 2
    last = F.array_max(F.transform(parts, lambda part: part["bin"])) + ABOVE

    def digit(at: Column) -> Column:
        def add(so_far: Column, part: Column) -> Column:
            below = part["bin"] - at
            here = F.when(below == 0, part["high"]).when(below == 1, part["middle"]).when(below == 2, part["low"])
            return (so_far + F.coalesce(here, _whole(0))).cast(WHOLE)

        return (F.aggregate(parts, _whole(0), add) * _whole(times)).cast(WHOLE)

    def with_sign(digits: Column) -> Column:
        return _let(_carried(digits), lambda up: F.struct((up["carry"] < 0).alias("negative"), digits.alias("digits"), up["out"].alias("out")))

    def divided(signed: Column) -> Column:
        opposite = _carried(F.transform(signed["digits"], lambda d: (-d).cast(WHOLE)))["out"]
        size = F.when(signed["negative"], opposite).otherwise(signed["out"])
        from_top = F.concat(F.reverse(size), F.array_repeat(_whole(0), BELOW))
        by = total["n"].cast(WHOLE)

        def step(so_far: Column, d: Column) -> Column:
            def split(whole: Column) -> Column:
                rest = (whole % by).cast(WHOLE)
                return F.struct(rest.alias("rest"), F.concat(so_far["out"], F.array(((whole - rest) / by).cast(WHOLE))).alias("out"))

            return _let((so_far["rest"] * _whole(2**DIGIT) + d).cast(WHOLE), split)

        start = F.struct(_whole(0).alias("rest"), F.array().cast(f"array<{WHOLE}>").alias("out"))
        return _let(
            F.aggregate(from_top, start, step),
            lambda q: F.struct(
                signed["negative"].alias("negative"), q["out"].alias("digits"), last.alias("top"), (q["rest"] > 0).alias("more")
            ),
        )

    return _let(_let(F.transform(F.sequence(first, last), digit), with_sign), divided)


def _carried(digits: Column) -> Column:
    """Digits from the lowest on, brought into 0 to 2**32 - 1, and what is carried out at the top."""

    def step(so_far: Column, d: Column) -> Column:
        def split(whole: Column) -> Column:
            low = F.pmod(whole, _whole(2**DIGIT)).cast(WHOLE)
            carry = ((whole - low) / _whole(2**DIGIT)).cast(WHOLE)
            return F.struct(carry.alias("carry"), F.concat(so_far["out"], F.array(low)).alias("out"))

        return _let((so_far["carry"] + d).cast(WHOLE), split)

    return F.aggregate(digits, F.struct(_whole(0).alias("carry"), F.array().cast(f"array<{WHOLE}>").alias("out")), step)


def _digit_at(q: Column, place: Column) -> Column:
    index = q["top"] - place
    return F.when(index >= 0, F.coalesce(F.get(q["digits"], index), _whole(0))).otherwise(_whole(0))


def _three(q: Column, place: Column) -> Column:
    """The digits at `place` and the two below it as one number."""
    high, middle = _digit_at(q, place) * _whole(2 ** (2 * DIGIT)), _digit_at(q, place - 1) * _whole(2**DIGIT)
    return (high + middle + _digit_at(q, place - 2)).cast(WHOLE)


def _rounded(q: Column, scale: int) -> Column:
    """A quotient of `10**scale` times the sum, as a double of `scale` digits; NULL from 2**96 on."""
    beyond = F.exists(F.slice(q["digits"], 1, F.greatest(q["top"] - 2, F.lit(0))), lambda d: d > 0)
    up = _digit_at(q, F.lit(-1)) >= _whole(2 ** (DIGIT - 1))
    number = (_three(q, F.lit(2)) + up.cast("int")).cast(WHOLE)
    value = shifted(number, scale).cast("double")
    return F.when(~beyond, F.when(q["negative"] & (number > 0), -value).otherwise(value))


def _nearest(q: Column) -> Column:
    """The double nearest to a quotient; halves go to the even one."""
    powers = F.array(*[_whole(2**at) for at in range(111)])

    def at_top(top: Column) -> Column:
        place = q["top"] - (top - 1)
        unit = DIGIT * (place - 2)
        bits = F.length(F.bin(_digit_at(q, place).cast("bigint")))
        # Bits to leave out: all but 53, more for doubles whose last bit would be below 2**-1074.
        drop = F.least(F.lit(110), F.greatest(bits + (2 * DIGIT - 53), -1074 - unit))
        more = q["more"] | F.exists(F.slice(q["digits"], top + 3, F.size(q["digits"])), lambda d: d > 0)

        def rounded(cut: Column) -> Column:
            rest = (cut["number"] % cut["by"]).cast(WHOLE)
            kept = ((cut["number"] - rest) / cut["by"]).cast(WHOLE)
            up = (rest * 2 > cut["by"]) | ((rest * 2 == cut["by"]) & (cut["more"] | (kept % 2 == 1)))
            return (kept + up.cast("int")).cast("double") * _power(cut["drop"] + unit)

        cut = F.struct(
            _three(q, place).alias("number"), F.get(powers, drop).alias("by"), drop.alias("drop"), more.alias("more")
        )
        return _let(cut, rounded)

    top = F.array_position(F.transform(q["digits"], lambda d: d > 0), True).cast("int")
    size = _let(top, lambda top: F.when(top == 0, F.lit(0.0)).otherwise(at_top(top)))
    return F.when(q["negative"], -size).otherwise(size)
