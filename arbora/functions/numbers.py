"""Whole numbers of any size as columns: array<bigint>, so that the JVM adds, multiplies and orders them.

A number is [length, limb, limb, ...]: limbs of six decimal digits from the highest on, and how many they are; of a negative number all of
these are negative, and zero is [0]. So arrays sort as the numbers do, and min and max hold for them. Sums of many rows are made limb by limb (add_up), with
partial sums before the shuffle; products in groups of a bounded size, in rounds (multiply_up).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "array<bigint>"
BASE = 1_000_000
DIGITS = 6
#: Numbers that are multiplied in one row.
TOGETHER = 16

_none = lambda: F.array().cast(KIND)


def _whole(x: Column) -> Column:
    return x.cast("bigint")


def zero() -> Column:
    return F.array(_whole(F.lit(0)))


def one() -> Column:
    return F.array(_whole(F.lit(1)), _whole(F.lit(1)))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out, and written in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def limbs(number: Column) -> Column:
    """From the lowest on; zero has one."""
    return let(number, lambda v: F.when(F.size(v) == 1, zero()).otherwise(F.reverse(F.slice(v, 2, F.size(v)))))


def _carried(raw: Column) -> Column:
    """struct(carry, out): limbs within 0 .. BASE - 1, and what is left above them, which is negative for a negative number."""
    start = F.struct(_whole(F.lit(0)).alias("carry"), _none().alias("out"))

    def step(s: Column, x: Column) -> Column:
        base = _whole(F.lit(BASE))
        down = F.call_function("div", s["carry"] + x, base) - F.when((s["carry"] + x) % base < 0, 1).otherwise(0)
        return F.struct(_whole(down).alias("carry"), F.concat(s["out"], F.array(F.pmod(s["carry"] + x, base))).alias("out"))

    return F.aggregate(raw, start, step)


def _signed(size: Column, sign: int) -> Column:
    """The number of clean limbs, which may end in zeros."""

    def cut(top: Column, out: Column) -> Column:
        return F.concat(F.array(top * sign), F.transform(F.reverse(F.slice(out, 1, top.cast("int"))), lambda x: x * sign))

    top = lambda out: _whole(F.coalesce(F.array_max(F.transform(out, lambda x, i: F.when(x != 0, i + 1))), F.lit(0)))
    return let(size, lambda out: let(top(out), lambda t: cut(t, out)))


def normal(raw: Column) -> Column:
    """The number of limbs from the lowest on, each any bigint: what is beyond six digits is carried."""
    # Four limbs more hold any carry of a bigint; after them it is 0, or -1 below zero.
    long = F.concat(raw, F.array(*[_whole(F.lit(0))] * 4))
    return let(long, lambda x: let(_carried(x), lambda up: F.when(up["carry"] < 0, _signed(_carried(F.transform(x, lambda v: -v))["out"], -1)).otherwise(_signed(up["out"], 1))))


def of_long(x: Column) -> Column:
    return normal(F.array(_whole(x)))


def of_text(x: Column) -> Column:
    """Of decimal digits, after a sign or none."""

    def cut(digits: Column, sign: Column) -> Column:
        count = F.call_function("div", F.length(digits) + DIGITS - 1, F.lit(DIGITS)).cast("int")
        padded = F.lpad(digits, count * DIGITS, F.lit("0"))
        return let(F.struct(count.alias("n"), padded.alias("t"), sign.alias("s")), lambda p: F.transform(F.sequence(p["n"] - 1, F.lit(0), F.lit(-1)), lambda i: F.substring(p["t"], i * DIGITS + 1, F.lit(DIGITS)).cast("bigint") * p["s"]))

    return let(x, lambda v: normal(let(F.regexp_replace(v, "^[+-]", ""), lambda d: cut(d, _whole(F.when(v.startswith("-"), -1).otherwise(1))))))


def text(number: Column) -> Column:
    def shown(v: Column) -> Column:
        sign = F.when(F.get(v, F.lit(0)) < 0, "-").otherwise("")
        rest = F.array_join(F.transform(F.slice(v, 3, F.greatest(F.size(v) - 2, F.lit(0))), lambda x: F.lpad(F.abs(x).cast("string"), DIGITS, "0")), "")
        return F.concat(sign, F.abs(F.coalesce(F.get(v, F.lit(1)), F.lit(0))).cast("string"), rest)

    return let(number, shown)


def plus(a: Column, b: Column) -> Column:
    return normal(F.zip_with(limbs(a), limbs(b), lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))


def times(a: Column, b: Column) -> Column:
    """Limb k of the product is the sum over i of limb i of a by limb k - i of b: below 10^18 for numbers of up to six million digits."""

    def whole(s: Column) -> Column:
        x, y, m, n = s["x"], s["y"], F.size(s["x"]), F.size(s["y"])
        limb = lambda k: F.aggregate(F.sequence(F.greatest(k - n + 1, F.lit(0)), F.least(k, m - 1)), _whole(F.lit(0)), lambda t, i: t + F.get(x, i) * F.get(y, k - i))
        return F.transform(F.sequence(F.lit(0), m + n - 2), limb)

    return normal(let(F.struct(limbs(a).alias("x"), limbs(b).alias("y")), whole))


def product(numbers: Column) -> Column:
    """Of an array of numbers; 1 if it is empty."""
    return F.aggregate(numbers, one(), times)


def add_up(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, column: the sum of the numbers of each key. Limbs are summed apart, before and after the shuffle, and carried at the end."""
    each = rows.select(*key, F.posexplode(limbs(F.col(column))).alias("_i", "_limb"))
    sums = each.groupBy(*key, "_i").agg(F.sum("_limb").alias("_limb"))
    return sums.groupBy(*key).agg(normal(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_limb"))), lambda x: x["_limb"])).alias(column))


def multiply_up(rows: DataFrame, key: list[str], at: str, column: str, write=lambda df: df) -> DataFrame:
    """key, column: the product of the numbers of each key, which `at`, a whole number from 0 on, tells apart; ones are left out first.

    TOGETHER numbers of a key are multiplied in a row, then as many of their products, and so on. write: cuts the plan after a round.
    """
    keys = rows.select(*key).distinct()
    left = write(rows.where(F.col(column) != one()).select(*key, F.col(at).alias("_at"), column))
    while True:
        most = left.agg(F.max("_at")).first()[0]
        if most is None or most == 0:
            break
        group = F.call_function("div", F.col("_at"), F.lit(TOGETHER))
        left = write(left.groupBy(*key, group.alias("_at")).agg(product(F.collect_list(column)).alias(column)))
    return keys.join(left.drop("_at"), key, "left").select(*key, F.coalesce(column, one()).alias(column))


def others_up(rows: DataFrame, key: list[str], at: str, column: str, write=lambda df: df) -> DataFrame:
    """key, at, column: for each number the product of all others of its key, without a division: products of groups upwards, what is outside a group downwards."""
    left = write(rows.where(F.col(column) != one()).select(*key, F.col(at).alias("_at"), F.col(column).alias("_v")))
    levels = []
    while (left.agg(F.max("_at")).first()[0] or 0) > 0:
        group = F.call_function("div", F.col("_at"), F.lit(TOGETHER))
        held = write(left.groupBy(*key, group.alias("_group")).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_all")))
        levels.append(held)
        left = write(held.select(*key, F.col("_group").alias("_at"), product(F.transform("_all", lambda x: x["_v"])).alias("_v")))
    whole = left.select(*key, F.col("_v").alias("_whole"))
    outside = left.select(*key, "_at", one().alias("_o"))
    for held in reversed(levels):
        met = held.join(outside.withColumnRenamed("_at", "_group"), [*key, "_group"])
        rest = lambda x: times(F.col("_o"), product(F.transform(F.filter("_all", lambda y: y["_at"] != x["_at"]), lambda y: y["_v"])))  # noqa: B023, E731
        each = F.explode(F.transform("_all", lambda x: F.struct(x["_at"].alias("_at"), rest(x).alias("_o"))))  # noqa: B023
        outside = write(met.select(*key, each.alias("_x")).select(*key, "_x._at", "_x._o"))
    found = rows.select(*key, at).join(outside.withColumnRenamed("_at", at), [*key, at], "left").join(whole, key, "left")
    return found.select(*key, at, F.coalesce("_o", "_whole", one()).alias(column))
