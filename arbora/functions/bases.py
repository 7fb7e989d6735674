"""Bases as sets of A, C, G, T: the bits 1, 2, 4, 8 of an int; letters are IUPAC codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC letter of each set, at its number.
IUPAC = "ACMGRSVTWYHKDBN"


def mask(letter: Column) -> Column:
    """Set of a letter; unknown letters, gaps and dots are any base."""
    at = F.instr(F.lit(IUPAC), F.upper(letter))
    return F.when(letter.isNull(), None).when((at == 0) | (letter == ""), 15).otherwise(at).cast("int")


def letter(m: Column) -> Column:
    return F.substring(F.lit(IUPAC), m, F.lit(1))


def shown(m: Column) -> Column:
    """The letter of a single base, N for any other set."""
    return F.when(is_ambiguous(m), "N").otherwise(letter(m))


def is_ambiguous(m: Column) -> Column:
    return F.bit_count(m) != 1


def is_compatible(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def first_base(m: Column) -> Column:
    """The lowest base of a set."""
    return m.bitwiseAND(-m)


def common_bases(a: Column, b: Column) -> Column:
    """Their intersection; null if they are disjoint."""
    both = a.bitwiseAND(b)
    return F.when(both != 0, both)


def first_common_base(a: Column, b: Column) -> Column:
    return first_base(common_bases(a, b))


def complement(m: Column) -> Column:
    """A with T, C with G."""
    bit = lambda x, y: F.when(m.bitwiseAND(x) != 0, y).otherwise(0)
    return bit(1, 8) + bit(2, 4) + bit(4, 2) + bit(8, 1)


def code(letter_: Column) -> Column:
    """A, C, G, T -> 0..3; other letters null."""
    at = F.instr(F.lit("ACGT"), F.upper(letter_)) - 1
    return F.when(at >= 0, at).cast("int")


def decode(code_: Column) -> Column:
    return F.when(code_.between(0, 3), F.substring(F.lit("ACGT"), code_ + 1, F.lit(1)))
