"""Genomes as differences to a reference sequence, and mutations between genomes.

A genome is array<struct<pos int, base string>>, sorted by pos (1-based), without entries equal to the reference.
Mutations are array<struct<pos int, par string, mut string>>. All functions are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions import bases as B

GENOME = "array<struct<pos:int,base:string>>"
MUTATIONS = "array<struct<pos:int,par:string,mut:string>>"


def entry(pos: Column, base: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), base.alias("base"))


def empty() -> Column:
    return F.array().cast(GENOME)


def _at(text: Column, pos: Column) -> Column:
    return F.substring(text, pos, F.lit(1))


def _places(length: Column) -> Column:
    return F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))


def from_sequence(sequence: Column, reference: Column) -> Column:
    """Places where the sequence differs; null if the lengths do."""
    found = F.transform(_places(F.length(sequence)), lambda i: entry(i, _at(sequence, i)))
    return F.when(F.length(sequence) == F.length(reference), F.filter(found, lambda x: x["base"] != _at(reference, x["pos"])))


def base_at(genome: Column, pos: Column, reference: Column) -> Column:
    return F.coalesce(F.get(F.filter(genome, lambda x: x["pos"] == pos), F.lit(0))["base"], _at(reference, pos))


def to_sequence(genome: Column, reference: Column) -> Column:
    return F.aggregate(genome, reference, lambda out, x: F.overlay(out, x["base"], x["pos"], F.lit(1)))


def has_position(genome: Column, pos: Column) -> Column:
    return F.exists(genome, lambda x: x["pos"] == pos)


def _zipped(a: Column, b: Column, each) -> Column:
    """each(pos, base of a, base of b), null where a side has no entry, at every place of either; a map by place.

    The maps are made once for a row: what stands inside a higher-order function's lambda is evaluated for each element.
    """
    return F.map_zip_with(F.map_from_entries(a), F.map_from_entries(b), each)


def upsert(genome: Column, changes: Column) -> Column:
    """changes (a genome too) win over entries at the same place; entries equal to the reference are kept."""
    both = _zipped(genome, changes, lambda i, x, y: F.coalesce(y, x))
    return F.array_sort(F.transform(F.map_entries(both), lambda e: entry(e["key"], e["value"])))


def without_reference(genome: Column, reference: Column) -> Column:
    return F.filter(genome, lambda x: x["base"] != _at(reference, x["pos"]))


def apply_mutations(genome: Column, mutations: Column, reference: Column) -> Column:
    """The child's genome: a mutation to the reference's base erases an entry."""
    changes = F.transform(mutations, lambda m: entry(m["pos"], m["mut"]))
    return without_reference(upsert(genome, changes), reference)


def _sides(a: Column, b: Column, reference: Column) -> Column:
    """place -> the sets of bases p and c of both genomes."""
    base = lambda x, i: B.mask(F.coalesce(x, _at(reference, i)))
    return _zipped(a, b, lambda i, x, y: F.struct(base(x, i).alias("p"), base(y, i).alias("c")))


def mutations_between(parent: Column, child: Column, reference: Column) -> Column:
    """Places whose sets of bases are disjoint; an ambiguous side stands for its first base."""
    apart = F.filter(F.map_entries(_sides(parent, child, reference)), lambda e: ~B.is_compatible(e["value"]["p"], e["value"]["c"]))
    base = lambda m: B.letter(B.first_base(m))
    return F.array_sort(F.transform(apart, lambda e: F.struct(e["key"].alias("pos"), base(e["value"]["p"]).alias("par"), base(e["value"]["c"]).alias("mut"))))


def differing_sites(a: Column, b: Column) -> Column:
    """Places of one genome only, or of both with incompatible bases."""
    differs = _zipped(a, b, lambda i, x, y: x.isNull() | y.isNull() | ~B.is_compatible(B.mask(x), B.mask(y)))
    return F.array_sort(F.map_keys(F.map_filter(differs, lambda i, d: d)))


def is_compatible(a: Column, b: Column, reference: Column) -> Column:
    return F.forall(F.map_values(_sides(a, b, reference)), lambda x: B.is_compatible(x["p"], x["c"]))


def is_ambiguous(genome: Column) -> Column:
    return F.exists(genome, lambda x: B.is_ambiguous(B.mask(x["base"])))


def text(genome: Column) -> Column:
    """<1A,3T,>; equal for equal genomes, so it is their key too."""
    return F.concat(F.lit("<"), F.array_join(F.transform(genome, lambda x: F.concat(x["pos"].cast("string"), x["base"], F.lit(","))), ""), F.lit(">"))


def mutations_text(mutations: Column) -> Column:
    """<A3T,>."""
    return F.concat(F.lit("<"), F.array_join(F.transform(mutations, lambda m: F.concat(m["par"], m["pos"].cast("string"), m["mut"], F.lit(","))), ""), F.lit(">"))
