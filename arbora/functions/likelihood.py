"""k-mers and the context-dependent Poisson likelihood of an edge.

k-mers over ACGT are numbered as base-4 numbers, first letter first; one that holds another letter has the number 4^k.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import bases as B


def kmer_index(kmer: Column, k: int) -> Column:
    digits = [B.code(F.substring(kmer, i + 1, 1)) for i in range(k)]
    return F.coalesce(reduce(lambda a, d: a * 4 + d, digits), F.lit(4**k)).cast("int")


def kmer_text(index: Column, k: int) -> Column:
    """The k-mer of a number; N for the last."""
    letters = [F.substring(F.lit("ACGT"), F.pmod(F.floor(index / 4 ** (k - 1 - i)), F.lit(4)).cast("int") + 1, F.lit(1)) for i in range(k)]
    return F.when(index == 4**k, "N").otherwise(F.concat(*letters))


def encoded(sequence: Column, k: int, site_count: int | None = None) -> Column:
    """The number of the k-mer around each site (k odd; N beyond the ends), padded with 4^k or cut to site_count."""
    half = (k - 1) // 2
    n = F.length(sequence)
    padded = F.concat(F.lit("N" * half), F.upper(sequence), F.lit("N" * half))
    out = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: kmer_index(F.substring(padded, i, F.lit(k)), k))).otherwise(F.array().cast("array<int>"))
    if site_count is None:
        return out
    return F.slice(F.concat(out, F.array_repeat(F.lit(4**k), F.greatest(F.lit(site_count) - n, F.lit(0)))), 1, site_count)


def base_codes(sequence: Column) -> Column:
    """0..3 for A, C, G, T, 4 for all else."""
    return F.transform(F.split(sequence, ""), lambda b: F.coalesce(B.code(b), F.lit(4)))


def wild_type_mask(code: Column, big: float = 1e9) -> Column:
    """Four logit offsets: -big at the base itself."""
    return F.array(*[F.when(code == b, -big).otherwise(0.0) for b in range(4)])


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def masked_chances(sites: DataFrame, log_rate: Column, logits: Column, bias: float = 0.0) -> DataFrame:
    """Adds rate and csp (chances of the substitutions) to sites: base (code) and, if there is one, mask (0 or 1; else 0 where the base is N).

    Where the mask is 0 the rate is 1 and the chances are even, but for the base itself, which no site turns into. bias: a log factor on all rates.
    """
    mask = F.col("mask").cast("double") if "mask" in sites.columns else (F.col("base") < 4).cast("double")
    offered = F.zip_with(logits, wild_type_mask(F.col("base")), lambda x, m: x * mask + m)
    return sites.withColumn("csp", softmax(offered)).withColumn("rate", F.exp((log_rate + bias) * mask))


def fivemer_rates(sites: DataFrame, model: DataFrame, bias: float = 0.0) -> DataFrame:
    """sites: key columns, site, kmer, base (code), optionally mask. model: kmer, log_rate, logits (4). Adds rate and csp, see masked_chances()."""
    met = sites.join(model, "kmer", "left")
    out = masked_chances(met, F.coalesce("log_rate", F.lit(0.0)), F.coalesce("logits", F.array(*[F.lit(0.0)] * 4)), bias)
    return out.drop("log_rate", "logits")


def edge_log_likelihood(sites: DataFrame, key: list[str]) -> DataFrame:
    """sites: key, parent and child (base codes), rate, csp, and optionally mask (0 or 1). Adds up to log_likelihood of each key:

    sum over mutations of log(rate * csp[child]), plus n log(n / sum of rates) - n; 0 without mutations. Sites with an N are passed over.
    """
    known = (F.col("parent") < 4) & (F.col("child") < 4)
    if "mask" in sites.columns:
        known &= F.col("mask") == 1
    rows = sites.where(known).withColumn("hit", F.col("parent") != F.col("child"))
    sums = rows.groupBy(*key).agg(F.sum(F.when(F.col("hit"), F.log(F.col("rate") * F.get("csp", F.col("child"))))).alias("s"), F.sum(F.col("hit").cast("int")).alias("n"), F.sum("rate").alias("r"))
    value = F.when(F.col("n") == 0, 0.0).otherwise(F.col("s") + F.col("n") * F.log(F.col("n") / F.col("r")) - F.col("n"))
    return sums.select(*key, value.alias("log_likelihood"))


def cnn_rates(kmers: np.ndarray, weights: dict[str, np.ndarray], prefix: str = "r_") -> np.ndarray:
    """One head of the independent CNN: embedding, same-padded convolution, relu, linear. kmers: one sequence's numbers."""
    x = weights[f"{prefix}kmer_embedding.weight"][kmers]  # sites x depth
    w, b = weights[f"{prefix}conv.weight"], weights[f"{prefix}conv.bias"]  # filters x depth x width
    half = w.shape[2] // 2
    padded = np.pad(x, ((half, w.shape[2] - 1 - half), (0, 0)))
    windows = np.stack([padded[i : i + w.shape[2]] for i in range(len(x))])  # sites x width x depth
    hidden = np.maximum(np.einsum("swd,fdw->sf", windows, w) + b, 0)
    return hidden @ weights[f"{prefix}linear.weight"].T + weights[f"{prefix}linear.bias"]


def model_weights(rows: DataFrame) -> dict[str, np.ndarray]:
    """rows: name, shape (array<int>), values (array<double>): a network's parameters as a table, which is small."""
    return {r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in rows.select("name", "shape", "values").collect()}


def cnn_sites(sequences: DataFrame, weights: dict[str, np.ndarray], bias: float = 0.0) -> DataFrame:
    """sequences: key columns, kmers (see encoded()), bases (see base_codes()). One row for each site: key columns, site, base, rate, csp; both heads of the CNN run on Arrow batches."""
    known = sequences.sparkSession.sparkContext.broadcast(weights)

    def head(prefix: str) -> Column:
        @F.pandas_udf("array<double>")
        def run(kmers: pd.Series) -> pd.Series:
            return pd.Series([cnn_rates(np.asarray(k, int), known.value, prefix).ravel() for k in kmers])

        return run("kmers")

    key = [c for c in sequences.columns if c not in ("kmers", "bases")]
    both = sequences.where("size(kmers) > 0").withColumn("_r", head("r_")).withColumn("_s", head("s_"))
    sites = both.select(*key, "_s", F.posexplode(F.arrays_zip("bases", "_r")).alias("site", "_x")).select(*key, "site", F.col("_x.bases").alias("base"), F.col("_x._r").alias("_r"), F.expr("slice(_s, 4 * site + 1, 4)").alias("_s"))
    return masked_chances(sites, F.col("_r"), F.col("_s"), bias).drop("_r", "_s")
