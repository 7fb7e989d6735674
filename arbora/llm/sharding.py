"""Sharding by sampled splitters, law `bytes`: the shards' sizes are near equal.

Records are ordered by a hash of their text. Keys drawn with a chance in proportion to size and number of records give quantile
boundaries, which cut that order into ranges of about RANGE_ROWS records; ranges that turn out overfull are subdivided, one that is a
single key by doc_id. Sizes of ranges, summed over all records, and running sums within each place every record
on the line of all bytes, which is cut into shards.

Equal texts have equal keys. Groups of more than 1/UNITS of all bytes are at most UNITS; they are dealt first, largest to the
emptiest shard, whole where they fit into what a shard may still take; one that fits nowhere fills up the emptiest shard and goes on in the
next emptiest, so it lies in as few shards as its size needs. The line of all smaller groups, none of which is
cut, fills the shards up. No shard is then further from the mean than about 8/UNITS of it.

Defined cases: a null text has size 1, and the key and checksum of an empty one; repeated rows are placed each;
an empty table has no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.session import persisted

SHARDS, UNITS, DRAWS = 8, 512, 16
#: Ranges at least, and the records of one on average beyond that.
RANGES, RANGE_ROWS = 1024, 100_000
SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"


def splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> np.ndarray:
    """Quantile boundaries of the drawn keys; a key that takes several quantiles is a range of its own."""
    order = np.argsort(keys)
    keys, total = keys[order], np.cumsum(weights[order])
    at = keys[np.minimum(np.searchsorted(total, np.arange(1, ranges) * total[-1] / ranges), len(keys) - 1)]
    key, n = np.unique(at, return_counts=True)
    return np.unique(np.concatenate([key, key[(n > 1) & (key < np.iinfo(np.int64).max)] + 1]))


def dealt(sizes: list[int], shards: int, total: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """sizes: of the large groups, largest first. Returns each group's pieces (shard, bytes), and how much room each shard has left."""
    room = [(k + 1) * total // shards - k * total // shards for k in range(shards)]
    pieces = []
    for size in sizes:
        own = []
        while size:
            s = max(range(shards), key=lambda k: (room[k], -k))
            n = min(size, room[s]) or size
            own.append((s, n))
            room[s], size = max(0, room[s] - n), size - n
        pieces.append(own)
    return pieces, room


def _ranged(bounds: np.ndarray, units: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        k = key.to_numpy()
        out = np.searchsorted(bounds, k, "right")
        if len(units):
            i = np.searchsorted(units, k)
            i[i == len(units)] = 0
            out = np.where(units[i] == k, len(bounds) + 1 + i, out)
        return pd.Series(out.astype(np.int32))

    return of("key")


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = persisted(rows, "sizes")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not count:
        return spark.createDataFrame([], SCHEMA)
    ranges = max(ranges, -(-count // range_rows))
    chance = F.least(F.lit(1.0), (F.col("size") / total + 1 / count) / 2 * (ranges * DRAWS))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 30)) < chance * (1 << 30)).select("key", ((F.col("size") / total + 1 / count) / chance).alias("weight")).toPandas()
    bounds = splitters(drawn["key"].to_numpy(), drawn["weight"].to_numpy(), ranges) if len(drawn) else np.zeros(0, np.int64)
    alone = set(bounds[:-1][np.diff(bounds) == 1].tolist())

    large = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * UNITS > total).orderBy(F.desc("bytes"), "key").collect()
    pieces, room = dealt([r["bytes"] for r in large], shards, total)
    units = np.array(sorted(r["key"] for r in large), np.int64)
    of_unit = {r["key"]: own for r, own in zip(large, pieces, strict=True)}

    ranged = rows.withColumn("range", _ranged(bounds, units))
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    first_unit = len(bounds) + 1

    def parts(r) -> int:
        return max(1, int(max(r["bytes"] * ranges / total, r["n"] * ranges / count) / 2))

    single = {r["range"]: r["range"] >= first_unit or (0 < r["range"] <= len(bounds) and int(bounds[r["range"] - 1]) in alone) for r in sizes}
    plan = spark.createDataFrame([(r["range"], parts(r), single[r["range"]]) for r in sizes], "range int, parts int, single boolean")
    part = F.pmod(F.when(F.col("single"), F.xxhash64("doc_id", F.lit(1))).otherwise(F.xxhash64("key", F.lit(1))), F.col("parts")).cast("int")
    placed = persisted(ranged.join(F.broadcast(plan), "range").select("doc_id", "size", "text_crc32", "key", "range", part.alias("part")), "placed")

    # Where each part begins: on the line of the smaller groups or, of a large group, within it; and where that line or group is cut.
    line = [(s, n) for s, n in enumerate(room) if n]
    whole = {r["range"]: r["bytes"] for r in sizes}
    before, at, last = [], {}, None
    for r in placed.groupBy("range", "part").agg(F.sum("size").alias("bytes")).orderBy("range", "part").collect():
        unit = r["range"] >= first_unit
        own = of_unit[int(units[r["range"] - first_unit])] if unit else line
        on = r["range"] if unit else -1
        begin = at.get(on, 0)
        if r["range"] != last:
            last, here = r["range"], begin
        ends = np.cumsum([n for _, n in own])[:-1].tolist()
        middle = None if unit or not single[r["range"]] else here + whole[r["range"]] / 2  # of a small group dealt over parts
        before.append((r["range"], r["part"], begin, unit, middle, ends, [s for s, _ in own] or [0]))
        at[on] = begin + r["bytes"]
    before = spark.createDataFrame(before, "range int, part int, before bigint, unit boolean, middle double, ends array<bigint>, shards array<int>")
    here = Window.partitionBy("range", "part").orderBy("key", F.xxhash64("doc_id"), "doc_id")
    same = Window.partitionBy("range", "part", "key")
    row = placed.withColumn("at", F.coalesce(F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    row = row.withColumn("group", F.sum("size").over(same)).withColumn("begin", F.min("at").over(same)).join(F.broadcast(before), ["range", "part"])
    own = F.col("before") + F.when(F.col("unit"), F.col("at") + F.col("size") / 2).otherwise(F.col("begin") + F.col("group") / 2)
    row = row.withColumn("middle", F.coalesce("middle", own)).withColumn("shard", F.expr("shards[size(filter(ends, e -> e <= middle))]"))
    sharded = persisted(row.select("doc_id", "size", "text_crc32", "key", "range", "part", "shard"), "sharded")

    slots, taken = [], dict.fromkeys(range(shards), 0)
    for r in sharded.groupBy("range", "part", "shard").count().orderBy("range", "part", "shard").collect():
        slots.append((r["range"], r["part"], r["shard"], taken[r["shard"]]))
        taken[r["shard"]] += r["count"]
    slots = spark.createDataFrame(slots, "range int, part int, shard int, slots bigint")
    place = F.row_number().over(Window.partitionBy("range", "part", "shard").orderBy("key", F.xxhash64("doc_id"), "doc_id"))
    out = sharded.withColumn("place", place).join(F.broadcast(slots), ["range", "part", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slots") + F.col("place") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
