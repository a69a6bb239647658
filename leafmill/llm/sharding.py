"""Sharding by histogram sort under the law ``bytes``: shards of nearly equal size.

Rows are ordered by a hash of their text, so equal texts are neighbours. Groups of equal texts
larger than ``tolerance`` of a shard (no more than shards / tolerance of them, however many rows
there are) are placed first, the largest first, each in the emptiest shard. Splitters
between the shards' shares of all other rows are found by counting, across all
partitions, the exact bytes below candidate boundaries: a first histogram over the top
bits of the key, then finer histograms only inside the intervals that still hold a
splitter, until each splitter is within ``tolerance`` of its target or its interval is one
key. Counts are exact sums over a narrow table (id, size, hash); each round returns a few
thousand sums. Then rows are exchanged once, into sub-buckets of shards, and numbered there.

Equal texts stay in one shard unless no shard has room for them: then as much as there is room
for goes there, found by the same histograms over a hash of the rows, and the rest goes on. So a
shard's size misses the mean by a few tolerances at most (two splitters and the cuts of such a
group), or by one row where a row is larger than that.

Null texts have size 8, as empty ones. Rows without a doc_id and repeated rows are
placed like any others. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

#: Key bits, and bits that one round of probes adds.
BITS, STEP = 60, 12


def _refine(rows: DataFrame, key: str, targets: list[float], tolerance: float) -> list[tuple[int, float]]:
    """For each target the key k whose bytes below come nearest to it, as far as the tolerance asks, and those bytes."""
    open_, found = {i: (0, 0.0) for i in range(len(targets))}, {}  # splitter -> prefix of the key, bytes below it
    shift = BITS
    while open_ and shift > 0:
        shift -= STEP
        prefixes = sorted({p for p, _ in open_.values()})
        part = rows if shift + STEP == BITS else rows.where(F.shiftright(key, shift + STEP).isin(prefixes))
        sums = {r["b"]: float(r["n"]) for r in part.groupBy(F.shiftright(key, shift).alias("b")).agg(F.sum("size").alias("n")).collect()}
        nxt = {}
        for i, (prefix, below) in open_.items():
            at = below
            for b in range(prefix << STEP, (prefix + 1) << STEP):
                n = sums.get(b, 0.0)
                if at + n > targets[i] or b == ((prefix + 1) << STEP) - 1:
                    near = at if targets[i] - at <= at + n - targets[i] else at + n
                    if abs(near - targets[i]) <= tolerance or shift == 0:
                        found[i] = ((b if near == at else b + 1) << shift, near)
                    else:
                        nxt[i] = (b, at)
                    break
                at += n
        open_ = nxt
    return [found[i] for i in range(len(targets))]


def heavy_groups(rows: DataFrame, shards: int, tolerance: float, share: float) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """Places (key, first sub, last sub, shard) of the large groups of equal texts, and the bytes they take in each shard."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).where(F.col("n") > tolerance * share).collect()
    load, places = [0.0] * shards, []
    for r in sorted(groups, key=lambda r: (-r["n"], r["key"])):
        mine, size, done, first = rows.where(F.col("key") == r["key"]), float(r["n"]), 0.0, 0
        while done < size:
            i, edge, upto = min(range(shards), key=load.__getitem__), 1 << BITS, size
            if load[i] + size - done > share * (1 + tolerance) and r["rows"] > 1:
                edge, upto = _refine(mine, "sub", [done + max(share - load[i], tolerance * share)], tolerance * share / 4)[0]
                if upto <= done:  # no row fits: the rest stays whole
                    edge, upto = 1 << BITS, size
            places.append((r["key"], first, edge - 1, i))
            load[i] += upto - done
            done, first = upto, edge
    return places, load


def _place(cuts: list[int]) -> Column:
    """The number of splitters at or below a row's key."""
    shard = F.lit(0)
    for key in cuts:
        shard = shard + (F.col("key") >= key).cast("int")
    return shard


def placed(rows: DataFrame, shards: int, tolerance: float) -> tuple[DataFrame, int]:
    """``rows`` (key, sub, size) with their shard; the number of rows."""
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not count:
        return rows.withColumn("shard", F.lit(0)), 0
    share = float(total) / shards
    places, load = heavy_groups(rows, shards, tolerance, share)
    table = F.broadcast(rows.sparkSession.createDataFrame(places, "_key long, _from long, _to long, _shard int"))  # at most shards / tolerance groups
    light = rows.join(F.broadcast(table.select("_key").distinct()), F.col("key") == F.col("_key"), "left_anti")
    room, targets = [max(0.0, share - x) for x in load], []
    scale = (float(total) - sum(load)) / max(1.0, sum(room))
    for r in room[:-1]:
        targets.append((targets[-1] if targets else 0.0) + r * scale)
    cuts = [g[0] for g in _refine(light, "key", targets, tolerance * share)]
    own = (F.col("key") == F.col("_key")) & F.col("sub").between(F.col("_from"), F.col("_to"))
    return rows.join(table, own, "left").withColumn("shard", F.coalesce("_shard", _place(cuts))).drop("_key", "_from", "_to", "_shard"), count


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.005, rows_per_bucket: int = 200_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    mask = F.lit((1 << BITS) - 1)
    rows = saved(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(mask).alias("key"), F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(mask).alias("sub"),
    ), "sizes")
    dealt, count = placed(rows, shards, tolerance)
    buckets = max(1, -(-count // (shards * rows_per_bucket)))
    dealt = dealt.withColumn("bucket", F.pmod(F.col("sub"), F.lit(buckets)))
    held = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = held.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # shards x buckets rows
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "sub")
    numbered = dealt.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(first, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """The documents themselves, one folder per shard; rows with equal doc_id and text share a place."""
    placed = shard(docs, shards).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard")).distinct()
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    docs.join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (crc == F.col("_crc"))).drop("_id", "_crc").write.partitionBy("_shard").parquet(path)
