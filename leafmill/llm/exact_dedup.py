"""Exact dedup by a tree merge of sorted digest runs (native: DataFrame operations only).

Every row is dealt to one of ``2 ** bits`` runs by its doc_id. A run holds one entry per
distinct text, sorted by digest: digest, byte length and a second hash (entries merge only
when all three agree), largest and smallest doc_id and the number of rows. In each round
``2 ** fan`` neighbouring runs become one: run numbers lose ``fan`` low bits, and so that no
task ever holds a whole large run, each is cut into ``2 ** fan`` times as many segments by
the first bits of the digest. Segments of one merged run are exchanged, sorted together
(Spark merges sorted spills) and read in order; of neighbours that agree one entry stays, with
the smallest and largest identifiers. A merged entry has at most ``2 ** fan`` children,
so a text with a third of all rows costs no more than that per merge. After the last
round there is one run in ``2 ** bits`` segments; the answers travel back down the same tree.
Only digests move, never texts.

Null texts count as empty. Of equal texts the row with the largest doc_id stays; rows
without a doc_id lose against any other. :func:`dedup` marks rows that repeat both doc_id
and text alike (``kept`` for all of them; in groups without any doc_id for all rows, with a null keep_id);
:func:`drop_duplicates` leaves exactly one row of each text. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_key, saved, without_marked

SAME = ["digest", "bytes", "check"]


def run_bits(docs: DataFrame, fan: int) -> int:
    """As many runs as shuffle partitions, rounded up to whole rounds."""
    wanted = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return fan * -(-(wanted - 1).bit_length() // fan)


def _ordered(level: DataFrame, fan: int, number: int) -> DataFrame:
    """The runs of round ``number``: exchanged by run and segment, sorted by digest, neighbours that agree merged."""
    segment = F.shiftright(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), 32 - fan * number)
    keys = ["run", "segment", *SAME]
    met = level.withColumn("segment", segment).repartition("run", "segment").sortWithinPartitions(*keys)
    alike = Window.partitionBy(*keys).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = met.withColumns({
        "first": F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)), "n": F.sum("n").over(alike),
        "largest": F.max("largest").over(alike), "smallest": F.min("smallest").over(alike),
    })
    return merged.where("first = 1").drop("first", "segment")


def merge(docs: DataFrame, fan: int = 4, bits: int | None = None) -> DataFrame:
    """doc_id, digest (binary), group_size and the smallest and largest doc_id of each row's group."""
    bits = bits or run_bits(docs, fan)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    dealt = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.spark_partition_id()), F.lit(1 << bits))
    rows = saved(docs.select(
        "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("check"), dealt.cast("int").alias("run"),
    ), "digests")
    level = rows.groupBy("run", *SAME).agg(F.max("doc_id").alias("largest"), F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n"))
    levels = [saved(level.sortWithinPartitions("run", *SAME), "run0")]
    for number in range(1, bits // fan + 1):
        level = _ordered(levels[-1].withColumn("run", F.shiftright("run", fan)), fan, number)
        levels.append(level if number == bits // fan else saved(level, f"run{number}"))
    answer = levels.pop()
    while levels:
        children = levels.pop().select("run", *SAME, F.shiftright("run", fan).alias("up"))
        answer = children.join(answer.withColumnRenamed("run", "up"), ["up", *SAME]).drop("up")
    return rows.join(answer, ["run", *SAME]).select("doc_id", "digest", F.col("n").alias("group_size"), "largest", "smallest")


def dedup(docs: DataFrame, fan: int = 4, bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = merge(docs.select("doc_id", "text"), fan, bits)
    return found.select(
        "doc_id", F.col("largest").alias("keep_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("largest")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with exactly one row of each text: the largest doc_id, any one of rows that repeat it; columns as they are."""
    each = dedup(docs).groupBy("doc_id", "text_sha256", "keep_id").agg(F.count(F.lit(1)).alias("n"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marked = saved(each.where(~stays | (F.col("n") > 1)).select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"), stays.alias("stays")), "marked")
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    return without_marked(docs, row_key(F.col("doc_id"), sha), marked)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY sha256(coalesce(text, '')))
"""
