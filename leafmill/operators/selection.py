"""Selection and histograms over tables of candidates, as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.extract import Selection


def numbered(candidates: DataFrame, keys: list[str], order: str = "node_id") -> DataFrame:
    """candidate_index and candidate_count within each document."""
    own = Window.partitionBy(*keys)
    return candidates.withColumns({"candidate_index": F.row_number().over(own.orderBy(order)).cast("long"), "candidate_count": F.count(F.lit(1)).over(own)})


def selected(candidates: DataFrame, keys: list[str], selection: Selection, order: str = "node_id") -> DataFrame:
    """The candidates that a selection keeps."""
    out = numbered(candidates, keys, order)
    return {"all": lambda: out, "first": lambda: out.where("candidate_index = 1"), "single": lambda: out.where("candidate_count = 1"), "nth": lambda: out.where(F.col("candidate_index") == selection.index)}[selection.mode]()


def selection_diagnostics(docs: DataFrame, candidates: DataFrame, keys: list[str], selection: Selection) -> DataFrame:
    """keys, level, code and message of each document that has something to say about a selection."""
    counts = docs.select(*keys).join(candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n").cast("string")
    none = F.col("n") == 0
    code = F.when(none, "NO_MATCH")
    message = F.when(none, "No matches were found for the extraction request.")
    if selection.mode == "single":
        code, message = code.when(F.col("n") > 1, "AMBIGUOUS_MATCH"), message.when(F.col("n") > 1, F.concat(F.lit("Exact-one selection requires exactly one candidate, but "), n, F.lit(" were found.")))
    elif selection.mode == "first":
        code, message = code.when(F.col("n") > 1, "MULTIPLE_MATCHES"), message.when(F.col("n") > 1, F.concat(F.lit("Matched "), n, F.lit(" candidates while using match type first.")))
    elif selection.mode == "nth":
        late = F.col("n") < selection.index
        code, message = code.when(late, "MATCH_INDEX_OUT_OF_RANGE"), message.when(late, F.concat(F.lit(f"Match index {selection.index} is out of range for "), n, F.lit(" candidates.")))
    out = counts.select(*keys, F.when(code == "MULTIPLE_MATCHES", "warning").otherwise("error").alias("level"), code.alias("code"), message.alias("message"))
    return out.where("code IS NOT NULL")


def histogram(nodes: DataFrame, keys: list[str], by: str = "tag") -> DataFrame:
    """How often each tag, or each class name, occurs in a document."""
    if by == "class":
        names = nodes.where("kind = 'element'").select(*keys, F.explode(F.split(F.trim(F.col("attrs")["class"]), r"(?U)\s+")).alias("class")).where("class <> ''")
        return names.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("count"))
    return nodes.where("kind = 'element'").groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("count"))


def top(counts: DataFrame, keys: list[str], by: str, limit: int = 8) -> DataFrame:
    """The most frequent names of each document, ties by name."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), by))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)
