"""The shortest usual selector that finds one element alone, from counts of what elements are called.

An inverted index instead of matching: how many elements of a document have an id, a role, a tag, or a set of one or two
classes is counted once, and the first idea of an element whose count is one is its selector. Windows and the class
index are keyed by the document and the name, so one exchange by document serves all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.inspect import GENERIC
from .intervals import _SPACE, squeezed

_IDENT = "^[A-Za-z_-][A-Za-z0-9_-]*$"


def _quoted(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _class_keys(names: Column) -> Column:
    """Every class and every pair of classes, pairs in order."""
    ordered = F.array_sort(names)
    pairs = F.flatten(F.transform(ordered, lambda a, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.concat(a, F.lit(" "), b))))
    return F.concat(ordered, pairs)


def recommended(nodes: DataFrame, keys: Sequence[str], wanted: Column | None = None) -> DataFrame:
    """keys, node_id, tag, path and selector of the elements for which ``wanted`` holds (all, if None); the path where no idea is unique."""
    value = lambda name: F.regexp_replace(F.col("attrs")[name], f"^{_SPACE}|{_SPACE}$", "")
    own = lambda name: F.when((value(name) == F.col("attrs")[name]) & (value(name) != ""), value(name))  # noqa: E731  what a selector says must be what the attribute holds
    count = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*keys, *by))
    plain = F.filter(F.split(squeezed(F.coalesce(F.col("attrs")["class"], F.lit(""))), " "), lambda c: c.rlike(_IDENT))
    special = F.filter(plain, lambda c: ~c.isin(*sorted(GENERIC)))
    chosen = F.slice(F.when(F.size(special) > 0, special).otherwise(plain), 1, 2)
    held = F.array_distinct(F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), "[ \t\n\f\r]"), lambda c: c != ""))
    elements = nodes.where("kind = 'element'").select(
        *keys, "node_id", "tag", "path", (F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))).alias("_wanted"), own("id").alias("_id"), own("role").alias("_role"), own("itemprop").alias("_item"),
        F.col("attrs")["id"].alias("_all_id"), F.col("attrs")["role"].alias("_all_role"), F.col("attrs")["itemprop"].alias("_all_item"), chosen.alias("_chosen"), held.alias("_held"),
    ).withColumns({
        "_n_id": count("_all_id"), "_n_role": count("_all_role"), "_n_tag_role": count("tag", "_all_role"), "_n_tag_item": count("tag", "_all_item"), "_n_tag": count("tag"),
        "_key": F.when(F.size("_chosen") > 0, F.array_join(F.array_sort(F.array_distinct("_chosen")), " ")),
    })
    index = elements.where(F.size("_held") > 0).select(*keys, "tag", F.explode(_class_keys(F.col("_held"))).alias("_key")).groupBy(*keys, "_key", "tag").agg(F.count(F.lit(1)).alias("_n_tag_class"))
    index = index.withColumn("_n_class", F.sum("_n_tag_class").over(Window.partitionBy(*keys, "_key")))
    e = elements.where("_wanted").join(index, [*keys, "_key", "tag"], "left")
    named, dotted = F.col("tag").rlike(_IDENT), F.concat(F.lit("."), F.array_join("_chosen", "."))
    said = lambda name, column: F.concat(F.lit(f'[{name}="'), _quoted(F.col(column)), F.lit('"]'))
    first = F.coalesce(
        F.when(F.col("_id").isNotNull() & (F.col("_n_id") == 1), F.when(F.col("_id").rlike(_IDENT), F.concat(F.lit("#"), F.col("_id"))).otherwise(said("id", "_id"))),
        F.when(named & F.col("_role").isNotNull() & (F.col("_n_tag_role") == 1), F.concat(F.col("tag"), said("role", "_role"))), F.when(F.col("_role").isNotNull() & (F.col("_n_role") == 1), said("role", "_role")),
        F.when(named & F.col("_item").isNotNull() & (F.col("_n_tag_item") == 1), F.concat(F.col("tag"), said("itemprop", "_item"))),
        F.when(named & (F.col("_n_tag_class") == 1), F.concat(F.col("tag"), dotted)), F.when(F.col("_n_class") == 1, dotted), F.when(named & (F.col("_n_tag") == 1), F.col("tag")), F.col("path"),
    )
    return e.select(*keys, "node_id", "tag", "path", first.alias("selector"))
