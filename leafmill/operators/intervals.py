"""Questions about subtrees, asked of the node table by intervals: no containment join, linear work.

A node's ``pre`` and ``post`` are the times at which a walk round the tree enters and leaves it. What
lies below a node happens between these times, so a sum over a subtree is the running sum when the walk leaves
less the running sum when it entered (:func:`tour`); and a node lies in a marked
element if the latest time at which a marked element entered so far is left is still to come (:func:`inside`).

Windows are partitioned by the document. A document is bounded by the size limit of
:func:`corpus.parse_nodes`, so no partition grows with the corpus; one exchange serves all windows
of a plan and the aggregation by node after them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Elements whose text no reader sees, and headings.
SILENT = ("head", "noscript", "script", "style", "template")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What Python's ``str.split`` takes for white space.
_SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]+"


def squeezed(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def _so_far(keys: Sequence[str], by: str, before: bool = False):
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)


def tour(nodes: DataFrame, keys: Sequence[str], measures: dict[str, Column], carry: Sequence[str] = (), shade: Column | None = None, shaded: Sequence[str] = ()) -> DataFrame:
    """keys, node_id, ``carry``, and for every measure its sum over what is below each node, and as ``<name>_before`` over all that was entered before it.

    Measures are taken of every node, nulls as 0. Those named in ``shaded`` count only outside of elements for which ``shade`` holds;
    a shaded element's own measure does not count either.
    """
    own = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    value = {n: F.coalesce(m.cast("long"), F.lit(0)) for n, m in measures.items()}
    dark = F.coalesce(shade, F.lit(False)).cast("int") if shade is not None else F.lit(0)
    zeros = [F.lit(0).cast("long").alias(f"_{n}") for n in value]
    enter = F.struct(F.col("pre").alias("_at"), F.lit(True).alias("_enters"), dark.alias("_dark"), own.alias("_own"), *[v.alias(f"_{n}") for n, v in value.items()])
    leave = F.struct(F.col("post").alias("_at"), F.lit(False).alias("_enters"), (-dark).alias("_dark"), F.when(F.lit(False), own).alias("_own"), *zeros)
    events = nodes.select(*keys, "node_id", F.inline(F.array(enter, leave)))
    if shade is not None:
        events = events.withColumn("_depth", F.sum("_dark").over(_so_far(keys, "_at")))
    counted = {f"_{n}": F.when(F.col("_depth") == 0, F.col(f"_{n}")).otherwise(0) if n in shaded else F.col(f"_{n}") for n in value}
    events = events.withColumns({f"_run{n}": F.sum(v).over(_so_far(keys, "_at")) for n, v in counted.items()} | {f"_got{n}": v for n, v in counted.items()})
    at = lambda column, enters: F.max(F.when(F.col("_enters") == enters, F.col(column)))
    sums = [x for n in value for x in (at(f"_run_{n}", True).alias(f"_in{n}"), at(f"_run_{n}", False).alias(f"_out{n}"), at(f"_got_{n}", True).alias(f"_self{n}"))]
    per_node = events.groupBy(*keys, "node_id").agg(F.any_value("_own", True).alias("_own"), *sums)
    out = [x for n in value for x in ((F.col(f"_out{n}") - F.col(f"_in{n}")).alias(n), (F.col(f"_in{n}") - F.col(f"_self{n}")).alias(f"{n}_before"))]
    return per_node.select(*keys, "node_id", *([f"_own.{c}" for c in carry]), *out)


def inside(nodes: DataFrame, keys: Sequence[str], marked: Column, name: str = "inside") -> DataFrame:
    """``nodes`` with a column that tells whether a node lies in an element for which ``marked`` holds, itself left out."""
    latest = F.max(F.when(F.coalesce(marked, F.lit(False)), F.col("post"))).over(_so_far(keys, "pre", before=True))
    return nodes.withColumn(name, F.coalesce(latest > F.col("pre"), F.lit(False)))


def maximal(nodes: DataFrame, keys: Sequence[str], marked: Column) -> DataFrame:
    """The nodes for which ``marked`` holds and that lie in no other such node: the roots of marked subtrees."""
    return inside(nodes.withColumn("_marked", F.coalesce(marked, F.lit(False))), keys, F.col("_marked"), "_inside").where("_marked AND NOT _inside").drop("_marked", "_inside")


def is_element(*tags: str) -> Column:
    """That a node is an element with one of these tags."""
    return (F.col("kind") == "element") & F.col("tag").isin(*tags)


def subtree_counts(nodes: DataFrame, keys: Sequence[str], carry: Sequence[str] = ("tag", "path")) -> DataFrame:
    """keys, node_id, ``carry`` of each element, and of what is below it: elements, links, headings, items, paragraphs and visible_chars.

    Visible characters are those of texts and image texts outside of silent elements, white space squeezed, one space between them.
    """
    said = F.when(F.col("kind") == "text", squeezed(F.col("text"))).when(is_element("img"), squeezed(F.col("attrs")["alt"]))
    measures = {
        "elements": F.col("kind") == "element", "links": is_element("a"), "headings": is_element(*HEADINGS), "items": is_element("li"), "paragraphs": is_element("p"),
        "chars": F.when(said != "", F.length(said) + 1),
    }
    found = tour(nodes, keys, measures, ["kind", *carry], is_element(*SILENT), ["chars"]).where("kind = 'element'")
    chars = F.greatest(F.col("chars") - 1, F.lit(0)).alias("visible_chars")
    return found.select(*keys, "node_id", *carry, *[n for n in measures if n != "chars"], chars)


def text_content(nodes: DataFrame, keys: Sequence[str], wanted: Column, carry: Sequence[str] = ("tag", "path")) -> DataFrame:
    """keys, node_id, ``carry`` and the content (all text below, as it stands) of each node for which ``wanted`` holds.

    The texts of a document are gathered once, in order; the texts below a node are a range of them, cut out by position.
    """
    named = nodes.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    held = ["kind", "text", "pre", "_wanted", *[c for c in carry if c not in ("kind", "text", "pre")]]
    found = tour(named.where("kind = 'text' OR _wanted"), keys, {"texts": F.col("kind") == "text"}, held)
    texts = F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("pre", "text")))).getField("text").alias("_texts")
    nodes_ = F.collect_list(F.when(F.col("_wanted"), F.struct("node_id", *carry, "texts_before", "texts"))).alias("_found")
    gathered = found.groupBy(*keys).agg(texts, nodes_).select(*keys, "_found", F.explode(F.array("_texts")).alias("_texts"))  # a step of its own: made once a document, not once a node
    content = lambda f: F.array_join(F.slice("_texts", (f["texts_before"] + 1).cast("int"), f["texts"].cast("int")), "")
    each = F.transform("_found", lambda f: F.struct(f["node_id"].alias("node_id"), *[f[c].alias(c) for c in carry], content(f).alias("content")))
    return gathered.select(*keys, F.inline(each))


def list_markers(nodes: DataFrame, keys: Sequence[str], carry: Sequence[str] = ("path",)) -> DataFrame:
    """keys, node_id, ``carry``, ordinal and marker of each ``li``: its number in an ordered list (null elsewhere), and what a reader sees before it.

    A segmented scan: an ordered list and its items are a group, whose first row is the list. An item counts on from the last
    item with a value of its own, or from the list's start (1, or in a reversed list the number of its items), up or down.
    """
    item, ordered = is_element("li"), is_element("ol")
    number = lambda name: F.when(F.col("attrs")[name].rlike("^[+-]?[0-9]+$"), F.col("attrs")[name].try_cast("bigint"))
    group = Window.partitionBy(*keys, "_list").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, "_list")
    rows = nodes.where(item | ordered).withColumns({"_list": F.when(ordered, F.col("node_id")).otherwise(F.col("parent_id")), "_own": F.when(item, number("value")), "_start": F.when(ordered, number("start")), "_back": ordered & F.map_contains_key("attrs", F.lit("reversed"))})
    # an ordered list that is itself a child of a list is the head of its own group alone
    rows = rows.withColumns({"_at": F.sum(item.cast("int")).over(group), "_items": F.sum(item.cast("int")).over(whole), "_head": F.first(F.when(ordered, F.struct("_start", "_back")), True).over(group)})
    rows = rows.withColumn("_last", F.last(F.when(F.col("_own").isNotNull(), F.struct("_own", "_at")), True).over(group))
    step, wide = F.when(F.col("_head._back"), -1).otherwise(1), lambda c: c.cast("decimal(21,0)")
    begun = F.coalesce(wide(F.col("_head._start")), wide(F.when(F.col("_head._back"), F.col("_items")).otherwise(1)))
    at = F.when(F.col("_last").isNotNull(), wide(F.col("_last._own")) + step * (F.col("_at") - F.col("_last._at"))).otherwise(begun + step * (F.col("_at") - 1))
    ordinal = F.when(F.col("_head").isNotNull(), at)
    return rows.where(item).select(*keys, "node_id", *carry, ordinal.cast("string").alias("ordinal"), F.coalesce(F.concat(ordinal.cast("string"), F.lit(". ")), F.lit("- ")).alias("marker"))
