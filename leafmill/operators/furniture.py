"""Page furniture told from content, with built-in functions over the node table.

What an element's own names say is a column expression (:func:`hits`); what is below it comes from running sums
round the tree (:mod:`intervals`), what comes next from one window backwards, and what it lies in from the interval
of the latest marked element. Nothing is joined; all windows share the document's one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chrome import CONTENT, CONTROLS, FOOTER, LAYOUT, NAMED, PARAGRAPHS, RICH, ROLES, STRONG, UTILITY
from .intervals import _SPACE, HEADINGS, inside, is_element, tour

#: A box with a link or two is a widget up to so many characters; content is looked for in so many elements.
WIDGET_CHARS, LOOKED_AT = 64, 256
_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(c: Column) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.translate(c, *_FOLD)


def attribute(name: str) -> Column:
    return folded(F.coalesce(F.col("attrs")[name], F.lit("")))


def names() -> Column:
    """The words of an element's tag and of the attributes that name it, as an array."""
    data = lambda e: e["key"].startswith("data-") & ~e["key"].isin(*NAMED)
    telling = F.filter(F.map_entries("attrs"), lambda e: e["key"].isin(*NAMED) | e["key"].startswith("aria-") | e["key"].startswith("data-"))
    said = F.transform(telling, lambda e: F.when(data(e), e["value"]).otherwise(F.concat(e["key"], F.lit(" "), e["value"])))
    text = folded(F.concat_ws(" ", F.col("tag"), F.array_join(F.coalesce(said, F.array().cast("array<string>")), " ")))
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))


def hits(words: Column, vocabulary: Sequence[str]) -> Column:
    """How many words of the vocabulary are among ``words``, or, with five letters and more, in one of them with at least three others."""
    among = lambda t, w: (t == w) | ((F.length(w) >= 5) & (F.length(t) > F.length(w) + 2) & F.contains(t, w))
    return F.size(F.filter(F.array(*[F.lit(w) for w in vocabulary]), lambda w: F.exists(words, lambda t: among(t, w))))


def hidden() -> Column:
    """That an element says itself that it is not to be seen: by attribute or style."""
    style = F.split(F.coalesce(F.col("attrs")["style"], F.lit("")), ";")
    name = lambda p: F.regexp_replace(F.substring_index(p, ":", 1), f"^{_SPACE}|{_SPACE}$", "")
    value = lambda p: folded(F.substring(p, F.instr(p, ":") + 1, F.length(p)))
    off = F.exists(style, lambda p: F.contains(p, F.lit(":")) & name(p).isin("display", "visibility") & (F.contains(value(p), F.lit("none")) | F.contains(value(p), F.lit("hidden"))))
    return (F.col("kind") == "element") & (_hidden_attribute() | off)


def _hidden_attribute() -> Column:
    return F.coalesce(F.map_contains_key("attrs", F.lit("hidden")), F.lit(False)) | (attribute("aria-hidden") == "true")


def marked(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node_id, kind, tag, path, pre, post, depth of every node, and whether it is ``chrome`` (furniture) and ``hidden``."""
    keep = ["kind", "tag", "path", "pre", "post", "depth"]
    words = nodes.withColumn("_words", F.when(F.col("kind") == "element", names()))
    hit = {f"_{n}": F.coalesce(hits(F.col("_words"), v), F.lit(0)) for n, v in (("content", CONTENT), ("utility", UTILITY), ("strong", STRONG), ("layout", LAYOUT), ("footer", FOOTER))}
    role = attribute("role")
    own = words.withColumns(hit | {
        "_hidden": hidden(), "_plain": F.col("tag").isin(*CONTROLS) | _hidden_attribute() | role.isin(*ROLES),
        "_surface": (F.col("tag") == "main") | (role == "main") | (attribute("itemprop") == "articlebody"),
        "_images": F.sum(is_element("img").cast("long")).over(Window.partitionBy(*keys).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    own = inside(own, keys, is_element(*HEADINGS), "_in_heading")
    element = F.col("kind") == "element"
    measures = {
        "inner": element, "images": is_element("img"), "links": is_element("a"), "late": F.when(is_element("a"), F.col("_images")), "rich": is_element(*RICH), "blocks": is_element(*PARAGRAPHS),
        "chars": F.when(F.col("kind") == "text", F.length(F.regexp_replace("text", _SPACE, ""))),
    }
    found = tour(own, keys, measures, [*keep, *hit, "_hidden", "_plain", "_surface", "_in_heading"])
    c, u, blocks = F.col("_content"), F.col("_utility"), F.col("blocks")
    many = (F.col("tag") == "article") & (blocks >= 2) | (c >= 2) & (u <= c) & (blocks >= 1) | (c >= 1) & (u == 0) & (blocks >= 3)
    found = found.withColumn("_surface", F.coalesce(element & (F.col("_surface") | many), F.lit(False)))
    after = Window.partitionBy(*keys).orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_next", F.min(F.when(F.col("_surface"), F.struct("pre", "inner_before"))).over(after))
    holds = F.coalesce((F.col("_next.pre") < F.col("post")) & (F.col("_next.inner_before") - F.col("inner_before") <= LOOKED_AT), F.lit(False))
    # with an image, a second link may follow it; an image before a link has been counted once more when the link is met
    follow = F.col("late") - F.col("links") * F.col("images_before")
    few_links = (F.col("links") <= 1) | (F.col("links") == 2) & (F.col("images") == 1) & (follow >= 1)
    widget = (c == 0) & F.col("tag").isin("aside", "div", "section") & ~F.col("_in_heading") & (F.col("rich") == 0) & (F.col("images") <= 1) & few_links
    widget &= (F.col("inner") > 0) & (F.col("chars") > 0) & (F.col("chars") <= WIDGET_CHARS)
    main = F.col("tag").isin("article", "main")
    chrome = (
        F.when(~element | F.col("tag").isin("html", "body"), False).when(F.col("_plain"), True).when(~main & (F.col("_strong") > 0), True).when(widget, True).when(main, False)
        .when(F.col("_footer") > 0, True).when((u > 0) & (c == 0) & (F.col("_layout") > 0) & holds, False).otherwise(u > c)
    )
    return found.select(*keys, "node_id", *keep, F.coalesce(chrome, F.lit(False)).alias("chrome"), F.coalesce("_hidden", F.lit(False)).alias("hidden"))


def clean(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The elements of :func:`marked` that are neither furniture nor lie in any."""
    return inside(marked(nodes, keys), keys, F.col("chrome"), "_in").where("kind = 'element' AND NOT chrome AND NOT _in").drop("_in")


def roots(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The roots of furniture (``why`` is chrome) and of what is hidden: keys, node_id, tag, path, why."""
    found = marked(nodes, keys)
    for name in (said := ("chrome", "hidden")):  # windows of one kind, so that nodes are marked and sorted once for both
        found = inside(found, keys, F.col(name), f"_in_{name}")
    why = F.array_compact(F.array(*[F.when(F.col(name) & ~F.col(f"_in_{name}"), name) for name in said]))
    return found.select(*keys, "node_id", "tag", "path", F.explode(why).alias("why"))


def utility_roots(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node_id, tag, path of each clean element, and how many roots of furniture are below it."""
    found = inside(marked(nodes, keys), keys, F.col("chrome"), "_in").withColumn("_clean", ~F.col("chrome") & ~F.col("_in"))
    counted = tour(found, keys, {"utility_roots": F.col("chrome") & ~F.col("_in")}, ["kind", "tag", "path", "_clean"])
    return counted.where("kind = 'element' AND _clean").select(*keys, "node_id", "tag", "path", "utility_roots")


