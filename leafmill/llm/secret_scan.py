"""Secret scans by multipart credential linking (native: column expressions only).

Strong secrets (``assign``, ``access``, ``hex``) are reported wherever they match.
Weak parts mean little alone and are reported only where complementary parts start
within ``reach`` code points of them. The interval join sorts the parts of a role into
windows of the text and looks only into the windows that the scope touches, so its work
grows with the number of parts and never with their pairs. Everything is computed inside
the row: no shuffle, and no row depends on another, so skewed sources and repeated rows
change nothing.

Roles: identifiers (``ident`` and strong ``access``), secrets (``weak`` and strong
``assign``), endpoints (``endpoint``). Reported weak parts:

* ``weak``: an assigned value of 4 to 7 characters, or a loose 40-character base64
  word mixing cases and digits, with an identifier or an endpoint in scope;
* ``ident``: with a secret in scope;
* ``endpoint``: with an identifier and a secret in scope.

Null and empty texts have no spans; rows keep any doc_id, null included; repeated
rows give repeated results; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import bound

from .common import fresh
from .spans import SPAN, as_spans, free_of, located, masked, within, written

KINDS = ["assign", "access", "hex", "ident", "weak", "endpoint"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
IDENT = r"""(?i:access_?key_?id|client_?id|user_?name|login|account)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9._@-]{3,}+"""
LOOSE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?:https?|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9.-]{3,}+(?::[0-9]{1,5})?"
REACH = 256


def with_spans(docs: DataFrame, text: str = "text", base: str = "base", linked: str = "linked", reach: int = REACH) -> DataFrame:
    """``docs`` with the strong spans (``base``) and the linked weak spans (``linked``) of every whole text."""
    t, none, tmp = F.coalesce(F.col(text).cast("string"), F.lit("")), F.array().cast(SPAN), [fresh(docs, f"_{base}_{i}") for i in range(7)]
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2))
    mixed = lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]")
    out = docs.withColumns({
        tmp[0]: located(t, ASSIGN),
        tmp[1]: F.when(t.contains("AKIA"), as_spans(located(t, ACCESS), 1)).otherwise(none),
        tmp[2]: F.when(t.rlike("[0-9A-Za-z+/]{32}"), F.struct(as_spans(located(t, HEX), 2).alias("hex"), as_spans(F.filter(located(t, LOOSE), mixed), 4).alias("loose"))),
    })
    out = out.withColumns({
        tmp[3]: as_spans(F.filter(F.col(tmp[0]), lambda x: value(x).between(4, 7)), 4), tmp[6]: F.coalesce(F.col(tmp[2])["loose"], none),
        base: F.array_sort(F.concat(as_spans(F.filter(F.col(tmp[0]), lambda x: value(x) >= 8), 0), F.col(tmp[1]), F.coalesce(F.col(tmp[2])["hex"], none))),
    })
    held = F.size(tmp[3]) + F.size(tmp[6]) + F.size(base) > 0  # identifiers and endpoints only count beside a secret
    out = out.withColumns({
        tmp[4]: F.when(held, as_spans(located(t, IDENT), 3)).otherwise(none),
        tmp[5]: F.when(held, as_spans(located(t, ENDPOINT), 5)).otherwise(none),
    })
    strong = [F.filter(base, lambda x, k=k: x["k"] == k) for k in range(3)]
    values, idents, ends, loose = (F.col(tmp[i]) for i in (3, 4, 5, 6))
    secrets, named = [values, loose, strong[0]], [idents, strong[1]]
    some = lambda spans, then: F.when(F.size(spans) > 0, bound(spans, then)).otherwise(none)
    found = F.concat(
        some(F.concat(values, loose), lambda x: free_of(within(x, [*named, ends], reach), strong)),
        some(idents, lambda x: free_of(within(x, secrets, reach), strong)),
        some(ends, lambda x: within(within(x, named, reach), secrets, reach)),
    )
    return out.withColumn(linked, F.when(held, found).otherwise(none)).drop(*tmp)


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: counts of strong kinds, digest of the strong spans, all spans."""
    out = with_spans(docs.select("doc_id", "text"), reach=reach)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "linked"), KINDS).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """``docs`` with every strong span and every linked weak secret masked and n_chars, if there, recounted; all rows stay."""
    base, linked, shown, hidden = (fresh(docs, f"_secret_{n}") for n in ("base", "linked", "text", "n"))
    out = with_spans(docs, base=base, linked=linked, reach=reach)
    hide = F.concat(base, F.filter(linked, lambda x: x["k"] == 4))
    # under a name of its own first: beside an alias "text", "text" inside a lambda would mean that alias
    out = out.withColumns({shown: masked(F.col("text"), hide, mark), hidden: F.size(hide)})
    count = F.when(F.col(hidden) > 0, F.length(shown)).otherwise(F.col("n_chars") if "n_chars" in docs.columns else None)
    replaced = {"text": F.col(shown), "n_chars": count}
    return out.select(*[replaced[c].cast(docs.schema[c].dataType).alias(c) if c in replaced else F.col(f"`{c}`") for c in docs.columns])
