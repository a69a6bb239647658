"""Personal data by candidate gradient boosting (native: column expressions only).

Base rules (``email``, ``ip``, ``card``, ``phone``) always stay. Further generators with
high recall propose spans that may overlap each other: local phone numbers, identity
numbers, account numbers and e-mail addresses written out. Boosted trees score each
proposal from its format and the words around it, a logistic curve calibrates the score,
and proposals at or above the kind's threshold that touch no base span are reported, if they
overlap no proposal with a better score (of equal scores: an earlier start).

A proposal's features are its format (lengths, digits, whether it can be a number of its kind, check
digits, domain ends), how it is joined to what stands before and after, and the words before it, hashed into
``BUCKETS`` buckets: which words matter is learnt, none are listed. The trees are fitted on the driver over a
synthetic set drawn from a fixed seed (``TRAINING_SIZE`` proposals per kind; no corpus has labelled spans): half of
it for the trees, a quarter for the calibration and a quarter for the thresholds. A word that training
never saw says nothing, so there the form decides: a number that can be of its kind is reported, a code that can not is
left. Tests measure precision and recall with words that training never saw. The trees are
evaluated as Catalyst expressions over the few proposals of a row: no Python on the executors, no shuffle.

Null and empty texts have no spans; rows keep any doc_id; repeated rows give repeated
results; other columns are ignored whatever their names.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from functools import cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import bound

from . import boosting
from .common import fresh
from .spans import LOCATED, SPAN, as_spans, free_of, located, looking, written

KINDS = ["email", "ip", "card", "phone", "local", "identity", "account", "spelled"]
# A match may start at the start of its run or where the last match ended; so each run is read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
#: A text without this holds no card: eleven digits with single separators.
CARD_HINT = r"[0-9](?:[\x20-]?[0-9]){11}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Proposals: kind number to pattern.
PROPOSED = {
    4: r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])",
    5: r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    6: r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}\x20?(?:[A-Z0-9]{4}\x20?){2,7}[A-Z0-9]{1,4}(?![0-9A-Za-z])",
    7: r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{2,40}(?:\x20?[\[(][Aa][Tt][\])]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{2,40}(?:\x20?[\[(][Dd][Oo][Tt][\])]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z]{2,10}(?![A-Za-z])",
}
#: A text without this holds no address written out.
SPELLED_HINT = r"(?:[\[(]|\x20)(?:dot|DOT|Dot)[\])\x20]"
NUMBERED = r"(?:#|\b[Nn]o\.?|\b[Nn]r\.?)\x20*$"
# Ends of frequent domains; shapes that numbers of a kind can have (first digits, and blocks that are never zero).
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|dev|de|fr|es|it|nl|uk|eu|ch|at|us|ca)$"
POSSIBLE = {4: "^[2-9][0-9]{2}[2-9][0-9]{6}$", 5: "^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"}
AROUND, TRAINING_SIZE, PRECISION, BUCKETS = 32, 2400, 0.95, 4096
#: Hashed words that fewer proposals of the training set have are not learnt from.
SUPPORT = 8


def _iban(m: str) -> bool:
    raw = m.replace(" ", "")
    return len(raw) > 4 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def _features(m: str, before: str, after: str, kind: int) -> list[float]:
    """The training side of :func:`_feature_columns`; both must stay alike."""
    digits = re.sub("[^0-9]", "", m)
    return [
        float(len(m)), float(len(digits)), float(len(set(digits))), float(bool(re.search(POSSIBLE.get(kind, "^$"), digits))), float(bool(re.search(DOMAINS, m))),
        float(bool(re.match("[A-Za-z0-9%$]", after))), float("(" in m or "[" in m), float(len(re.sub("[^ ]", "", m))),
        float(bool(re.search("[0-9]$", before.strip(" ")))), float(bool(re.search(r"[:=]\x20*$", before))), float(bool(re.search(NUMBERED, before))),
        float(kind == 6 and _iban(m)), float(bool(re.match(r"[A-Za-z0-9]*[0-9][A-Za-z0-9]*\x20", m))), float("." in m),
    ]


def _feature_columns(m: Column, before: Column, after: Column, kind: int) -> list[Column]:
    digits = F.regexp_replace(m, "[^0-9]", "")
    yes = lambda c: c.cast("double")
    raw = F.regexp_replace(m, " ", "")
    chars = F.filter(F.split(F.concat(F.substring(raw, F.lit(5), F.length(raw)), F.substring(raw, 1, 4)), ""), lambda c: c != "")
    rest = F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97)
    return [
        yes(F.length(m)), yes(F.length(digits)), yes(F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda d: d != "")))), yes(digits.rlike(POSSIBLE.get(kind, "^$"))), yes(m.rlike(DOMAINS)),
        yes(after.rlike("^[A-Za-z0-9%$]")), yes(m.contains("(") | m.contains("[")), yes(F.length(F.regexp_replace(m, "[^ ]", ""))),
        yes(F.trim(before).rlike("[0-9]$")), yes(before.rlike(r"[:=]\x20*$")), yes(before.rlike(NUMBERED)),
        yes(rest == 1) if kind == 6 else F.lit(0.0), yes(m.rlike(r"^[A-Za-z0-9]*[0-9][A-Za-z0-9]*\x20")), yes(m.contains(".")),
    ]


def _words(before: str) -> set[int]:
    """The buckets of the words before a proposal; alike :func:`_word_column`."""
    return {zlib.crc32(w.encode()) % BUCKETS for w in re.findall("[a-z]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in before))}


def _word_column(before: Column) -> Column:
    low = F.translate(before, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda w: (F.crc32(w.cast("binary")) % BUCKETS).cast("int"))


_w = lambda s: tuple(s.split("|"))
#: What stands before proposals in training: of persons by kind, and (0) of other things; then what says nothing.
LEADS = {
    4: _w("call me at|phone:|tel|mobile|my cell is|fax:|ring|contact us on|whatsapp|office phone|please call|reach Anna on|text|his mobile is|contact:|telephone number|dial|number is|tel.|cell"),
    5: _w("my ssn is|social security|ssn:|identity number|taxpayer|her ssn|social security no.|passport or identity|the taxpayer id|tax id|social insurance|ssn"),
    6: _w("iban|bank account|transfer to|account:|pay into account|my iban is|our bank details|transfer money to|account number|remit to|credit to"),
    7: _w("mail me:|write to|contact|reach us:|e-mail|my email is|please write to|contact me via|reach the author at|email|send to"),
    0: _w("order|invoice no|part|serial|version|ticket|see page|the total|item|batch|model #|tracking|catalog|parts no.|case|sku|license|see table|build|ref|lot|product|article no|isbn|figure|release|docket|unit"),
}
FILLER = _w("lorem ipsum|and then|we saw|in the end|it was|so|of the|they said|maybe|as noted|here is|with|that evening|under|for some|or|the old|a new|again|after")
#: What stands before proposals in the tests; training saw none of the leads.
UNSEEN = {
    4: _w("Emergency line|Hotline:|Support desk|T:|Voice|Ping us:|Give me a buzz:|switchboard|Reception|after hours"),
    5: _w("SSNs such as|pension file|Beneficiary|payroll lists|W-2 shows|Claimant"),
    6: _w("Kontoverbindung|beneficiary|wire it via|deposit at|payee"),
    7: _w("ping|questions go to|maintainer:|editor|get in touch:"),
    0: _w("gizmo|shelf|firmware|barcode|revision|crate|locker|pallet|chassis|blueprint"),
}


def _form(kind: int, good: int, rng: random.Random) -> str:
    """A proposal that can be of its kind, or one that merely looks like it."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10)))
    if kind == 4:
        first, second = ("23456789", "23456789") if good else rng.choice((("01", "0123456789"), ("0123456789", "01")))
        area, rest = f"{rng.choice(first)}{d(2)}", f"{rng.choice(second)}{d(2)}"
        return f"({area}) {rest}-{d(4)}" if rng.random() < (0.4 if good else 0.1) else f"{area}{(s := rng.choice('-. '))}{rest}{rng.choice((s, '-'))}{d(4)}"
    if kind == 5:
        if good:
            return f"{rng.choice('1234578')}{d(2)}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
        return rng.choice((f"000-{d(2)}-{d(4)}", f"666-{d(2)}-{d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"{d(3)}-{d(2)}-0000"))
    if kind == 6:
        country, n = rng.choice((("DE", 18), ("GB", 18), ("FR", 23), ("NL", 14), ("ES", 20)))
        body = ("ABCD" if country in ("GB", "NL") else "") + d(n - 4 * (country in ("GB", "NL")))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97 if good else int(d(2))
        m = f"{country if good else rng.choice(('AB', 'XK', 'DE', 'PN'))}{check:02d}{body if good else body[: rng.randrange(9, len(body) + 1)]}"
        return " ".join(m[j : j + 4] for j in range(0, len(m), 4)) if rng.random() < 0.6 else m
    a, b = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), (" at ", " dot ")))
    return f"{name()}{rng.choice(('', '.' + name()))}{a}{name()}{b}{rng.choice(('com', 'org', 'net', 'de', 'edu', 'io', 'fr')) if good else name()}"


def _drawn(kind: int, size: int, unseen: bool = False) -> list[tuple[str, str, str, int]]:
    """Proposals (itself, before, after, whether personal) drawn with a fixed seed."""
    rng, leads, out = random.Random(kind + 100 * unseen), UNSEEN if unseen else LEADS, []
    for i in range(size):
        y, plain = i % 2, rng.random() < 0.4  # many have no lead: their form alone has to tell
        lead = rng.choice(FILLER) if plain else rng.choice(leads[kind if y else 0])
        before = f"{rng.choice(FILLER)} {lead}{rng.choice((' ', ' ', ': '))}"[-AROUND:]
        rare = 0.03 if plain or unseen else 0.3  # a known word may stand before a form of the other kind
        good = y if rng.random() >= rare else 1 - y
        out.append((_form(kind, good, rng), before, rng.choice([" ", ".", "", ",", " "]) if good else rng.choice([" ", "%", ".", ",", " "]), y))
    return out


def _matrix(rows: list[tuple[str, str, str, int]], kind: int, buckets: list[int]) -> np.ndarray:
    words = [_words(before) for _, before, _, _ in rows]
    return np.array([[*_features(m, before, after, kind), *[float(b in w) for b in buckets]] for (m, before, after, _), w in zip(rows, words, strict=True)])


@cache
def models() -> dict[int, tuple[list, list[int], float, float, float]]:
    """kind -> trees, the buckets of their features after the format's, calibration slope and offset, threshold on the calibrated score."""
    out = {}
    for kind in PROPOSED:
        rows = _drawn(kind, TRAINING_SIZE)
        seen = Counter(b for _, before, _, _ in rows for b in _words(before))
        buckets = sorted(b for b, n in seen.items() if n >= SUPPORT)
        x, y = _matrix(rows, kind, buckets), np.array([r[3] for r in rows], float)
        part = np.arange(len(y)) // 2 % 4
        trees = boosting.fit(x[part < 2], y[part < 2], trees=28, depth=3)
        a, b = boosting.calibrate(sum(boosting.evaluate(t, x[part == 2]) for t in trees), y[part == 2])
        margin = sum(boosting.evaluate(t, x[part == 3]) for t in trees)
        out[kind] = trees, buckets, a, b, max(0.5, boosting.threshold(1 / (1 + np.exp(-(a * margin + b))), y[part == 3], PRECISION))
    return out


def measured(kind: int, size: int = 2000) -> tuple[float, float]:
    """Precision and recall of one kind's selection over proposals whose leads training never saw."""
    trees, buckets, a, b, least = models()[kind]
    rows = _drawn(kind, size, unseen=True)
    x, y = _matrix(rows, kind, buckets), np.array([r[3] for r in rows], float)
    chosen = 1 / (1 + np.exp(-(a * sum(boosting.evaluate(t, x) for t in trees) + b))) >= least
    return float(y[chosen].mean()) if chosen.any() else 0.0, float(chosen[y == 1].mean())


def _luhn(m: Column) -> Column:
    digits = F.reverse(F.filter(F.split(m, ""), lambda c: c.rlike("^[0-9]$")))
    value = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2))
    return F.aggregate(value, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _n_digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


#: How many features tell the format; hashed words follow.
FORMAT = len(_features("", "", "", 4))


def _proposals(t: Column, kind: int) -> Column:
    """Scored proposals of one kind as (-score, s, k, e), those below the threshold left out."""
    trees, buckets, a, b, least = models()[kind]

    def scored(x: Column) -> Column:
        before = F.substring(t, F.greatest(x["s"] - AROUND + 1, F.lit(1)), F.least(x["s"], F.lit(AROUND)))
        after = F.substring(t, x["e"] + 1, F.lit(1))
        return F.struct(F.array(*_feature_columns(x["m"], before, after, kind)).alias("f"), _word_column(before).alias("w"), x["s"].alias("s"), x["e"].alias("e"))

    def judged(x: Column) -> Column:
        margin = boosting.as_column(trees, lambda j: x["f"][j] if j < FORMAT else F.array_contains(x["w"], buckets[j - FORMAT]).cast("double"))
        return F.struct((-1 / (1 + F.exp(-(a * margin + b)))).alias("p"), x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"))

    found = F.transform(F.transform(located(t, PROPOSED[kind]), scored), judged)
    return F.filter(found, lambda x: x["p"] <= -least)


def with_spans(docs: DataFrame, text: str = "text", base: str = "base", selected: str = "selected") -> DataFrame:
    """``docs`` with the base spans and the selected proposals of every whole text."""
    t, none = F.coalesce(F.col(text).cast("string"), F.lit("")), F.array().cast(SPAN)
    some = F.array().cast("array<struct<p:double,s:int,k:int,e:int>>")
    small = lambda m: ~F.exists(F.split(m, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")) > 3) & ~F.exists(
        F.split(m, r"\."), lambda part: F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.substring(F.regexp_replace(part, "^0+", ""), 1, 3)), F.lit("9999")).cast("int"), F.lit(0)) > 255)
    located_none = F.array().cast(LOCATED)
    card = F.filter(F.when(t.rlike(CARD_HINT), located(t, CARD)).otherwise(located_none), lambda x: _n_digits(x["m"]).between(12, 19))
    plus = F.filter(F.when(t.contains("+"), located(t, PHONE)).otherwise(located_none), lambda x: _n_digits(x["m"]).between(9, 15))
    rules = [
        F.when(t.contains("@"), as_spans(located(t, EMAIL), 0)).otherwise(none),
        as_spans(F.filter(located(t, IP), lambda x: small(x["m"])), 1),
        as_spans(F.filter(card, lambda x: _luhn(x["m"])), 2), as_spans(plus, 3),
    ]
    tmp = [fresh(docs, f"_{base}_p{i}") for i in range(2)]
    out = docs.withColumns({base: F.array_sort(F.concat(*rules)), tmp[0]: F.concat(
        F.when(t.rlike(r"[0-9]{3}[.\x20-][0-9]{4}"), _proposals(t, 4)).otherwise(some), F.when(t.rlike("[0-9]-[0-9]{2}-[0-9]"), _proposals(t, 5)).otherwise(some),
        _proposals(t, 6), F.when(t.rlike(SPELLED_HINT), _proposals(t, 7)).otherwise(some))})
    strong = [F.filter(base, lambda x, k=k: x["k"] == k) for k in range(4)]
    out = out.withColumn(tmp[1], F.when(F.size(tmp[0]) > 0, bound(F.col(tmp[0]), lambda x: free_of(x, strong))).otherwise(some))
    return out.withColumn(selected, F.when(F.size(tmp[1]) > 0, bound(F.col(tmp[1]), _best)).otherwise(none)).drop(*tmp)


def _best(proposals: Column) -> Column:
    """The spans of those that overlap no proposal with a better score (of equal ones: an earlier start, a smaller kind)."""
    kinds = [F.array_sort(F.filter(proposals, lambda x, k=k: x["k"] == k), lambda a, b: a["s"] - b["s"]) for k in PROPOSED]

    def chosen(looks: list) -> Column:
        better = lambda y, x: F.struct(y["p"], y["s"], y["k"]) < F.struct(x["p"], x["s"], x["k"])
        beaten = lambda x, between: F.exists(between(x["s"], x["e"]), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]) & better(y, x))
        return F.filter(proposals, lambda x: ~reduce(or_, [beaten(x, between) for between in looks]))

    return F.transform(looking(kinds, chosen), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans, all spans."""
    out = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "selected"), KINDS).alias("spans"), F.size("selected").cast("long").alias("n_selected"),
    )
