"""Ranking of candidate containers as joins and windows, against the summary made document by document."""

import random

import pytest
from pyspark.sql import types as T

from leafmill.functions.html_parser import parse
from leafmill.functions.inspect import Candidate, promoted, ranked
from leafmill.operators import candidates, corpus
from leafmill.operators.corpus import node_rows
from leafmill.sources.tables import kept

KEY = ["page_id"]


def text(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))


def content(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if kind < 0.35 and depth < 5:
            tag = rng.choice(["article", "main", "section", "div"])
            attrs = rng.choice(["", "", ' class="content"', ' class="post body"', ' id="story"', ' role="main"', ' itemprop="articleBody"', ' class="main entry"', ' class="primary share"'])
            out.append(f"<{tag}{attrs}>{content(rng, depth + 1)}</{tag}>")
        elif kind < 0.5:
            out.append(f"<h{rng.randrange(1, 4)}>{text(rng, 4)}</h{rng.randrange(1, 4)}>" * rng.choice([1, 1, 1, 30]))
        elif kind < 0.65:
            out.append("<ul>" + "".join(f'<li><a href="/p{rng.randrange(99)}">{text(rng, 3)}</a></li>' for _ in range(rng.choice([2, 5, 25, 130]))) + "</ul>")
        elif kind < 0.75:
            out.append(f'<div class="sidebar">{text(rng, 5)}</div>')
        else:
            out.append("".join(f"<p>{text(rng, rng.choice([8, 60, 200]))}</p>" for _ in range(rng.randrange(1, 5))))
    return "".join(out)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(23)
    nest = lambda inner: f'<body><article><h1>Title here</h1><div class="content">{inner}</div>{{}}</article></body>'
    rows = [(i, f"<body>{content(rng)}{content(rng)}</body>") for i in range(250)]
    rows += [(900 + i, nest("".join(f"<p>{text(rng, 100)}</p>" for _ in range(4))).format(f"<ul>{'<li><a href=/x>some more words</a></li>' * k}</ul>")) for i, k in enumerate((0, 10, 22, 60, 140))]
    rows += [(950, None), (951, ""), (952, "<p>little")]
    return spark.createDataFrame(rows, "page_id long, html string").repartition(6).cache()


@pytest.fixture(scope="module")
def found(docs):
    return candidates.measured(docs).cache()


@pytest.mark.parametrize("block", [candidates.BLOCK, 8])
def test_recommendations_equal_the_summary(docs, found, block):
    want = {}
    for r in corpus.inspect(docs).collect():
        for purpose in ("reading", "extraction"):
            for k, c in enumerate(r[f"{purpose}_candidates"], 1):
                want[r.page_id, purpose, k] = (c.selector, c.path, c.tag_name, c.text_char_count, c.heading_count, c.link_count)
    got = {(r.page_id, r.purpose, r.rank): (r.selector, r.path, r.tag, r.chars, r.headings, r.links) for r in candidates.recommended(found, KEY, block=block).collect()}
    assert got == want and len(want) > 400


def test_every_pair_meets_once(found):
    rows = found.collect()
    want = sorted((a.page_id, a.path, b.path) for a in rows for b in rows if a.page_id == b.page_id and b.path.startswith(a.path + " > "))
    for block in (candidates.BLOCK, 4):
        assert sorted((r.page_id, r.o_path, r.i_path) for r in candidates.nested(found, KEY, block).collect()) == want
    assert len(want) > 100


def invented(rng):
    """Candidates of one document that contain each other, with numbers near the rules' limits."""
    out, clock = [], [0]

    def grow(path, chars, depth):
        number, pre = len(out), clock[0]
        clock[0] += 1
        tag, links, headings = rng.choice(["article", "main", "section", "div"]), rng.choice([0, 3, 9, 25, 70, 130]), rng.choice([0, 1, 3, 6, 30])
        path = f"{path} > {tag}:nth-of-type({number + 1})" if path else f"{tag}:nth-of-type({number + 1})"
        level = rng.choice([None, 1, 2])
        selector = rng.choice([path, f"#id{number}", f"{tag}.c{number}", f".c{number}", f'{tag}[role="main"]', tag])
        values = {
            "chars": chars, "headings": headings, "links": links, "blocks": rng.choice([0, 1, 3, 12]), "level": level, "primaries": rng.randrange(3), "depth": None if level is None else rng.randrange(1, 8),
            "utility": rng.choice([0, 1, 8, 14]), "main_role": rng.random() < 0.2, "body_prop": rng.random() < 0.2, "positive": rng.randrange(4), "negative": rng.randrange(2),
        }
        at = len(out)
        out.append(None)
        for _ in range(rng.randrange(3) if depth < 4 else 0):
            grow(path, max(30, int(chars * rng.choice([0.15, 0.72, 0.91, 0.96, 1.0]))), depth + 1)
        out[at] = (Candidate(selector, path, tag, **values), pre, clock[0])
        clock[0] += 1

    for _ in range(rng.randrange(1, 3)):
        grow("", rng.choice([300, 2000, 9000]), 0)
    return out


def test_ranks_and_promotions_of_invented_candidates(spark):
    rng, rows, want, changed = random.Random(41), [], {}, 0
    for page in range(400):
        made = invented(rng)
        rows += [(page, *[getattr(c, n, None) if n not in ("node_id", "pre", "post") else {"node_id": k, "pre": pre, "post": post}[n] for n in candidates.MEASURED.names]) for k, (c, pre, post) in enumerate(made)]
        all_ = [c for c, _, _ in made]
        reading, extraction = ranked(all_, True, 8), ranked(all_, False, 8)
        final = promoted(extraction, reading) if extraction else list(reading)
        changed += bool(extraction) and final[0].path != extraction[0].path
        for purpose, listed in (("reading", reading), ("extraction", final)):
            want |= {(page, purpose, k): (c.path, c.score) for k, c in enumerate(listed, 1)}
    schema = T.StructType([T.StructField("page_id", T.IntegerType()), *candidates.MEASURED.fields])
    found = kept(candidates.judged(spark.createDataFrame(rows, schema)), "invented")
    got = {(r.page_id, r.purpose, r.rank): (r.path, r.score) for r in candidates.recommended(found, KEY, block=16).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v for k, v in got.items() if k[1] == "reading"} == {k: v for k, v in want.items() if k[1] == "reading"}
    assert changed > 10


def test_times_are_those_of_the_node_table():
    document = parse("<table>a<tr>b<td>c</table><p>d<b>e<p>f")
    want = {r["path"]: (r["node_id"], r["pre"], r["post"]) for r in node_rows(document) if r["kind"] == "element"}
    assert candidates.times(document) == want
