from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import main_content as M
from tessera.operators import frontier

TAGS = ["main", "nav", "div", "p", "b", "aside", "ul", "li"]


def plain(source, rules=M.Rules()):
    """Texts by a tree that is built first: (texts in main parts, those left out)."""
    root = ("", [], None)
    at = root
    for kind, value in source:
        if kind == "text":
            at[1].append(value)
        elif kind == "<":
            node = (value, [], at)
            at[1].append(node)
            at = node
        else:
            up = at
            while up is not root and up[0] != value:
                up = up[2]
            if up is not root:
                at = up[2]
    out = []

    def walk(node, main, hidden):
        main, hidden = main or node[0] in rules.main_tags, hidden or node[0] in rules.left_out
        for child in node[1]:
            if isinstance(child, tuple):
                walk(child, main, hidden)
            elif main and not hidden:
                out.append(child)

    walk(root, False, False)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_spans_give_what_a_tree_gives(seed):
    rng = random.Random(seed)
    source = [("<", "main")] if seed % 3 else []
    for n in range(40):
        kind = rng.choice(["<", "/", "text"])
        source.append((kind, f"w{n}" if kind == "text" else rng.choice(TAGS)))
    html = "".join(v if k == "text" else f"<{v}>" if k == "<" else f"</{v}>" for k, v in source)
    apart = [(k, v) for i, (k, v) in enumerate(source)]
    got = " ".join(M.extract(html)[1]).split()
    # neighbouring texts have no mark between them in the page
    assert "".join(got) == "".join(plain(apart))


def test_main_content_rules():
    page = """<title>A &amp; B</title><nav><main>menu</main></nav><p>before</p>
    <main><h1>One</h1><aside>x<nav>y</nav>z</aside><p>two <a href=" /a ">link <b>label</b></a> three<p>three</p><p>three</p>
    <div class="box share-row">no</div><div title="a menu">yes</div><!-- <main> --!><script>"</main>"</script><a href="/last">open</main><a href="/after">after</a>"""
    title, lines, links = M.extract(page)
    assert title == "A & B"
    assert lines == ["One", "two link label three", "three", "yes", "open"]
    assert links == [("/a", "link label"), ("/last", "open")]


def test_main_content_edges(spark):
    assert M.extract(None) == M.extract("") == ("", [], [])
    assert M.extract("<main>a < b <")[1] == ["a < b <"]
    assert M.extract("<main>open <!-- to the end")[1] == ["open"]
    assert M.extract('<main><p title="x>y">kept</p><p title="no end>lost')[1][0] == "kept"
    assert M.extract("<main>" + "<b>x " * 50_000)[1] == [" ".join(["x"] * 50_000)]
    df = spark.createDataFrame([(1, "<main>a　b<br>c</main>"), (2, None), (3, "")], "id long, html string")
    got = {r.id: list(r.lines) for r in df.select("id", M.main_content(F.col("html")).alias("m")).select("id", "m.lines").collect()}
    assert got == {1: ["a b", "c"], 2: [], 3: []}


def small(spark, extra=()):
    pages = [("a/", "a/", 50, None), ("a/1", "a/1", 50, None), ("a/2", "b/2", 50, None), ("a/3", "a/3", 5, None), ("a/4", "a/4", 50, "timeout"), ("a/6", "a/6", 50, None), ("b/", "b/", 50, None), *extra]
    links = [("a/", x) for x in ("a/1", "a/2", "a/3", "a/4", "a/5", "b/", "a/", None)] + [("a/1", "a/6"), ("a/1", "a/1"), ("a/3", "a/7"), ("b/", "b/9"), ("b/", "b/9")]
    return spark.createDataFrame(pages, "url string, final_url string, chars long, error string"), spark.createDataFrame(links, "url string, href string")


SCOPE = lambda category, url: url.startswith(F.concat(category, F.lit("/")))


def rows(df):
    return sorted((r.category, r.depth, r.url, r.failure) for r in df.collect())


def test_crawl_tells_each_failure(spark):
    pages, links = small(spark)
    seeds = spark.createDataFrame([("a", "a/"), ("b", "b/"), ("b", "b/"), (None, "a/"), ("a", None)], "category string, url string")
    got = rows(frontier.crawl(pages, links, seeds, SCOPE, 2, 100, 10))
    assert got == [
        ("a", 0, "a/", None), ("a", 1, "a/1", None), ("a", 1, "a/2", "redirected out of scope"), ("a", 1, "a/3", "too short"), ("a", 1, "a/4", "timeout"), ("a", 1, "a/5", "not found"), ("a", 2, "a/6", None),
        ("b", 0, "b/", None), ("b", 1, "b/9", "not found"),
    ]
    assert rows(frontier.crawl(pages, links, seeds, SCOPE, 0, 100, 10)) == [("a", 0, "a/", None), ("b", 0, "b/", None)]


def test_crawl_budget_is_each_categorys_own(spark):
    pages, links = small(spark)
    seeds = spark.createDataFrame([("a", "a/"), ("b", "b/")], "category string, url string")
    whole = rows(frontier.crawl(pages, links, seeds, SCOPE, 2, 100, 10))
    for most in (1, 3, 6, 7):
        got = rows(frontier.crawl(pages, links, seeds, SCOPE, 2, most, 10))
        assert got == sorted([r for r in whole if r[0] == "a"][:most] + [r for r in whole if r[0] == "b"][:most])


def test_crawl_seeds_must_give_a_page(spark):
    pages, links = small(spark)
    seeds = spark.createDataFrame([("a", "a/"), ("c", "c/")], "category string, url string")
    with pytest.raises(frontier.SeedFailed, match="c: not found"):
        frontier.crawl(pages, links, seeds, SCOPE, 2, 100)
    assert ("c", 0, "c/", "not found") in rows(frontier.crawl(pages, links, seeds, SCOPE, 0, 100, strict=False))
    assert rows(frontier.crawl(pages, links, seeds.limit(0), SCOPE, 2, 100)) == []
