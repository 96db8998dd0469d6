"""Templates of hosts: what is constant on at least 3 pages and half of the host's goes, the rest stays."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwork.llm import html_extract


def texts_of(spark, pages: list[str]) -> list[str]:
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    return [r.text for r in html_extract.extract_pages(df).orderBy("page_id").collect()]


def test_a_variant_of_the_header_keeps_the_template(spark):
    page = "<body><div class=top>{}</div><h2>Title {}</h2><div class=low>{}</div></body>"
    got = texts_of(spark, [page.format("My site beta" if i == 3 else "My site", i, "2023" if i % 3 == 0 else "2024") for i in range(9)])
    assert got[3] == "My site beta\n\nTitle 3\n\n2023" and got[6] == "Title 6\n\n2023"
    assert all(got[i] == f"Title {i}" for i in (1, 2, 4, 5, 7, 8))
    few = texts_of(spark, [page.format("My site" if i < 4 else f"Site {i}", i, "2024") for i in range(9)])
    assert few[0] == "My site\n\nTitle 0"  # 4 of 9 pages are under half


def test_constant_siblings_of_one_label_go(spark):
    body = lambda i: "".join(f"<p>Text {i} {k}</p>" for k in range(i % 4 + 1))
    plain = lambda i: "\n\n".join(f"Text {i} {k}" for k in range(i % 4 + 1))
    line = "<p>Subscribe to our letter</p>"
    for page in ("<body>" + line + "{}<p>All rights reserved</p></body>", "<body><div>My site</div><div>{}</div><div>Low</div></body>", "<body><div>{}" + line + "</div><div>{}</div></body>"):
        got = texts_of(spark, [page.format(*[body(i + 7 * k) for k in range(page.count("{}"))]) for i in range(9)])
        assert got == ["\n\n".join(plain(i + 7 * k) for k in range(page.count("{}"))) for i in range(9)]


def test_a_text_that_recurs_in_the_middle_of_articles_stays(spark):
    page = lambda i: f"<body><h1>T{i}</h1>" + "".join(f"<p>{'Yes.' if k == 3 + 2 * i else f'{i} {k}'}</p>" for k in range(40 + 5 * i)) + "</body>"
    assert all("Yes." in t for t in texts_of(spark, [page(i) for i in range(9)]))


def test_long_lists_of_blocks_are_aligned(spark):
    part = lambda i, n: "".join(f"<h2>Part {i} {k}</h2><p>Text {i} {k}</p>" for k in range(n))
    got = texts_of(spark, [f"<body>{part(i, 2 + 9 * (i % 3))}<div class=box>Read our book</div>{part(-i - 1, 13)}</body>" for i in range(9)])
    assert not any("Read our book" in t for t in got)
    assert [t.count("Part") for t in got] == [t.count("Text") for t in got] == [2 + 9 * (i % 3) + 13 for i in range(9)]


def test_copies_are_no_evidence_for_each_other(spark):
    post = "<div class=post><p>One story</p><p>told once</p></div>"
    got = texts_of(spark, [f"<body><h1>Post</h1>{post}</body>"] * 3 + [f"<body><h1>Page {i}</h1><ul><li>Item {i}</ul></body>" for i in range(2)])
    assert got == ["Post\n\nOne story\n\ntold once"] * 3 + [f"Page {i}\n\nItem {i}" for i in range(2)]


@pytest.mark.parametrize("mark", ['data-slug="hidden-gems"', 'title="The hidden cost"', 'data-hidden="false"', 'data-testid="comments"', 'class="content has-sidebar"', 'id="post-share-enabled"', "data-class=ad", 'data-x="a id=comments b"', 'class="social-history"', 'class="widget"', 'class="comments main-content"'])
@pytest.mark.parametrize("tag", ["article", "div", "p"])
def test_parts_of_attributes_hide_nothing(tag, mark):
    assert html_extract.extract(f"<body><h1>Head</h1><{tag} {mark}>The whole story, told at length</{tag}><div>End</div></body>").count("story") == 1


def test_names_hide_whole_tokens_beside_the_text():
    story = "<p>The whole story, told at length</p>" * 3
    for mark in ("class=ad", 'class="x cookie-notice"', "id=sidebar", "class=share_buttons", 'class="site-footer"', "class=newsletterBox", "hidden", "aria-hidden=true", "style='display: none'"):
        assert "Buy" not in html_extract.extract(f"<body><div {mark}>Buy</div>{story}</body>")
    assert html_extract.extract(f"<body><div class=widget><article>Short</article></div><div>{story}</div></body>") == "Short"
    assert "Teaser" not in html_extract.extract(f"<body><div class=related><article>Teaser</article></div><article>{story}</article></body>")
    assert "First!" not in html_extract.extract(f"<body><article>{story}<article class=comment>First!</article></article></body>")


# --- alignment


def plain_match(a, b) -> int:
    """Most elements that match, by the recursive definition; trees are (label, children)."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain_match(x[i], y[j]))
    return 1 + table[-1][-1]


def written(tree) -> str:
    labels, parents = [], []

    def walk(node, above):
        me = len(labels)
        labels.append(node[0])
        parents.append(above)
        for kid in node[1]:
            walk(kid, me)

    walk(tree, -1)
    return html_extract.written(labels, parents)


@settings(max_examples=200, deadline=None)
@given(*[st.recursive(st.tuples(st.sampled_from("ab"), st.just([])), lambda kids: st.tuples(st.sampled_from("ab"), st.lists(kids, max_size=4)), max_leaves=12) for _ in range(2)])
def test_alignment_equals_plain_simple_tree_matching(a, b):
    a, b = ("root", [a]), ("root", [b])
    x, y = written(a), written(b)
    found = html_extract.match(x, y)
    assert sum(r >= 0 for r in found) == plain_match(a, b)
    (la, pa, _, _), (lb, pb, _, _) = html_extract._read(x), html_extract._read(y)
    pairs = [(i, r) for i, r in enumerate(found) if r >= 0]
    assert len({r for _, r in pairs}) == len(pairs) and sorted(pairs) == sorted(pairs, key=lambda p: p[1])
    assert all(la[i] == lb[r] and (not i or found[pa[i]] == pb[r]) for i, r in pairs)
    assert html_extract.match(x, x) == list(range(len(la)))


# --- content by evidence of the host


def anonymous(page: str) -> str:
    """A page whose elements and names tell nothing."""
    for old, new in (("<article>", "<div class=k>"), ("</article>", "</div>"), ("<nav>", "<div class=z>"), ("</nav>", "</div>"), ("<footer>", "<div class=y>"), ("</footer>", "</div>"), ('"ad"', '"q"')):
        page = page.replace(old, new)
    return page


def test_the_wrapper_decides_where_names_say_nothing(spark, small):
    rows = spark.read.parquet(f"{small.replace('0.001', '0.01')}/pages.parquet").collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.url.split("/")[2], []).append(r)
    rows = [r for own in by.values() if len(own) >= 5 for r in own]
    want = {r.page_id: html_extract.extract(r.html) for r in rows}
    told = {r.page_id: anonymous(r.html) for r in rows}
    df = spark.createDataFrame([(r.page_id, r.url, told[r.page_id]) for r in rows], "page_id bigint, url string, html string")
    for names in (True, False):
        assert {r.page_id: r.text for r in html_extract.extract_pages(df, names=names).collect()} == want
    assert all(html_extract.extract(told[i]) != want[i] for i in want)  # the wrapper does it


def story(i: int, n: int) -> str:
    return "".join(f"<p>Story {i} paragraph {k} tells what nobody else tells at {i * k}.</p>" for k in range(n))


def test_headings_beside_the_content_stay_and_menus_inside_it_go(spark):
    menu = lambda i: "<ul>" + "".join(f"<li><a href=x>Other story {i + k} to read</a></li>" for k in range(4)) + "</ul>"
    page = lambda i: f"<body><div class=a><a href=/>Home {i}</a> <a href=/>News</a></div><div class=b><h1>Title {i}</h1><div class=c>By {i}, 5 min</div><div class=d>{story(i, 3 + i % 3)}{menu(i)}</div></div><div class=e>Visit {i}</div></body>"
    got = texts_of(spark, [page(i) for i in range(6)])
    assert got == [f"Title {i}\n\n" + "\n\n".join(f"Story {i} paragraph {k} tells what nobody else tells at {i * k}." for k in range(3 + i % 3)) for i in range(6)]


def test_pages_of_another_kind_rest_on_names(spark):
    pages = [f"<body><div class=a>Home {i}</div><div class=d>{story(i, 4)}</div></body>" for i in range(6)] + ["<body><nav>Menu</nav><table><tr><td>Contact us here</table></body>"]
    assert texts_of(spark, pages)[-1] == "Contact us here"


def test_pages_of_any_depth(spark):
    deep = lambda i, n: "<body>" + "<div>" * n + f"Text {i}" + "</div>" * n + "<p>end</p></body>"
    got = texts_of(spark, [deep(i, 5000 + 500 * (i % 3)) for i in range(6)] + ["<ul><li>" * 3000 + "x", "<article>" * 2000 + "y"])
    assert [t.split("\n\n")[0] for t in got] == [*(f"Text {i}" for i in range(6)), "x", "y"]
