from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import html_extract, packing, secret_scan
from meshwork.llm import queries as q
from tests.llm.helpers import AWKWARD, DOCS, docs, words
from tests.llm.test_near_dedup import plain
from tests.llm.test_text_operators import plain_hits

# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="home">
<header><a href=/>Site</a></header><nav><ul><li><a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>Side</p></div><div class=ad>Buy</div><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b><br>three&nbsp;four
<p>Five <a href="x">six</a> &lt;seven&gt;<ul><li>item 1<li>item 2</ul><form><input><p>sign up</p></form><!-- no --><aside>aside</aside></article>
<section class="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_extract.extract(PAGE) == "Head & line\n\nOne two three four\n\nFive six <seven>\n\nitem 1\n\nitem 2"


@pytest.mark.parametrize("page", ["", "plain", "<", "<p", "<<p>>", "<p>a</b></i><p>b", "<script>x", "<!-- x", "<div><div><div>deep", "a < b & c > d", "<p>&#65;&#x42;&unknown;</p>", "</div></p>", '<a href="unclosed <p>x</p>', "<table><tr><td>1<td>2<tr><td>3</table>"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_extract.extract(page), str)


def test_deep_and_long_pages():
    assert html_extract.extract("<div>" * 300 + "x").strip() == "x"
    assert len(html_extract.extract("<p>" + "word " * 200_000)) == 5 * 200_000 - 1


def site(i: int) -> str:
    return f"<body><div class=top>My site</div><div class=x><h2>Title {i}</h2><p>Body {i}</p><p>More {i % 3}</p></div><div>All rights reserved</div></body>"


def test_template_goes_and_slots_stay(spark):
    rows = [(i, f"http://host.example/{i}", site(i)) for i in range(8)] + [(20 + i, f"https://copies.example/{i}", site(0)) for i in range(4)]
    rows += [(30, "http://lone.example/", site(1)), (31, None, site(2)), (32, "http://host.example/n", None), (33, "no url", ""), (0, "http://host.example/0", site(0))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "'t' as template").repartition(3)
    got = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    assert len(html_extract.extract_pages(df).collect()) == len(rows)
    for i in range(8):
        assert got[i].text == f"Title {i}\n\nBody {i}\n\nMore {i % 3}" and got[i].n_chars == len(got[i].text)
    whole = "My site\n\nTitle 0\n\nBody 0\n\nMore 0\n\nAll rights reserved"
    assert all(got[20 + i].text == whole for i in range(4))  # copies lose nothing
    assert got[30].text == whole.replace("0", "1") and got[32].text == got[33].text == ""
    assert html_extract.extract_pages(df.limit(0)).collect() == []


def test_articles_of_the_test_pages(spark, small):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in q.op1_html_extraction(spark, small).collect():
        body = re.search("<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:h1|p)>", body)]
        assert r.text == "\n\n".join(x for x in blocks if x)


# --- packing


def test_histogram_packing_places_every_item():
    rng = random.Random(5)
    for trial in range(30):
        counts = Counter(min(64, int(rng.expovariate(1 / rng.choice([3, 10, 30]))) + 1) for _ in range(rng.randrange(1, 400)))
        bins = packing.pack_histogram(dict(counts), (16, 32, 64), 4)
        got: Counter = Counter()
        for b in bins:
            inside = packing.contents(b)
            used = sum(s * k for s, k in inside)
            assert used + b.room == b.capacity and b.room >= 0 and b.count > 0 and b.capacity in (16, 32, 64)
            assert b.capacity == 16 or used > b.capacity // 2  # downsized
            for s, k in inside:
                got[s] += k * b.count
        assert got == counts


def plain_best_fit(sizes: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_as_many_bins_as_placing_items_one_by_one():
    rng = random.Random(6)
    for _ in range(30):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 300))]
        bins = packing.pack_histogram(dict(Counter(sizes)), (48,), 0)
        assert sum(b.count for b in bins) == plain_best_fit(sizes, 48)


def test_several_lengths_cost_no_more_than_the_longest_alone():
    rng = random.Random(7)
    sizes = Counter(rng.choice([5, 9, 300, 511, 512, 700, 1030]) for _ in range(500))
    cost = lambda caps: sum(b.count * (b.capacity + 32) for b in packing.pack_histogram(dict(sizes), caps))
    assert cost((512, 1024, 2048, 4096)) <= cost((4096,))


def test_placements_do_not_overlap(spark):
    texts = [" ".join(words(i, n)) for i, n in enumerate([1, 2, 3, 3, 3, 50, 9000, 4095, 4096, 511, 512] * 4)] + AWKWARD
    df = docs(spark, texts, extra=True)
    df = df.union(df.where("doc_id = 5"))
    rows = packing.pack_documents(df).collect()
    by: dict[int, list] = {}
    for r in rows:
        if r.n_tokens == 0:
            assert r.bin_id is None and not (texts[r.doc_id] or "").strip(" \t\n\v\f\r")
            continue
        by.setdefault(r.bin_id, []).append((r.bin_start, r.bin_start + r.n_tokens, r.bin_capacity))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][1] <= own[0][2]
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    plain_count = lambda t: (lambda n: n + 1 if n else 0)(len([w for w in __import__("re").split("[ \t-\r]+", t or "") if w]))
    for i, t in enumerate(texts):
        assert total[i] == plain_count(t) * (2 if i == 5 else 1)
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []


# --- pipeline


def test_stages_against_plain_versions(spark, small):
    source = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(10_000, "12345 678 !!!", "en", "s", 13), (10_001, None, None, None, None), (10_002, "", "en", "s", 0)], DOCS)
    cur = source.unionByName(extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "secret_scan", "best_fit_packing"]
    kept = corpus_pipeline.identify_language(spark, cur, small)
    assert kept.columns == source.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {10_000, 10_001, 10_002}
    lettered = {r.doc_id for r in source.collect() if any(map(str.isalpha, r.text or ""))}
    assert len(lettered - ids) <= 0.01 * len(lettered)
    before = {r.doc_id: r.text for r in kept.collect()}
    once = corpus_pipeline.drop_near_duplicates(spark, kept.union(kept.limit(1)), small)
    order = sorted(before)
    groups = plain([before[i] for i in order], 5, 80)
    assert sorted(r.doc_id for r in once.collect()) == [order[i] for i, (_, c) in groups.items() if i == c]
    clean = corpus_pipeline.drop_contaminated(spark, once, small)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in once.collect() if plain_hits(r.text, items)[1] == 0)
    safe = corpus_pipeline.redact_secrets(spark, clean, small)
    assert safe.columns == source.columns and safe.schema == source.schema
    for r in safe.collect():
        assert r.text == secret_scan.redact(before[r.doc_id]) and r.n_chars == len(r.text)
    packed = corpus_pipeline.pack(spark, safe, small)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in safe.collect()}


def test_run_and_empty_documents(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 0
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_annotation_keeps_all_columns(spark):
    df = docs(spark, ["a", None], extra=True).withColumn("_found0", F.array(F.lit(1)))
    out = secret_scan.redact_secrets(df, into="_found")
    assert out.columns == [*df.columns, "_found"] and [r._found.redacted for r in out.orderBy("doc_id").collect()] == ["a", None]


def test_pipeline_keeps_rows_without_an_id(spark, small):
    said = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    rows = [(None, said(1), "a"), (None, said(2), "b"), (None, said(2) + " more", "c"), (None, said(3), "d"), (7, said(3), "e"), (8, said(4), "f"), (None, said(1), "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert once.columns == docs.columns
    got = [(r.doc_id, r.text) for r in once.collect()]
    assert len(got) == 4 and {(None, said(1)), (7, said(3)), (8, said(4))} <= set(got)
    assert len({(None, said(2)), (None, said(2) + " more")} & set(got)) == 1
    packed = corpus_pipeline.pack(spark, once, small).collect()
    assert sum(r.doc_id is None for r in packed) == 2
