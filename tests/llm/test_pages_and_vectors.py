"""Page text and nearest vectors."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from newsweave.llm import neighbours, pagetext
from newsweave.llm.pagetext import common_lines, lines_of, main_text


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_subsequence():
    generator = random.Random(1)
    for _ in range(800):
        a, b = ([generator.choice("abcd") for _ in range(generator.randint(0, 12))] for _ in range(2))
        left, right = common_lines(a, b)
        assert len(left) == len(right) == lcs(a, b)
        assert [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)]
    same = ["x"] * 3000
    assert len(common_lines(same, ["x"] * 2000 + ["y"])[0]) == 2000


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>gone</p> --><div class="ad box">Buy</div>
<div class='cookie-notice'>We use</div><article><header><h1>A &amp; B&nbsp;&#x2014; c</h1></header><p><b>One<br>two
  three.<br><p>Four<span class="advert">no</span> five<div id="comments"><p>Reader</div><aside>Side</aside><ul><li>six<li>seven</ul>
<form><p>Mail <input></p></form><p hidden>secret</p><p>a < b &lt;i&gt;</p></article><footer>&copy; x</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(lines_of(ARTICLE), set()) == "A & B — c\n\nOne two three.\n\nFour five\n\nsix\n\nseven\n\na < b <i>"


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain words", "plain words"), ("<p>", ""), ("<p>a</p><p> \n </p>b", "a\n\nb"), ("<div>a<nav>b", "a"), ("x<script>y", "x"),
    ("<article><p>a</article><article class=comment><p>b</article>", "a"), ("<!-- open", ""), ("<p title='a>b'>c", "c"), ("&#0;&bogus;", "�&bogus;"),
])
def test_odd_pages(page, text):
    assert main_text(lines_of(page), set()) == text


def test_shared_lines_of_near_urls_go(spark):
    page = lambda own: "<div>Site menu</div><div>Latest offers</div>" + "".join(f"<div>{x}</div>" for x in own) + "<div>About us</div>"
    rows = [(i, f"https://h.org/en/{i}?q=1", page([f"text {i} first", f"text {i} second", f"more {i}", f"end {i}"]), "x", 1) for i in range(10)]
    rows += [(20, "https://other.org/a", page(["alone"]), "x", 1), (21, None, None, "x", 1), (None, "", "", "x", 1)]
    # Copies of one page keep their lines.
    rows += [(30 + i, "https://copy.org/p", page(["the same"]), "x", 1) for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _range int")
    found = {r.page_id: r.text for r in pagetext.extract(frame).collect()}
    for i in range(10):
        assert found[i] == f"text {i} first\n\ntext {i} second\n\nmore {i}\n\nend {i}"
    assert found[20] == found[30].replace("the same", "alone") == "Site menu\n\nLatest offers\n\nalone\n\nAbout us"
    assert found[30] == found[31] and found[21] == found[None] == ""
    assert pagetext.extract(frame.limit(0)).collect() == []


def test_partitions_do_not_change_the_text(spark, folder, monkeypatch):
    pages = spark.read.parquet(f"{folder}/pages.parquet").drop("text")
    whole = sorted(pagetext.extract(pages).collect())
    assert len(whole) == pages.count()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(pagetext.extract(pages.repartition(5)).collect()) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


VECTORS = "vec_id long, embedding array<float>, label int, part int, parts string, query string, score double"


def frame_of(spark, ids, rows):
    return spark.createDataFrame([(i, None if r is None else [None if x is None else float(x) for x in r], 1, 2, "a", "b", 0.0) for i, r in zip(ids, rows)], VECTORS)


def brute(ids, rows, k, every=20):
    found = {}
    for i, q in zip(ids, rows):
        if i % every == 0:
            scored = sorted((-float((q.astype(float) * r.astype(float)).sum()), j) for j, r in zip(ids, rows) if j != i)
            found[i] = [(j, -s) for s, j in scored[:k]]
    return found


def collected(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_few_vectors_ties_and_odd_rows(spark):
    rows = np.array([[1, 0], [1, 0], [0.5, 2], [1, 0], [-1, 0.25]], np.float32)
    ids = [0, 7, 3, 5, 20]
    odd = [(40, None), (60, [0, 0]), (61, [float("nan"), 1]), (62, [float("inf"), 1]), (63, [None, 1]), (64, [1, 2, 3]), (None, [1, 1])]
    frame = frame_of(spark, ids + [i for i, _ in odd], [*rows, *[v for _, v in odd]])
    assert collected(neighbours.nearest(frame)) == brute(ids, rows, 20)
    assert neighbours.nearest(frame.limit(0)).collect() == []
    assert neighbours.nearest(frame.where("vec_id = 7")).collect() == []


def test_recall_exact_scores_and_a_hot_vector(spark, monkeypatch):
    # More parts and blocks than this many rows would have.
    monkeypatch.setattr(neighbours, "PART_ROWS", 250)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 2000)
    generator = np.random.default_rng(5)
    centres = generator.normal(size=(12, 16))
    rows = (centres[generator.integers(0, 12, 2400)] + 0.4 * generator.normal(size=(2400, 16))).astype(np.float32)
    rows[:800] = rows[0]
    ids = generator.permutation(2400).tolist()
    truth = brute(ids, rows, 20)
    found = collected(neighbours.nearest(frame_of(spark, ids, rows)))
    assert set(found) == set(truth) and all(len(v) == 20 for v in found.values())
    assert np.mean([len({j for j, _ in found[q]} & {j for j, _ in truth[q]}) / 20 for q in truth]) >= 0.9
    at = dict(zip(ids, rows.astype(float)))
    for q, best in found.items():
        assert all(abs(s - at[q] @ at[j]) < 1e-9 for j, s in best)
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))


def test_parts_are_balanced_and_learned():
    generator = np.random.default_rng(2)
    rows = generator.normal(size=(1000, 8))
    graph = neighbours.neighbour_graph(rows, 10)
    label = neighbours.balanced_parts(rows, graph, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= np.ceil(1000 / 8 * neighbours.IMBALANCE) and sizes.min() > 30
    by_chance = np.mean(generator.permutation(label)[graph] == label[:, None])
    assert np.mean(label[graph] == label[:, None]) > 2 * by_chance
    bins, blocks = neighbours.packed({0: 5000, 1: 9000, 2: 3000, 3: 40_000, 5: 1})
    assert bins == {0: 0, 1: 0, 2: 1, 3: 2, 5: 3} and blocks == {0: 1, 1: 1, 2: 3, 3: 1}


def site_pages(seed, sites, pages, wrapper):
    """Pages of one frame per site around own paragraphs, without an article element."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randint(4, 14)))
    rows, wanted = [], {}
    for site in range(sites):
        top, bottom = [line() for _ in range(rng.randint(1, 6))], [line() for _ in range(rng.randint(1, 5))]
        for page in range(pages):
            own = [line() for _ in range(rng.randint(1, 5))]
            body = "".join(f"<div>{x}</div>" for x in top) + "".join(f"<p>{x}" for x in own) + "".join(f"<div>{x}</div>" for x in bottom)
            number = site * pages + page
            rows.append((number, f"https://site{site}.org/{page:04d}", f"<body><div class='{wrapper}'>{body}</div></body>"))
            wanted[number] = "\n\n".join(own)
    return rows, wanted


@pytest.mark.parametrize("wrapper", ["plain", "main-wrapper", "content"])
@pytest.mark.parametrize("size", [1, 3, 2000])
def test_frames_go_whatever_the_wrapper_and_the_ranges(spark, monkeypatch, wrapper, size):
    monkeypatch.setattr(pagetext, "RANGE_PAGES", size)
    rows, wanted = site_pages(size, 3, 9, wrapper)
    found = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == wanted


def test_hundreds_of_pages_and_copies_among_them(spark):
    rows, wanted = site_pages(4, 12, 25, "post")
    # Copies of a page with another related link each stand next to it, and are no help.
    rows += [(5000 + i, f"https://site3.org/0007-{i}", rows[3 * 25 + 7][2]) for i in range(40)]
    wanted |= {5000 + i: wanted[3 * 25 + 7] for i in range(40)}
    found = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == wanted


@pytest.mark.parametrize("unit", ["<a ", '<p title="', "<!--", "<!", "</a", "<script", "<div>", "</section>", "<p a='\"", "& ", "<article><nav>"])
def test_two_megabytes_of_broken_tags_take_linear_time(unit):
    page = unit * (2_000_000 // len(unit))
    start = time.process_time()
    lines_of(page)
    assert time.process_time() - start < 60


def test_closing_tags_of_nothing_open_in_a_deep_page():
    start = time.process_time()
    lines_of("<div>" * 50_000 + "</section>" * 50_000 + "word")
    assert time.process_time() - start < 30


def test_halved_tables_give_a_longest_subsequence(monkeypatch):
    monkeypatch.setattr(pagetext, "TABLE_BITS", 20)
    generator = random.Random(8)
    for _ in range(300):
        a, b = ([generator.choice("abcde") for _ in range(generator.randint(0, 40))] for _ in range(2))
        left, right = common_lines(a, b)
        assert len(left) == len(right) == lcs(a, b)
        assert [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)]


def test_a_hundred_thousand_lines_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(pagetext, "TABLE_BITS", 1 << 22)
    generator = random.Random(9)
    a = [f"line {i}" for i in range(12_000)]
    b = [x for x in a if generator.random() < 0.9]
    b = [y for x in b for y in ([x, "new"] if generator.random() < 0.1 else [x])]
    left, _ = common_lines(a, b)
    assert len(left) == sum(x != "new" for x in b)
