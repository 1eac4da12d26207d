import math
import random
import re

import numpy as np
import pytest

from factloom.llm import html_text
from factloom.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>First&nbsp; one.<br><p>Sec<i>ond</i>
 line.</p><div class="share"><p>Share</p></div><p>3 &lt; 4</p><form><label>Name</label></form></div><ul><li>a</li><li>b</li></ul>
<section id="comments"><article><p>I disagree at great length, again and again and again.</p></article></section></article>
<aside><p>Side</p></aside><footer>&copy; x</footer></body></html>"""


def test_article():
    assert H.main_text(PAGE) == "Title & more\n\nFirst one.\n\nSecond line.\n\n3 < 4\n\na\n\nb"


def test_truncated_and_damaged():
    assert H.main_text(PAGE[: PAGE.index("line.")] + "cut &am") == "Title & more\n\nFirst one.\n\nSecond cut &am"
    assert H.main_text("<div><p>unclosed <b>bold") == "unclosed bold"
    assert H.main_text("<script>x") == H.main_text("") == H.main_text(None) == H.main_text("<!-- a --><br>") == ""


def test_without_article_clusters_decide():
    long = "word " * 60
    page = "<body>" + "".join(f'<div><a href="{i}">link {i}</a></div>' for i in range(12)) + f"<div><h2>Head</h2><p>{long}</p><p>short</p><p>{long}</p></div>" + "".join(f'<div><a href="{i}">more {i}</a></div>' for i in range(12))
    assert H.main_text(page) == "\n\n".join(["Head", long.strip(), "short", long.strip()])


def test_clusters_decide_beside_and_across_articles():
    long = "word " * 60
    text = long.strip()
    links = "".join(f'<div><a href="{i}">link {i}</a></div>' for i in range(6))
    assert H.main_text(f"<main><h1>T</h1><p>intro</p><article><p>{long}</p></article></main>") == f"T\n\nintro\n\n{text}"
    assert H.main_text(f"<article><p>{long}</p></article>{links}<article><p>{long}</p></article>") == f"{text}\n\n{text}"
    assert H.main_text(f"<article><p>Teaser</p></article>{links}<div><p>{long}</p></div>") == text
    assert H.main_text(f"<article><p>{long}</p></article><div>Posted</div>{links}<div><p>{long}</p></div>") == f"{text}\n\n{text}"
    assert H.main_text(f"<article><p>{long}</p>{links}{links}</article>").startswith(text) and "link 5" not in H.main_text(f"<article><p>{long}</p>{links}{links}</article>")


def test_smoothing_equals_definition():
    x = np.random.default_rng(0).random(9)
    for i, y in enumerate(H.smooth(x)):
        w = {j: np.exp(-((i - j) ** 2) / 2) for j in range(9) if abs(i - j) <= 2}
        assert np.isclose(y, sum(w[j] * x[j] for j in w) / sum(w.values()))


def test_columns(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x"), (None, "v", "<p>" + "é " * 200_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.with_text(pages).collect()
    assert sorted(len(r.text) for r in got) == sorted([len(H.main_text(PAGE))] * 2 + [0, 399_999])
    assert H.with_text(pages.limit(0)).count() == 0


def brute_content(blocks, clusters=True):
    """Ratio, smoothing, threshold and selection by plain loops."""
    n = len(blocks)
    ratio = [max(0, len(b.text) - b.link_chars) / max(1, b.tags) for b in blocks]
    near = []
    for i in range(n):
        weights = {j: math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 2), min(n, i + 3))}
        near.append(sum(w * ratio[j] for j, w in weights.items()) / sum(weights.values()))
    mean = sum(near) / n
    threshold = min(mean, math.sqrt(sum((x - mean) ** 2 for x in near) / n))
    above = [x >= threshold or not clusters for x in near]
    linked = [b.link_chars > 0.5 * len(b.text) for b in blocks]
    united = {m for b, a in zip(blocks, above) if a for m in b.main}
    core = [i for i in range(n) if above[i] and not linked[i] and not blocks[i].main and (not united or ratio[i] >= threshold or not clusters)]
    keep = {i for i in range(n) if united & set(blocks[i].main) and (above[i] or blocks[i].heading or not linked[i])}
    if core:
        first = core[0]
        while first and blocks[first - 1].heading and not blocks[first - 1].main:
            first -= 1
        parents = {blocks[i].parent for i in core}
        keep |= {i for i in range(first, core[-1] + 1) if not blocks[i].main and (i in core or blocks[i].heading or blocks[i].parent in parents)}
    return [blocks[i].text for i in sorted(keep)]


def random_page(rng):
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    parts = []
    for _ in range(rng.randint(1, 12)):
        kind = rng.choice("phlads")
        parts.append({
            "p": f"<p>{words(rng.randint(1, 60))}</p>", "h": f"<h2>{words(3)}</h2>", "l": "<ul>" + "".join(f"<li><a href=x>{words(2)}</a></li>" for _ in range(rng.randint(1, 6))) + "</ul>",
            "a": f"<article><h1>{words(2)}</h1><p>{words(rng.randint(1, 50))}</p></article>", "d": f"<div>{words(rng.randint(1, 6))}</div>", "s": f"<p><a href=y>{words(8)}</a> {words(1)}</p>",
        }[kind])
    return "<body>" + "".join(parts) + "</body>"


def test_selection_equals_brute_force_and_clusters_decide():
    rng, changed = random.Random(8), 0
    for _ in range(400):
        blocks = html_text.lines(random_page(rng))
        got = [b.text for b in html_text.content(blocks)]
        assert got == brute_content(blocks)
        changed += got != brute_content(blocks, clusters=False)
    assert changed > 100  # with every block counted as clustered, the results differ


def test_without_any_container_name_clusters_find_the_text():
    """The driver's pages with article, nav, footer and class taken away: clusters alone find most of the text."""
    import glob

    import pyarrow.parquet as pq

    if not glob.glob("/root/testdata/sf0.001/pages.parquet"):
        pytest.skip("no driver tables")
    found = kept = wanted = 0
    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        plain = re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", html).replace(' class="ad"', "")
        want, got = (html_text.main_text(x).split("\n\n") for x in (html, plain))
        wanted, found, kept = wanted + sum(map(len, want)), found + sum(len(b) for b in want if b in got), kept + sum(map(len, got))
    assert found / wanted > 0.9 and found / kept > 0.9, (found / wanted, found / kept)


def test_parts_of_an_article_are_not_taken_for_boxes():
    long = "word " * 40
    page = f'<article><h1>T</h1><p>{long}</p><div class="related-work"><p>{long}r</p></div><section id="discussion"><h2>Discussion</h2><p>{long}d</p></section><div class="related-posts"><p>{long}x</p></div><div class="comments"><p>{long}c</p></div></article>'
    text = html_text.main_text(page)
    assert text.count("word") == 120 and "Discussion" in text and not text.endswith(("x", "c"))
    two = f"<main><h1>Top</h1><p>Lead {long}</p><article><h2>One</h2><p>{long}</p></article><article><h2>Two</h2><p>{long}</p></article></main>"
    assert [b for b in html_text.main_text(two).split("\n\n") if len(b) < 10] == ["Top", "One", "Two"]


def test_query_columns(spark):
    rows = [(1, "u", "<article><p>caf&eacute; 🦊 one two three</p></article>", 9), (2, None, None, 8), (2, None, "", 7)]
    spark_pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.with_text(spark_pages).collect()
    assert [(r.page_id, r.url, r.text) for r in got] == [(1, "u", "café 🦊 one two three"), (2, None, ""), (2, None, "")]
