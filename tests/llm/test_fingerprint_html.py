"""op1 and op9 against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.helpers import edge_rows, empty, frame, prose
from vigil.llm import fingerprint, html_extract
from vigil.llm.common import mix64
from vigil.llm.fingerprint import code_points, likeness, signature


# ---- Order MinHash ----

def signature_by_hand(text, k, bins, pick):
    """The method word for word: numbered k-mers, the smallest per bin, in text order, hashed as a tuple."""
    cp = code_points(text)
    if not len(cp):
        return [0] * bins
    h = fingerprint.kmer_hashes(cp, k).tolist()
    count, items = {}, []
    for place, x in enumerate(h):
        n = count.get(x, 0)
        count[x] = n + 1
        v = int(mix64(np.array([(x + n * 0xA24BAED4963EE407) % 2 ** 64], np.uint64))[0])
        items.append((v % bins, v // bins, place, v))
    out = []
    for b in range(bins):
        chosen = sorted(sorted(i for i in items if i[0] == b)[:pick], key=lambda i: i[2])
        entry = 0
        for _, _, _, v in chosen:
            entry = int(mix64(np.array([(entry * 0x9E3779B97F4A7C15 + v) % 2 ** 64], np.uint64))[0])
        out.append(max(entry >> 48, 1) if chosen else 0)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcabcabcabc", prose(1, 30), prose(2, 700), "é" * 50, "日本語 😀 " * 9])
def test_signature(text):
    for k, bins, pick in ((12, 64, 2), (5, 16, 3), (1, 8, 1)):
        assert signature(code_points(text), k, bins, pick).tolist() == signature_by_hand(text, k, bins, pick)


def test_order_matters():
    """Two texts with nearly the same k-mers in another order are less alike than an edit."""
    parts = [prose(100 + k, 12) for k in range(30)]
    text = " ".join(parts)
    swapped = list(parts)
    random.Random(1).shuffle(swapped)
    small = text.replace(parts[15], prose(999, 12))
    a = signature(code_points(text))
    assert likeness(a, signature(code_points(small))) > likeness(a, signature(code_points(" ".join(swapped)))) + 0.2
    assert likeness(a, signature(code_points(prose(55, 300)))) < 0.1 and likeness(a, a) == 1.0


def edits_by_hand(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        new = t[:len(t) - q] + following[:q]
        fp = [signature(code_points(x)) for x in (t, new, following)]
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), fp[0].astype("<u2").tobytes().hex(), fp[1].astype("<u2").tobytes().hex(),
                  likeness(fp[0], fp[1]), likeness(fp[0], fp[2]))
    return out


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_edits(spark, parts):
    rows = [r for r in edge_rows() if r[0] != 13] + [(200 + 3 * k, prose(k, k % 30)) for k in range(60)]
    out = fingerprint.fingerprint_edits(frame(spark, rows).repartition(parts)).collect()
    assert {r["id"]: tuple(r)[1:] for r in out} == edits_by_hand(rows)


def test_edits_edges(spark):
    assert fingerprint.fingerprint_edits(empty(spark)).count() == 0
    one = fingerprint.fingerprint_edits(frame(spark, [(7, "abcdefgh")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    twice = fingerprint.fingerprint_edits(frame(spark, [(None, "x"), (1, "y"), (1, "y")]))
    assert twice.count() == 3


# ---- HTML ----

def text_of(page):
    return [t for t, _ in html_extract.parse_page(page)[0]]


@pytest.mark.parametrize("page, want", [
    ("", []),
    ("plain <b>te</b>xt", ["plain text"]),
    ("<p>a &amp; b&nbsp;c &am", ["a & b c &am"]),
    ("<p>one<p>two<br>three</p>", ["one", "two three"]),
    ("<article><h1>T</h1><p><b>x<br><p>y</p></article><footer>f</footer>", ["T", "x", "y"]),
    ("<nav><p>n</p></nav><main><p>m</p><aside>s</aside></main><p>out</p>", ["m"]),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>a < b</p><!-- <p>c</p> --><div", ["a < b"]),
    ("<div class='cookie-notice'>c</div><div id=sidebar-left>s</div><p>k</p><form><p>q</p></form>", ["k"]),
    ("<header>h</header><article><header><h1>T</h1></header><p>p</p><div class='ad'>buy</div>"
     "<section id='comments'><article class='comment'><p>nice</p></article></section></article>", ["T", "p"]),
    ("<div class='layout sidebar-right'><article><p>in</p></article></div>", ["in"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2</table>", ["a", "b", "c", "1", "2"]),
    ("<p hidden>x</p><p>y <img src='a>b'> z</p>", ["y z"]),
    ("<![CDATA[raw]]><p>ü &#252; &#x1F600;</p></div></b>", ["raw", "ü ü \U0001F600"]),
])
def test_parse_page(page, want):
    assert text_of(page) == want


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")


def test_template_subtrees_go_and_shared_prose_stays(spark):
    rows = []
    for k in range(20):
        body = (f"<body><div class=x><b>Site menu</b><span>of all pages</span></div><div><div>{prose(k, 20)}</div>"
                f"<div>Follow us today</div></div></body>")
        rows.append((k, "http://a.example/x", body, "clash", None))
        art = (f"<article><h1>{prose(50 + k, 5)}</h1><p>{prose(7, 30)}</p><div>Read more here</div><p>{prose(80 + k, 20)}</p></article>")
        rows.append((100 + k, "https://u@B.example:80/y", art, "clash", None))
        rows.append((200 + k, "http://c.example/", "<body><div>the same page</div></body>", "clash", None))   # copies of one page
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages(spark, rows)).collect()}
    for k in range(20):
        assert got[k] == prose(k, 20)
        assert got[100 + k] == "\n".join([prose(50 + k, 5), prose(7, 30), prose(80 + k, 20)])
        assert got[200 + k] == "the same page"


@pytest.mark.parametrize("size", [60, 1000])
def test_a_section_is_template_on_large_hosts_too(spark, size):
    """The same 50 pages with one section, on a host of 60 pages and on one of 1,000: gone from both."""
    rows = []
    for k in range(size):
        section = "<section><div>Members of this site get our letter</div></section>" if k < 50 else ""
        own = f"<section><div>{prose(k, 12)}</div></section>" + ("<section><div>Told twice</div></section>" if k < 2 else "")
        rows.append((k, "http://big.example/p", f"<body><article><p>{prose(5000 + k, 15)}</p>{own}{section}</article></body>", "", None))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages(spark, rows)).collect()}
    for k in range(size):
        assert got[k] == "\n".join([prose(5000 + k, 15), prose(k, 12)] + ["Told twice"] * (k < 2))


def test_html_edges(spark):
    rows = [(1, None, None, None, None), (2, "odd", "", "", ""), (None, "http://h/", "<p>x", "", ""), (3, "http://h/", "<p>" + "w " * 200_000, "", ""),
            (3, "http://h/", "<p>a", "", "")]
    out = html_extract.extract_text(pages(spark, rows)).collect()
    assert sorted((r["n_chars"] for r in out)) == [0, 0, 1, 1, 399_999]
    assert html_extract.extract_text(pages(spark, [])).count() == 0


def test_shuffle_join_of_templates(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", -1)
    test_template_subtrees_go_and_shared_prose_stays(spark)


def test_small_pages(spark):
    import html
    import re

    def want(page):
        a = page[page.index("<article>") + 9:page.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", a))
        return "\n".join(b for b in blocks if b)

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_extract.query(spark, SMALL).collect()}
    assert got == {r["page_id"]: want(r["html"]) for r in pages}
