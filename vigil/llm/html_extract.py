"""Main text of web pages with removal of site templates.

Every page is parsed once, in tasks: its text blocks come out with the hashes
of the element subtrees they lie in.  Spark counts, per host, on how many
different articles a subtree occurs, and blocks inside subtrees that recur
across many of them are deleted.  Elements that say what they are (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, reader comments)
go by their name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import read_table, saved

#: A subtree is template when it occurs on so many different articles of its host; on a small host this share of them
#: may ask for more, but never for more than MANY_PAGES: what recurs so often is template however large the host is.
LEAST_PAGES = 5
LEAST_SHARE = 0.1
MANY_PAGES = 20
#: Template rows (host, subtree) up to which the templates are broadcast; they are counted first.
BROADCAST_ROWS = 20_000

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes xmp template".split())
#: Elements that are never main text.
DROP = frozenset("""head nav footer aside form button select datalist dialog menu object svg canvas audio video map
fieldset label""".split())
#: Elements that hold the article's own text: inside it they are not template even if they recur.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr table tbody ul ol dl b i em strong a span code".split())
#: What opens inside the key closes an open element named in the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
BARRIER = frozenset("ul ol dl table article main section div body html".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_OPEN_END = re.compile(r"</?[a-zA-Z][^<>]*\Z")
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_ASIDE = re.compile(r"""(?:site|page|main|top|bottom|left|right|global|user|reader|article|post|entry|blog|js|the)?[-_]?
(?:ads?|advert\w*|adsbygoogle|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter
|subscri\w+|signup|sidebar|side|aside|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|toolbar|topbar|comments?|commentlist|disqus\w*
|respond|repl(?:y|ies)|discussion|share|sharing|social|related|recommend\w*|recirc|pagination|pager|login|search|skip|complementary
|contentinfo|dialog|alertdialog|form|copyright|legal|disclaimer|noprint|teasers?|trending)(?:$|[-_\d].*)""", re.X | re.I)
_HEADER = re.compile(r"(?:site|page|main|top|global)?[-_]?header(?:$|[-_\d].*)", re.I)


def _says_aside(attributes: str, in_article: bool) -> bool:
    if not attributes:
        return False
    for _, value in _NAMED.findall(attributes):
        for word in value.strip("\"'").split():
            if _ASIDE.fullmatch(word) or (not in_article and _HEADER.fullmatch(word)):
                return True
    return bool(_HIDDEN.search(attributes))


def parse_page(page: str) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """(blocks, subtrees): the main text's blocks with the subtree hashes around each, and the hashes of
    all subtrees that may be template."""
    blocks: list[list] = []          # [text, places of the elements around it, in an article, in main]
    parts: list[str] = []            # what subtrees are hashed from
    hashes: list[int | None] = []    # by element place
    stack: list[tuple] = []          # (tag, place, first part, dropped, in article, in main)
    text: list[str] = []

    def flush() -> None:
        if text:
            said = " ".join("".join(text).split())
            text.clear()
            if said:
                parts.append(said)
                if not (stack and stack[-1][3]):
                    top = stack[-1] if stack else (None, 0, 0, False, False, False)
                    blocks.append([said, [s[1] for s in stack], top[4], top[5]])

    def close(depth: int) -> None:
        if any(s[0] in BLOCK for s in stack[depth:]):
            flush()
        while len(stack) > depth:
            tag, place, first, _, in_article, in_main = stack.pop()
            inner = stack and stack[-1][4]
            if tag in ("html", "body", "article", "main") or (inner and tag in PROSE):
                hashes[place] = None
            else:
                raw = "\0".join(parts[first:])
                hashes[place] = int.from_bytes(blake2b(f"{tag}\0{raw}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little",
                                               signed=True) if raw else None
            parts.append("/" + tag)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at:m.start()] if m else _OPEN_END.sub("", page[at:])
        if piece:
            text.append(entities.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                close(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            shut = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = shut.end() if shut else end
            if tag in BLOCK:
                flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            shut = CLOSES.get(tag, set()) | {"p"} if tag not in ("option", "optgroup") else CLOSES.get(tag, set())
            depth = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    depth = k
                elif stack[k][0] in BARRIER and not (tag in ("td", "th", "tr") and stack[k][0] in ("div", "section")):
                    break
            if depth is not None:
                close(depth)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            if tag in ("img", "input", "wbr"):
                text.append("" if tag == "wbr" else " ")
            continue
        _, _, _, dropped, in_article, in_main = stack[-1] if stack else (None, 0, 0, False, False, False)
        aside = tag not in ("html", "body") and _says_aside(m[3], in_article)
        if tag in ("article", "main") and not aside and dropped == "named":
            dropped = False          # a wrapper's name says nothing about the article in it
        if tag in DROP or (tag == "header" and not in_article):
            dropped = "element"
        elif aside and not dropped:
            dropped = "named" if tag not in ("article", "main") and not re.search("comment|repl|ad", m[3], re.I) else "element"
        stack.append((tag, len(hashes), len(parts) + 1, dropped, in_article or (tag == "article" and not dropped),
                      in_main or (tag == "main" and not dropped)))
        parts.append(tag)
        hashes.append(None)
    flush()
    close(0)
    for k in (2, 3):
        if any(b[k] for b in blocks):
            blocks = [b for b in blocks if b[k]]
            break
    return [(b[0], [hashes[p] for p in b[1] if hashes[p] is not None]) for b in blocks], sorted({h for h in hashes if h is not None})


def parse_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, host, article, blocks, subtrees) per row; ``article`` is a hash of the main text."""
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [parse_page(h) for h in pdf.pop("html")]
            pdf["article"] = [int.from_bytes(blake2b("\n".join(t for t, _ in b).encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                                             "little", signed=True) for b, _ in found]
            pdf["blocks"] = [[{"text": t, "inside": p} for t, p in b] for b, _ in found]
            pdf["subtrees"] = [np.array(s, np.int64) for _, s in found]
            yield pdf

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"),
                       F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return own.mapInPandas(run, f"page_id {kind}, url {pages.schema[url_col].dataType.simpleString()}, host string, article long, "
                                "blocks array<struct<text: string, inside: array<bigint>>>, subtrees array<bigint>")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """One row per page: (page_id, url, text, n_chars).

    The blocks of the main text in page order, joined by a line break: what is
    inside ``article``, else ``main``, else the whole body, without elements
    that are named as something else and without subtrees that recur on many
    different articles of the host (copies of one article count once;
    paragraphs and headings of an article stay even if they recur).  Character
    references are decoded and white space inside a block is one blank.  NULL
    or empty html gives an empty text; a NULL or odd url is the host ''.
    Repeated rows are extracted each and count once as an article.
    """
    parsed = saved(parse_pages(pages, id_col, url_col, html_col), "pages")
    articles = parsed.groupBy("host", "article").agg(F.count("*").alias("copies")).groupBy("host").agg(F.count("*").alias("articles"))
    seen = saved(parsed.select("host", "article", F.explode("subtrees").alias("subtree")).distinct(), "subtrees")
    counted = seen.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    often = saved(counted.filter(F.col("n") >= least_pages).join(articles, "host")
                  .filter(F.col("n") >= F.least(F.lit(many_pages), least_share * F.col("articles"))).select("host", "subtree"), "templates")
    if often.count() <= BROADCAST_ROWS:
        per_host = often.groupBy("host").agg(F.collect_set("subtree").alias("all"))     # together BROADCAST_ROWS at most
        told = parsed.join(F.broadcast(per_host), "host", "left").withColumn("template", F.array_intersect("subtrees", "all"))
    else:
        # A list per article, of its own subtrees only.
        own = seen.join(often, ["host", "subtree"]).groupBy("host", "article").agg(F.collect_set("subtree").alias("template"))
        told = parsed.join(own, ["host", "article"], "left")
    kept = F.filter("blocks", lambda b: ~F.arrays_overlap(b["inside"], F.col("template")))
    blocks = F.when(F.col("template").isNull(), F.col("blocks")).otherwise(kept)
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    return (told.select("page_id", "url", text.alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: main text of the whole ``pages`` table."""
    return extract_text(read_table(spark, sf_dir, "pages"))
