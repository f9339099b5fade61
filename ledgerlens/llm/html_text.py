"""Main text of web pages: the site's template is found by counting and removed.

Each page is parsed into elements; each element's subtree gets a hash of its
tags, classes and text. Spark counts, per host, the pages that hold a subtree,
once for each distinct readable text around it, so that copies of a page don't
make its text template. Subtrees that recur like this on many pages of their
host are template: they go, as do elements whose tag, role, class or id names them as menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or comments.

Inside the article the counts decide as well. What is around a subtree there is
told by the smallest hash of the article's other texts, which near copies of a
page mostly share, so that these count as few pages. A heading, paragraph or
other text block of the article is template if it recurs on more than half of
the host's pages, as a standing notice does; other subtrees in it, and all
subtrees outside, if they recur on more than a twentieth. Without an article
element the whole body is held against the template.

The article is the first main element in page order, or the only article
element that isn't named as something else; of several articles without a main
element none is taken, and the body is read. Defined cases: null or empty html
gives an empty text; a url without host belongs to no site and has no template;
broken markup is read as far as it goes (unclosed elements end with their
parents); repeated rows and pages of equal readable text count once; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import col, fresh, written

#: A subtree is template if it is on so many pages of its host, and on more than this share of them; the share for text blocks of the article.
MIN_PAGES, SHARE, ARTICLE_SHARE = 5, 0.05, 0.5

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"))
UNREAD = RAW | frozenset(("head", "svg", "math", "object", "canvas", "audio", "video", "map", "select", "button", "form", "nav", "header", "footer", "aside", "dialog", "menu", "datalist"))
BLOCK = frozenset(("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
                   "blockquote pre figure figcaption address details summary hr fieldset center").split()) | UNREAD
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption".split())
#: What the start of one element ends: itself or its like, unless one of the bounds is nearer.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words that a class or id is made of when the element is not main text.
NOT_MAIN = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb
breadcrumbs header masthead footer sidebar aside rail cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login
popup modal overlay comment comments commentlist disqus respond reply replies share sharing social related recommended pagination pager
toolbar search form skip widget""".split())
#: Elements that hold the main text whatever their layout is called.
KEPT = dict.fromkeys(("html", "body", "main"), NOT_MAIN) | {"article": frozenset("nav navbar navigation menu menubar header footer sidebar aside rail share sharing social notice notices widget cookie form".split())}

_TOKENS = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "marks", "named", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.marks, self.named = tag, [], "", False
        if attributes and not attributes.isspace():
            found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            self.marks = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip().lower()
            words = set(_WORDS.findall(self.marks)) - KEPT.get(tag, frozenset())
            self.named = bool(words & NOT_MAIN) or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"


def parse(html: str) -> Element:
    """The page's elements; texts are strings between them, references decoded."""
    root = Element("#page")
    stack, at, size = [root], 0, len(html)
    while at < size:
        m = _TOKENS.search(html, at)
        start = m.start() if m else size
        if start > at:
            stack[-1].children.append(unescape(html[at:start]))
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            continue
        if name in BLOCK:  # a block ends an open paragraph, formatting elements in it included
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if name in ENDS:
            like, bounds = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in like:
                    del stack[i:]
                    break
        element = Element(name, m[3])
        stack[-1].children.append(element)
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        stack.append(element)
    return root


def _walk(root: Element):
    """Elements with those above them last: children come before their parents. No recursion, as nesting may be deep."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        out.append(e)
        stack += [c for c in e.children if not isinstance(c, str)]
    return reversed(out)


def subtree_hashes(root: Element) -> dict[int, int]:
    """64-bit hash of the subtree of each block element with text, by the element's identity."""
    digests: dict[int, bytes] = {}
    out = {}
    for e in _walk(root):
        if e.tag in RAW:
            digests[id(e)] = b""
            continue
        parts = [e.tag.encode(), e.marks.encode()]
        some = False
        for c in e.children:
            if isinstance(c, str):
                words = _SPACE.sub(" ", c).strip()
                if words:
                    some = True
                    parts.append(words.encode("utf-8", "surrogatepass"))
            else:
                inner = digests[id(c)]
                if inner:
                    some = True
                    parts.append(inner)
        digests[id(e)] = blake2b(b"\0".join(parts), digest_size=8).digest() if some else b""
        if some and e.tag in BLOCK and e.tag not in ("html", "body"):
            out[id(e)] = int.from_bytes(digests[id(e)], "little", signed=True)
    return out


def article_of(root: Element) -> Element | None:
    """The page's first main element, or its only article element."""
    stack, articles = [root], []
    while stack:
        e = stack.pop()
        if e.tag == "main":
            return e
        if e.tag == "article" and not e.named:
            articles.append(e)
            continue
        if e.tag not in UNREAD and not e.named:
            stack += [c for c in reversed(e.children) if not isinstance(c, str)]
    return articles[0] if len(articles) == 1 else None


def surroundings(root: Element) -> tuple[list[tuple[int, bool, int]], int]:
    """Per readable subtree: its hash, whether it is a text block of the article, and a 64-bit number for the readable texts around it; the number of the whole page.

    In the article the number is the smallest hash of its other texts, else the sum of the hashes of the page's other texts.
    """
    from xxhash import xxh64_intdigest

    hashes, main = subtree_hashes(root), article_of(root)
    most = 1 << 64
    texts: list[int] = []  # hashes in the order of the walk, in which the texts of a subtree stand together
    readable: list[tuple[Element, bool, int]] = []
    ends: dict[int, int] = {}
    stack: list[tuple[Element | str, bool, bool]] = [(root, False, False)]
    while stack:
        e, inside, leaving = stack.pop()
        if isinstance(e, str):
            words = _SPACE.sub(" ", e).strip()
            if words:
                texts.append(xxh64_intdigest(words.encode("utf-8", "surrogatepass")))
            continue
        if leaving:
            ends[id(e)] = len(texts)
            continue
        if e is not main and (e.tag in UNREAD or e.named):
            continue
        readable.append((e, inside, len(texts)))
        stack.append((e, inside, True))
        stack += [(c, inside or e is main, False) for c in e.children]
    sums, before, after = [0], [], [most] * (len(texts) + 1)
    for x in texts:
        sums.append(sums[-1] + x)
    first, last = next(((at, ends[id(e)]) for e, _, at in readable if e is main), (0, 0))
    least = most
    for i in range(first, last + 1):  # smallest of the article's texts before each place
        before.append(least)
        if i < last:
            least = min(least, texts[i])
    for i in reversed(range(first, last)):
        after[i] = min(texts[i], after[i + 1])

    def signed(x: int) -> int:
        return (x & 0xFFFFFFFFFFFFFFFF ^ 1 << 63) - (1 << 63)

    out = []
    for e, inside, at in readable:
        if id(e) in hashes:
            until = ends[id(e)]
            around = min(before[at - first], after[until]) if inside else sums[-1] - sums[until] + sums[at]
            out.append((hashes[id(e)], inside and e.tag in TEXT_BLOCK, signed(around)))
    return out, signed(sums[-1])


def main_text(root: Element, template: frozenset[int], standing: frozenset[int] = frozenset()) -> str:
    """Blocks of main text in page order, two line ends between them, without subtrees of the ``template`` and, in the article, ``standing`` text blocks."""
    hashes = subtree_hashes(root) if template or standing else {}
    main = article_of(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = _SPACE.sub(" ", "".join(line)).strip()
        if words:
            blocks.append(words)
        line.clear()

    stack: list[tuple[Element | str | None, bool]] = [(main if main is not None else root, main is not None)]
    while stack:
        e, inside = stack.pop()
        if e is None:
            flush()
            continue
        if isinstance(e, str):
            line.append(e)
            continue
        if e is not main:
            if e.tag in UNREAD or e.named:
                if e.tag in BLOCK:
                    flush()
                continue
            if hashes.get(id(e)) in (standing if inside and e.tag in TEXT_BLOCK else template):
                flush()
                continue
        if e.tag in ("br", "img", "wbr"):
            line.append(" " if e.tag == "br" else "")
            continue
        block = e.tag in BLOCK or e is main
        if block:
            flush()
            stack.append((None, inside))
        stack += [(c, inside) for c in reversed(e.children)]
    flush()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-case host of a url, null if it has none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """``host``, ``hashes``, ``standing``: the subtrees that recur on many of its pages, and the text blocks that do so in its articles. Their number is bounded by a page's subtrees over the share."""
    import pandas as pd

    def hashed(frames):
        for frame in frames:
            rows = []
            for h, t in zip(frame["host"], frame["t"]):
                found, page = surroundings(parse(t))
                rows += [(h, None, False, page), *((h, *x) for x in found)]
            yield pd.DataFrame({"host": [r[0] for r in rows], "hash": pd.array([r[1] for r in rows], "Int64"), "standing": [r[2] for r in rows], "around": [r[3] for r in rows]})

    known = pages.select(host_of(col(url)).alias("host"), col(html).alias("t")).where("host IS NOT NULL AND t <> ''")
    # a row of no hash stands for its page; equal rows are copies
    counted = known.mapInPandas(hashed, "host string, hash bigint, standing boolean, around bigint").distinct().groupBy("host", "hash", "standing").agg(F.count("*").alias("n"))
    counted = written(counted.where(F.col("hash").isNull() | (F.col("n") >= min_pages)), "html-counts")
    totals = counted.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    counted = counted.where("hash IS NOT NULL")
    found = counted.join(totals, "host").where(F.col("n") > F.col("pages") * F.when(F.col("standing"), article_share).otherwise(share))
    listed = lambda which: F.collect_list(F.when(which, F.col("hash")))
    return found.groupBy("host").agg(listed(~F.col("standing")).alias("hashes"), listed(F.col("standing")).alias("standing"))


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """Per row: ``page``, ``url``, ``text``."""
    import pandas as pd

    found = written(templates(pages, url, html, min_pages, share, article_share), "html-templates")
    kinds = dict(pages.dtypes)
    host, loose, hashes, standing = (fresh(pages, x) for x in ("_host", "_loose", "_hashes", "_standing"))
    base = pages.select(col(page).alias("p"), col(url).alias("u"), F.coalesce(col(html), F.lit("")).alias("t"))
    # pages without a host match nothing and are dealt over many keys
    base = base.withColumns({host: F.coalesce(host_of(F.col("u")), F.lit("")), loose: F.when(host_of(F.col("u")).isNull(), F.pmod(F.xxhash64("p"), F.lit(4096)) + 1).otherwise(F.lit(0).cast("bigint"))})
    joined = base.join(found.select(F.col("host").alias(host), F.lit(0).cast("bigint").alias(loose), F.col("hashes").alias(hashes), F.col("standing").alias(standing)), [host, loose], "left")

    def read(frames):
        sets: dict[bytes, frozenset[int]] = {}

        def held(found_) -> frozenset[int]:
            key = b"" if found_ is None else found_.tobytes()
            if key not in sets:
                if len(sets) > 128:
                    sets.clear()
                sets[key] = frozenset(() if found_ is None else found_.tolist())
            return sets[key]

        for frame in frames:
            texts = [main_text(parse(t), held(a), held(b)) for t, a, b in zip(frame["t"], frame[hashes], frame[standing])]
            yield pd.DataFrame({page: frame["p"], "url": frame["u"], "text": texts})

    return joined.select("p", "u", "t", hashes, standing).mapInPandas(read, f"`{page}` {kinds[page]}, url string, text string")
