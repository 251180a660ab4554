"""Main text of web pages by wrapper induction.

The DOM of every page is folded to its structure: siblings of one kind (tag and first class) count
once. Per host the most frequent structure is the reference, and every other structure of the host is
aligned to it by simple tree matching, which names the slots of all its pages alike. Counts over all
pages of the host then tell template from content: a slot that holds the same text on most pages, or
mostly link text, is template; a slot whose text varies is content.

A page's text comes from its ``article`` or ``main`` element where it has one, less the furniture that
mark-up names (navigation, adverts, comments, forms, ...) and less the slots in it that hold the same
text on most pages; its outline is what lies in that element. Elsewhere it is the text of the varying
slots. Pages of a host with the same outline and texts are copies and count once, so that copies never
turn content into template. Hosts with fewer than ``MIN_PAGES`` different pages have no template of their own.

Defined results: null and empty html give empty text; cut-off pages give what is there; an unclosed
element ends where its parent ends, and an ``article`` or ``main`` ends any furniture left open before
it. Rows are independent, so repeated rows give repeated results. A null url is a host of its own.
"""

from __future__ import annotations

import functools
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardgrid.llm.common import bounded_broadcast, python_ready
from hazardgrid.session import cut_lineage

MIN_PAGES = 3
#: Share of a host's pages with one text, and share of link characters, from which a slot is template.
CONSTANT_SHARE = 0.5
LINK_SHARE = 0.6

# HTML elements and usual names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
DROPPED = set(
    "script style noscript template iframe svg math object canvas audio video head title nav footer aside form button "
    "select option textarea dialog menu label datalist".split()
)
ROOTS = {"article", "main"}
NAMES = set(
    "ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent notice notices alert newsletter subscribe popup modal overlay share "
    "sharing social related recommended comment comments disqus reply replies footer masthead widget toolbar login signup "
    "search pagination pager copyright disclaimer".split()
)
HEAD_NAMES = {"header", "top", "topbar"}
BODY_NAMES = set("content article post entry story text body main".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Elements that end an open element of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "body"}


class Reader(HTMLParser):
    """Blocks in page order: ``(path, text, link characters, inside a root)``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, bool, bool]] = []  # tag, path, furniture, inside a root
        self.blocks: list[tuple[str, str, int, bool]] = []
        self.parts: list[str] = []
        self.links = self.anchors = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            path, inside = next(((s[1], s[3]) for s in reversed(self.stack) if not s[2]), ("", False))
            self.blocks.append((path, text, self.links, inside))
        self.parts, self.links = [], 0

    def stack_state(self):
        if not self.stack:
            return False, "", False
        _, path, off, inside = self.stack[-1]
        return off, path, inside

    def furniture(self, tag: str, attrs: dict, inside: bool) -> bool:
        if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if attrs.get("role") in ROLES:
            return True
        tokens = set(re.split(r"[^a-z0-9]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
        if tag in ROOTS:
            return bool(tokens & {"comment", "comments", "reply", "related", "ad", "advert", "sponsored"})
        if not inside and (tag == "header" or tokens & HEAD_NAMES) and not tokens & BODY_NAMES:
            return True
        return bool(tokens & NAMES) and not tokens & BODY_NAMES

    def pop_to(self, k: int):
        if any(s[0] in BLOCK for s in self.stack[k:]):
            self.flush()
        self.anchors -= sum(s[0] == "a" for s in self.stack[k:])
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        if tag in ENDS:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in ENDS[tag]:
                    self.pop_to(k)
                    break
                if self.stack[k][0] in FENCES:
                    break
        if tag in ROOTS:
            for k, s in enumerate(self.stack):
                if s[2] and s[0] not in ROOTS and not any(x[0] in ROOTS for x in self.stack[:k]):
                    self.pop_to(k)
                    break
        off, path, inside = self.stack_state()
        attrs = {k: v for k, v in attrs}
        name = (attrs.get("class") or "").split()
        path = f"{path}/{tag}" + (f".{name[0].lower()}" if name and tag in BLOCK else "")
        here = off or self.furniture(tag, attrs, inside)
        self.stack.append((tag, path if tag in BLOCK else self.stack_state()[1], here, inside or (tag in ROOTS and not here)))
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop_to(k)
                return
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        if self.stack and self.stack[-1][2]:
            return
        self.parts.append(data)
        if self.anchors > 0:
            self.links += len(data.strip())


def read_blocks(html: str | None) -> list[tuple[str, str, int, bool]]:
    reader = Reader()
    reader.feed(re.sub(r"<[A-Za-z/!][^<>]*\Z", "", html or ""))
    reader.close()
    reader.flush()
    return reader.blocks


def fold(paths) -> dict:
    """Structure of a page: nested dict of labels in order of first appearance."""
    root: dict = {}
    for path in paths:
        node = root
        for label in path.split("/")[1:]:
            node = node.setdefault(label, {})
    return root


def written(node: dict) -> str:
    return "".join(f"({k}{written(v)})" for k, v in node.items())


def read_structure(text: str) -> dict:
    root: dict = {}
    stack = [root]
    for opened, closed in re.findall(r"\(([^()]*)|(\))", text):
        if closed:
            stack.pop()
        else:
            stack.append(stack[-1].setdefault(opened, {}))
    return root


def match_trees(a: dict, b: dict) -> tuple[int, list]:
    """Simple tree matching of two child lists: size of the best ordered match, and its label pairs."""
    ka, kb = list(a), list(b)
    inner = {(x, x): match_trees(a[x], b[x]) for x in ka if x in b}
    best = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    for i, x in enumerate(ka):
        for j, y in enumerate(kb):
            got = best[i][j] + 1 + inner[x, y][0] if x == y else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], got)
    pairs, i, j = [], len(ka), len(kb)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((ka[i], inner[ka[i], kb[j]][1]))
    return best[len(ka)][len(kb)], pairs[::-1]


@functools.lru_cache(maxsize=4096)
def aligned_paths(page: str, reference: str) -> frozenset[str]:
    """Paths of the page that have a counterpart in the reference."""
    out = set()

    def walk(pairs, at):
        for label, below in pairs:
            out.add(f"{at}/{label}")
            walk(below, f"{at}/{label}")

    walk(match_trees(read_structure(page), read_structure(reference))[1], "")
    return frozenset(out)


def slot_of(path: str, page: str, reference: str | None) -> str:
    """A slot is a path of the reference; nodes without counterpart keep their own path, marked."""
    return path if reference is not None and path in aligned_paths(page, reference) else f"+{path}"


def deciding_blocks(html: str | None) -> list[tuple[str, str, int, bool]]:
    """Blocks inside the roots of a page, which are no links then, or all blocks of a page without."""
    blocks = read_blocks(html)
    return [(path, text, 0, True) for path, text, _, inside in blocks if inside] or blocks


def main_text(html: str | None, reference: str | None, template: frozenset[str]) -> str:
    blocks = deciding_blocks(html)
    page = written(fold(p for p, *_ in blocks))
    left = [b for b in blocks if slot_of(b[0], page, reference) not in template]
    return "\n\n".join(text for _, text, links, _ in left if links < LINK_SHARE * len(text))


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """``host, reference, template``: the reference structure and the template slots of every host."""
    python_ready(pages.sparkSession)

    @F.pandas_udf("page string, slots array<struct<path:string,n:int,links:int,h:long>>")
    def outline(htmls: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for html in htmls:
            blocks = deciding_blocks(html)
            slots: dict[str, list] = {}
            for path, text, links, _ in blocks:
                s = slots.setdefault(path, [0, 0, xxhash.xxh64()])
                s[0] += len(text)
                s[1] += min(links, len(text))
                s[2].update(text.encode())
            found = [(p, n, k, h.intdigest() - (1 << 63)) for p, (n, k, h) in slots.items()]
            rows.append((written(fold(slots)), [dict(zip(("path", "n", "links", "h"), f)) for f in found]))
        return pd.DataFrame(rows, columns=["page", "slots"])

    @F.pandas_udf("string")
    def slot(paths: pd.Series, page: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([slot_of(*x) for x in zip(paths, page, reference)], dtype=object)

    seen = pages.select(_host(F.col("url")).alias("host"), outline("html").alias("o")).select("host", "o.*")
    seen = seen.withColumn("print", F.xxhash64("page", "slots"))
    seen = cut_lineage(seen.dropDuplicates(["host", "print"]).drop("print"))
    seen = seen.filter(F.size("slots") > 0)  # not earlier: a filter on the outline would make it twice
    kinds = seen.groupBy("host", "page").agg(F.count("*").alias("n"))
    refs = kinds.groupBy("host").agg(F.max(F.struct("n", "page")).alias("r"), F.sum("n").alias("pages"))
    refs = cut_lineage(refs.select("host", F.col("r.page").alias("reference"), "pages"))
    texts = seen.select("host", "page", F.inline("slots")).groupBy("host", "page", "path", "h")
    texts = texts.agg(F.count("*").alias("same"), F.sum("n").alias("chars"), F.sum("links").alias("links"))
    texts = texts.join(bounded_broadcast(refs), "host").withColumn("slot", slot("path", "page", "reference"))
    texts = texts.groupBy("host", "slot", "h").agg(*[F.sum(c).alias(c) for c in ("same", "chars", "links")])
    per = texts.groupBy("host", "slot").agg(
        F.max("same").alias("top"), F.sum("same").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    constant = (F.col("n") >= MIN_PAGES) & (F.col("top") >= CONSTANT_SHARE * F.col("n"))
    linked = F.col("links") >= LINK_SHARE * F.col("chars")
    fixed = per.filter(constant | linked).groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("template"))
    return refs.join(fixed, "host", "left").select(
        "host", "reference", F.coalesce("template", F.array().cast("array<string>")).alias("template")
    )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``page_id, url, html``."""
    wrappers = cut_lineage(induce_wrappers(pages.select("url", "html")))

    @F.pandas_udf("string")
    def take(htmls: pd.Series, refs: pd.Series, fixed: pd.Series) -> pd.Series:
        known = [frozenset(t) if t is not None else frozenset() for t in fixed]
        return pd.Series([main_text(*x) for x in zip(htmls, refs, known)], dtype=object)

    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    rows = rows.join(bounded_broadcast(wrappers), "host", "left")
    return rows.select("page_id", "url", take("html", "reference", "template").alias("text"))
