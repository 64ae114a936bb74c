"""Main text of raw web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive and tags
negative, with weights learned from pages that label their own content (an
article element or the like): a word scores the share of words of its class that
is content, a tag minus ``TAG_COST`` times the share of tags of its class that is
not. One linear scan finds the contiguous region with the largest sum. Page
furniture (menus, forms, adverts ...) scores nothing and is left out of the
region's text, so that a form between two paragraphs does not part them.

The class of a word or tag: its tag (of a word, the nearest block's), whether it
is in a link, and whether it stands inside the page's labelled content, outside of
it, or on a page without labels. Each labelled page also trains the classes of
pages without labels.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import text_of

#: Labelled pages that the weights are learned from, about (chosen by hash).
SAMPLE_PAGES = 4_096
#: Cost of a tag that never stands in content.
TAG_COST = 3.25
#: Least sum of a region that counts as content at all: about half a sure word.
LEAST_SCORE = 0.5

_ITEM = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/])[^>]*/>"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>"""
    r"|<[/!?a-z][^>]*>"
    r"|(?P<text>[^<]+|<)", re.I | re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
KNOWN = BLOCK | VOID | frozenset("a abbr b button cite code em font i label q s select small span strong sub sup title u".split())
#: Tags whose start ends an open one of the named kind.
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
          "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
FURNITURE_TAGS = frozenset("nav aside footer form button select head title dialog menu search option label".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar widget footer masthead banner ad ads advert adverts "
    "advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comment comments discussion disqus respond reply replies pagination pager toolbar skip copyright".split())

ARTICLE_FURNITURE = frozenset("comment comments reply ad advert promo related".split())
#: A class that tells of a state of the element or of what goes with it does not name the element.
_STATE = re.compile(r"(?:has|no|not|is|with|without)[-_]|.*[-_](?:with|without|no|has)[-_]|.*[-_](?:enabled|disabled|open|opened|closed|free)$", re.I)
#: Share of the words outside links that an element must hold so that a name or form does not make it
#: furniture; more if a whole class or id of it is such a name ('comments'), or within labelled content.
HELD, HELD_NAMED = 0.5, 0.9

OUT, IN, UNLABELLED = 0, 1, 2
SURE, BY_NAME, BY_WHOLE_NAME = 1, 2, 3


class _Open:
    __slots__ = ("tag", "furniture", "article", "main", "named", "label", "first")

    def __init__(self, tag, furniture, article, main, named, label, first):
        self.tag, self.furniture, self.article, self.main = tag, furniture, article, main
        self.named, self.label, self.first = named, label, first


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(attrs)} if attrs and not attrs.isspace() else {}


def _furniture(tag: str, at: dict[str, str], within: bool) -> int:
    """0, or how it is known that the element is furniture: SURE, BY_NAME (or as a form) or BY_WHOLE_NAME."""
    if (tag in FURNITURE_TAGS and tag != "form") or (tag == "header" and not within):
        return SURE
    if at and (at.get("role", "").lower() in FURNITURE_ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true"
               or re.search(r"display\s*:\s*none", at.get("style", ""), re.I)):
        return SURE
    by_name = BY_NAME if tag == "form" else 0
    if not at or tag in ("html", "body", "main"):
        return by_name
    known = ARTICLE_FURNITURE if tag == "article" else FURNITURE_NAMES if within else FURNITURE_NAMES | {"header"}
    named = [c for c in f"{at.get('class', '')} {at.get('id', '')}".split() if not _STATE.match(c)]
    if any(c.lower() in known for c in named):
        return BY_WHOLE_NAME
    return BY_NAME if any(n.lower() in known for c in named for n in _NAME.findall(c)) else by_name


def _wrappers(items: list[tuple], named: list[list[int]], labels: list[tuple]) -> frozenset[int]:
    """Numbers of the elements in ``named`` (number, how, first, end) that hold the page's content.

    If an article or main (``labels``: is main, first, end) stands outside of all of them, those that hold
    most of its words; else those around a main or the longest article; else those with most of the page's words.
    Words in elements whose whole class or id is a furniture name don't count against the others.
    """
    sizes = [len(entities.unescape(i[6]).split()) if i[1] and not i[2] and not i[3] else 0 for i in items]
    words = [0, *accumulate(sizes)]
    free: set[int] = set()

    def depth(spans):
        steps = [0] * (len(items) + 1)
        for first, end in spans:
            steps[first] += 1
            steps[end] -= 1
        return list(accumulate(steps))

    while True:
        held = [e for e in named if e[0] not in free]
        inside = depth((first, end) for _, _, first, end in held)
        seen = [x for x in labels if not inside[x[1]]]
        new: set[int] = set()
        if labels and not seen:
            mains = [x for x in labels if x[0]]
            best = max(mains or labels, key=lambda x: words[x[2]] - words[x[1]])
            new = {no for no, _, first, end in held if first <= best[1] < end}
        else:
            articles = [x for x in seen if not x[0]]
            scope = depth((first, end) for _, first, end in articles or seen) if seen else [1] * len(items)
            outer = depth((first, end) for _, how, first, end in held if how == BY_WHOLE_NAME)
            every = [0, *accumulate(n if scope[i] else 0 for i, n in enumerate(sizes))]
            other = [0, *accumulate(n if scope[i] and not outer[i] else 0 for i, n in enumerate(sizes))]
            for no, how, first, end in held:
                of = every if how == BY_WHOLE_NAME else other
                if of[end] - of[first] > (HELD_NAMED if seen or how == BY_WHOLE_NAME else HELD) * of[-1]:
                    new.add(no)
        if not new:
            return frozenset(free)
        free |= new


def page_items(page: str) -> tuple[list[tuple], bool, bool]:
    """([(tag or '', is_text, in link, furniture, in article, in main, text)], has article, has main).

    A page with elements that only a name or a form makes furniture is read once without
    these, to see which of them hold its content.
    """
    items, has_article, has_main, named, labels = _read(page, None)
    if not named:
        return items, has_article, has_main
    return _read(page, _wrappers(items, named, labels))[:3]


def _read(page: str, free: frozenset[int] | None) -> tuple[list[tuple], bool, bool, list[list[int]], list[tuple]]:
    """The items of a page, and its elements with furniture names and its labels, as ``_wrappers`` takes them.

    Of the elements with such names those in ``free`` are not furniture, without ``free`` none is.
    """
    items, stack, named, labels = [], [], [], []
    links = number = 0
    furniture = article = main = 0
    has_article = has_main = False

    def pop():
        nonlocal links, furniture, article, main
        e = stack.pop()
        if e.named:
            e.named[3] = len(items)
        if e.label and not furniture:
            labels.append((e.main, e.first, len(items)))
        links -= e.tag == "a"
        furniture -= e.furniture
        article -= e.article
        main -= e.main

    for m in _ITEM.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            block = next((e.tag for e in reversed(stack) if e.tag in BLOCK), "")
            items.append((block, True, links > 0, furniture > 0, article > 0, main > 0, m["text"]))
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if any(e.tag == tag for e in stack):
                while stack[-1].tag != tag:
                    pop()
                pop()
            items.append(("/" + tag, False, links > 0, furniture > 0, article > 0, main > 0, ""))
            continue
        ends = CLOSES.get(tag) or (("p",) if tag in BLOCK else ())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in ends:
                while len(stack) > i:
                    pop()
            elif stack[i].tag in BLOCK:
                break
        items.append((tag, False, links > 0, furniture > 0, article > 0, main > 0, ""))
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        at = _attributes(m["attrs"])
        how = _furniture(tag, at, article > 0 or main > 0)
        number += 1
        off = how == SURE or (how > SURE and free is not None and number not in free)
        mark = [number, how, len(items), 0] if how > SURE else None
        if mark and not furniture:
            named.append(mark)
        is_article = tag == "article" and not off
        is_main = not off and (tag == "main" or at.get("role", "").lower() == "main" or at.get("itemprop") == "articleBody")
        has_article |= is_article and not furniture
        has_main |= is_main and not furniture
        # A named article is a label of its own only when it is read as one.
        stack.append(_Open(tag, off, is_article, is_main, mark, (is_article or is_main) and not mark, len(items)))
        links += tag == "a"
        furniture += off
        article += is_article
        main += is_main
    while stack:
        pop()
    return items, has_article, has_main, named, labels


def item_class(item: tuple, where: int) -> str:
    tag, is_text, link = item[:3]
    bare = tag.lstrip("/")
    if bare not in KNOWN:
        tag = tag[:len(tag) - len(bare)] + "other"
    if where == UNLABELLED and bare in ("article", "main"):
        tag = tag.replace(bare, "div")
    return f"{'w' if is_text else 't'}:{tag}:{int(link)}{where}"


def _place(item: tuple, has_article: bool, has_main: bool) -> int:
    return int(item[4]) if has_article else int(item[5]) if has_main else UNLABELLED


def class_counts(pages) -> Counter:
    """(class, is content) -> words or tags, over labelled pages, without furniture."""
    seen: Counter = Counter()
    for page in pages:
        items, has_article, has_main = page_items(page)
        if not has_article and not has_main:
            continue
        for item in items:
            n = len(entities.unescape(item[6]).split()) if item[1] else 1
            if n and not item[3]:
                place = _place(item, has_article, has_main)
                seen[item_class(item, place), place == IN] += n
                seen[item_class(item, UNLABELLED), place == IN] += n
    return seen


def item_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Class -> weight of one word (0 to 1) or tag (0 to -TAG_COST), with add-half smoothing."""
    weights = {}
    for name in {c for c, _ in counts}:
        n_in, n_out = counts.get((name, True), 0), counts.get((name, False), 0)
        share = (n_in + 0.5) / (n_in + n_out + 1)
        weights[name] = share if name[0] == "w" else -TAG_COST * (1 - share)
    return weights


def _weight(name: str, weights: dict[str, float]) -> float:
    if name in weights:
        return weights[name]
    share = {str(IN): 1.0, str(OUT): 0.0}.get(name[-1], 0.5)  # a class never seen: as its place says
    return share if name[0] == "w" else -TAG_COST * (1 - share)


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """(first, end, sum) of the contiguous region with the largest sum, the first of equal ones."""
    best, first, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, end = total, start, i + 1
    return first, end, best


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text: blocks of the best region, parted by empty lines; '' if there is none."""
    items, has_article, has_main = page_items(page or "")
    scores, texts = [], []
    for item in items:
        text = entities.unescape(item[6]) if item[1] else ""
        texts.append(text)
        n = len(text.split()) if item[1] else 1
        counts = n and not item[3]
        scores.append(n * _weight(item_class(item, _place(item, has_article, has_main)), weights) if counts else 0.0)
    first, end, best = best_region(scores)
    if best < LEAST_SCORE:
        return ""
    blocks, block = [], []
    for item, text in zip(items[first:end], texts[first:end]):
        if item[1]:
            if not item[3]:
                block.append(text)
        elif (bare := item[0].lstrip("/")) in ("td", "th", "br"):
            block.append(" ")
        elif bare in BLOCK:
            blocks.append(block)
            block = []
    blocks.append(block)
    return "\n\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def learned_weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from a bounded sample of the pages that label their content.

    Counts are summed by Spark; the driver receives a row per class, of which
    there are a few hundred whatever the pages hold.
    """
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b|role\s*=\s*.?main|itemprop\s*=\s*.?articleBody"))
    n = labelled.count()
    draw = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) / (1 << 30)
    chosen = labelled.where(draw < min(1.0, sample / max(n, 1))).select("html")

    def counted(frames):
        seen: Counter = Counter()
        for frame in frames:
            seen.update(class_counts(frame["html"]))
        yield pd.DataFrame([(c, content, n) for (c, content), n in seen.items()], columns=["name", "content", "n"])

    counts = chosen.mapInPandas(counted, "name string, content boolean, n long").groupBy("name", "content").agg(F.sum("n").alias("n"))
    return item_weights({(r["name"], r["content"]): r["n"] for r in counts.collect()})


def extracted(weights: dict[str, float], html: Column) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: main_text(p, weights))
    run.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(html)


def main_text_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Defined results: a null or empty html, or a page without content, has the
    empty text; repeated rows are rows of their own; an empty table gives no rows.
    """
    weights = learned_weights(pages.select("page_id", "url", "html"))
    return (pages.select("page_id", "url", extracted(weights, text_of("html")).alias("text"))
                 .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
