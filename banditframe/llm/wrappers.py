"""Main text of web pages by wrappers inferred from the pages of each host.

A page is read as a tree of block elements and texts. Its wrapper is a regular expression without unions: elements by tag and
masked attributes, text slots, optional items, and repeated elements and groups. Wrappers of one host are aligned two at a time,
level by level: items that both have are merged, what one lacks becomes optional, runs become repeated groups, and texts meet in
slots. A slot knows whether its text varies over the host's pages. Pages are then aligned with their host's wrapper, and what
varies in the article is their text: the innermost kind of place that a page has (article, main part, body), without menus,
headers, footers and the like, without texts that the host repeats on its pages (template), and without repeated lists of links.

Inside an article or main part a text counts as template only if it is no heading, stands in its place on every page of the host that
has such a part, is the same on `FEW` different pages at least, and other texts there vary; and of a page's article such texts are
left out only if they are less than half of it, however many pages there are. So near copies of a page, which share most of their
text, keep what they share. Elsewhere the same text on `FEW` pages is template. An h1 above the article that is not the same on
all pages is its title, if it has no other.

Wrappers are bounded by merging, never by dropping: numbers in attributes are masked, elements below a depth belong to the element
at that depth, and a wrapper of too many items is made coarser (siblings of one tag become one repeated item, then deep elements
become one slot). What no item of the wrapper matches is judged by its place in the page.

Cases: null or empty html has empty text; null or unreadable urls are one host; unclosed tags end with their parent or with the
page, text after a broken tag is kept; a page whose every text stands in places beside the text by their class names is read
without regard to these; an empty table gives an empty result; equal pages of a host give equal texts; columns text and n_chars
are replaced, other columns are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html import unescape
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banditframe.llm.common import cut

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^<]+|<""", re.S)
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "svg", "object", "select", "title"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Inline elements that may stand beside the text.
ASIDE = {"a", "b", "em", "i", "ins", "small", "span", "strong"}
#: Elements that a new one of the same kind ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}
#: First parts of class names and ids that say what stands beside the text, alone or with one of LAYOUT after it.
BESIDE = {"ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "alerts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disclaimer", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "notifications", "pagination", "popup", "promo", "promotion", "related", "reply", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets"}
LAYOUT = {"area", "banner", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "footer", "form", "group", "header", "inner", "item", "items", "left", "link", "links", "list", "main", "menu", "message", "nav", "notice", "overlay", "panel", "popup", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "thread", "top", "unit", "wrap", "wrapper", "0"}
#: Whole names, without what parts their words.
BESIDE_NAMES = {"aboutauthor", "adsbygoogle", "authorbio", "authorbox", "commentlist", "commentslist", "entrymeta", "mainmenu", "mainnav", "postmeta", "sidecol", "sidenav", "skiplink", "subnav", "topmenu", "topnav"}
#: What a class name of a whole page's header is made of.
HEADERS = {"header", "site", "page", "top", "main", "global", "masthead"}
#: The only ones that hold for an article, main part or body as a whole.
REMARKS = {"ad", "advert", "comment", "comments", "promo", "related", "reply", "sponsored"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements deeper than this are not told apart in wrappers; a wrapper has at most about this many items.
DEEPEST, MOST = 60, 2000
FEW = 3
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|$|/)""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BESIDE_NOT, BESIDE_CLASS, BESIDE_TAG = 0, 1, 2


class _Cache(dict):
    """make(key) for each key, emptied when it has many."""

    def __init__(self, make, most: int = 20_000) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


# ---- pages


def _signature(tag: tuple[str, str]) -> str:
    """Tag name and the words of class (.), id (#) and role (@), numbers masked; ! if the element is hidden."""
    name, attrs = tag
    words = set()
    for k, x, y, z in ATTR.findall(attrs):
        k = k.lower()
        if k == "hidden" or k == "style" and UNSEEN.search(x or y or z):
            words.add("!")
        elif k == "style":
            continue
        else:
            words |= {{"class": ".", "id": "#", "role": "@"}[k] + re.sub(r"(?<=[-_])\d+|\d{2,}", "0", w) for w in (x or y or z).split()}
    return " ".join([name, *sorted(words)])


SIGNATURES = _Cache(_signature)


def _beside(word: str, whole: bool) -> bool:
    """Whether a class name or id says that its element stands beside the text; whole: of an article, main part or body."""
    parts = [x for x in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()) if x]
    if whole or not parts:
        return parts[:1] != [] and parts[0] in REMARKS and len(parts) == 1
    if "".join(parts) in BESIDE_NAMES:
        return True
    if parts[0] in BESIDE:
        return all(x in LAYOUT or x in BESIDE for x in parts[1:])
    return len(parts) > 1 and parts[-1] in BESIDE and parts[0] not in ("no", "has", "with", "without", "is")


def _kind(signature: str) -> tuple[int, int, bool]:
    """(level: 2 article, 1 main part, 0 others; BESIDE_...: whether it stands beside the text; whether it is a page's header)."""
    name, *words = signature.split(" ")
    level = 2 if name == "article" else 1 if name == "main" or "@main" in words else 0
    header = name == "header" or any(w[0] in ".#" and "header" in w and set(re.split(r"[-_]+", w[1:].lower())) <= HEADERS for w in words)
    if name in OUTSIDE or "!" in words or any(w[0] == "@" and w[1:].lower() in ROLES for w in words):
        return level, BESIDE_TAG, header
    if name in ("html", "body") or level == 1:
        return level, BESIDE_NOT, header and level == 0 and name not in ("html", "body")
    return level, BESIDE_CLASS if any(w[0] in ".#" and _beside(w[1:], level == 2) for w in words) else BESIDE_NOT, header


KINDS = _Cache(_kind)


def _below(place: int, signature: str) -> int:
    """The place of what stands in an element: 2 an article, 1 the main part, 0 the body; -1 an article or main part among what
    stands beside the text by class names, -2 that, -3 what stands beside it by tags."""
    own, beside, header = KINDS[signature]
    if header and place < 1 and beside == BESIDE_NOT:
        beside = BESIDE_TAG if signature.startswith("header") else BESIDE_CLASS
    if place == -3 or beside == BESIDE_TAG:
        return -3
    if beside == BESIDE_CLASS or place == -2 and not own:
        return -2
    return -1 if place < 0 else max(place, own)


def read(page: str, ids: bool = False) -> tuple[list[list], list[tuple[str, int, str]], bool]:
    """A page's own wrapper, its blocks (text, place, tag), and whether it has an article or main part that is not beside the text.
    With ids, each slot holds the numbers of its blocks."""
    blocks: list[tuple[str, int, str]] = []
    mark = [crc32(page.encode("utf-8", "replace"))]
    root: list[list] = []
    stack: list[tuple[str, str, list]] = [("", "", root)]
    places = [0]
    text: list[str] = []
    links = at = inside = 0
    placed = False

    def flush() -> None:
        nonlocal links
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                stack[-1][2].append(["#", 0, 0, crc32(line.encode("utf-8", "replace")), mark, len(line), min(links, len(line)), [len(blocks)] if ids else None])
                blocks.append((line, places[-1], stack[-1][0]))
            links = 0

    def close() -> None:
        nonlocal inside
        flush()
        places.pop()
        name, signature, children = stack.pop()
        inside = 0
        if stack[-1][2] is not children:
            stack[-1][2].append([signature, 0, 0, fold(children)])

    while m := TOKEN.match(page, at):
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            elif not m[0].startswith(("<!", "<?")):
                part = unescape(m[0]) if "&" in m[0] else m[0]
                text.append(part)
                if inside:
                    links += len(part)
            continue
        name = name.lower()
        # inline elements that are hidden or stand beside the text are like blocks
        apart = name in INLINE and (any(name == s[0] for s in stack) or not m[1] and m[3] != "" and name in ASIDE and KINDS[SIGNATURES[name, m[3]]][1] != BESIDE_NOT)
        if name in INLINE and not apart:
            if name == "a":
                inside = 0 if m[1] else 1
        elif name in VOID:
            continue
        elif name == "br":
            text.append(" ")
        elif m[1]:
            if any(name == s[0] for s in stack):
                while True:
                    done = stack[-1][0] == name
                    close()
                    if done:
                        break
        elif name in RAW:
            if not (name == "svg" and m[3].endswith("/")):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        else:
            flush()
            while stack[-1][0] in CLOSES.get(name, ()):
                close()
            signature = SIGNATURES[name, m[3]]
            places.append(_below(places[-1], signature))
            placed = placed or places[-1] > 0
            # deeper elements are not told apart
            stack.append((name, signature, [] if len(stack) < DEEPEST else stack[-1][2]))
            if m[3].endswith("/") and name in ("div", "p"):
                close()
    while len(stack) > 1:
        close()
    flush()
    return fold(root), blocks, placed


# ---- wrappers
# Items are lists: ["#", optional, repeated, hash of the text or None if it varies, marks of pages that have it, characters, those
# in links, block numbers], [signature, optional, repeated, items], and ["+", optional, 1, items] for repeated groups.


def _key(x: list) -> str:
    return "+" + "\x1f".join(map(_key, x[3])) if x[0] == "+" else x[0]


def _join(x: list, y: list) -> list:
    """The item that stands for two of the same key."""
    if x[0] != "#":
        return [x[0], x[1] | y[1], x[2] | y[2], merge(x[3], y[3])]
    same = x[3] is not None and x[3] == y[3]
    marks = (x[4] if x[4] == y[4] else sorted({*x[4], *y[4]})[:FEW]) if same else None
    return ["#", x[1] | y[1], x[2] | y[2], x[3] if same else None, marks, x[5] + y[5], x[6] + y[6], x[7] + y[7] if x[7] is not None and y[7] is not None else None]


def _many(x: list) -> list:
    return [*x[:2], 1, *x[3:]]


def _runs(items: list[list]) -> list[list]:
    """items with neighbours of one key made one repeated item."""
    out: list[list] = []
    for x in items:
        if out and out[-1][0] == x[0] and (x[0] != "+" or _key(out[-1]) == _key(x)):
            last = out[-1]
            out[-1] = _many(_join(last, x))
            out[-1][1] = last[1] & x[1]
        else:
            out.append(x)
    return out


def fold(items: list[list]) -> list[list]:
    """items with runs made repeated items, and then groups that follow each other made one repeated group, of any width."""
    items = _runs(items)
    while len(items) > 3:
        keys = list(map(_key, items))
        where: dict[str, list[int]] = {}
        for k, key in enumerate(keys):
            where.setdefault(key, []).append(k)
        if len(where) == len(keys):
            break
        out, k, found = [], 0, False
        while k < len(items):
            for j in where[keys[k]]:
                w = j - k
                if w > 1 and j + w <= len(keys) and keys[k + 1] == keys[j + 1] and keys[k:j] == keys[j : j + w]:
                    n = 2
                    while keys[k + n * w : k + (n + 1) * w] == keys[k:j]:
                        n += 1
                    unit = items[k:j]
                    for i in range(1, n):
                        unit = [_join(x, y) for x, y in zip(unit, items[k + i * w : k + (i + 1) * w])]
                    out.append(["+", 0, 1, unit])
                    k, found = k + n * w, True
                    break
            else:
                out.append(items[k])
                k += 1
        if not found:
            break
        items = _runs(out)
    return items


def _regroup(items: list[list], groups: list[list]) -> list[list]:
    """items in which each sequence that one of the groups repeats is a group of one."""
    for g in groups:
        unit, out, k = [_key(x) for x in g[3]], [], 0
        keys = list(map(_key, items))
        n = len(unit)
        while k < len(items):
            if keys[k : k + n] == unit:
                out.append(["+", 0, 1, items[k : k + n]])
                k += n
            else:
                out.append(items[k])
                k += 1
        items = _runs(out)
    return items


def align(a: list[list], b: list[list]) -> list[tuple[list | None, list | None]]:
    """Pairs of items of two sequences, in order, by a longest common subsequence of their keys."""
    left, right = list(map(_key, a)), list(map(_key, b))
    if left == right:
        return list(zip(a, b))
    for side, other in ((0, 1), (1, 0)):
        keys = (left, right)
        groups = [x for x, k in zip((a, b)[side], keys[side]) if k[0] == "+" and k not in keys[other]]
        if groups:
            made = _regroup((a, b)[other], groups)
            a, b = (a, made) if other else (made, b)
            left, right = list(map(_key, a)), list(map(_key, b))
    low = 0
    while low < min(len(left), len(right)) and left[low] == right[low]:
        low += 1
    n, m = len(left), len(right)
    while n > low and m > low and left[n - 1] == right[m - 1]:
        n, m = n - 1, m - 1
    pairs: list[tuple[list | None, list | None]] = list(zip(a[:low], b[:low]))
    best = [[0] * (m - low + 1) for _ in range(n - low + 1)]
    for i in range(n - low - 1, -1, -1):
        for j in range(m - low - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[low + i] == right[low + j] else max(best[i + 1][j], best[i][j + 1])
    i = j = low
    while i < n or j < m:
        if i < n and j < m and left[i] == right[j]:
            pairs.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1 - low][j - low] >= best[i - low][j + 1 - low]:
            pairs.append((a[i], None))
            i += 1
        else:
            pairs.append((None, b[j]))
            j += 1
    return pairs + list(zip(a[n:], b[m:]))


def merge(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers."""
    out = []
    for x, y in align(a, b):
        if x is None or y is None:
            z = x if y is None else y
            out.append(z if z[1] else [z[0], 1, *z[2:]])
        else:
            out.append(_join(x, y))
    return _runs(out)


def count(items: list[list]) -> int:
    return sum(1 + (count(x[3]) if x[0] != "#" else 0) for x in items)


def _coarse(items: list[list], depth: int, deepest: int, widest: int) -> list[list]:
    """items with at most widest children each: siblings of one tag are one repeated optional item; elements below deepest
    become slots of what they hold."""
    items = [x if x[0] == "#" or depth < deepest else _slot(x) for x in items]
    if len(items) > widest:
        at: dict[str, list] = {}
        for x in (y for x in items for y in (x[3] if x[0] == "+" else [x])):
            x = x if x[0] == "#" else [x[0].partition(" ")[0], *x[1:]]
            at[x[0]] = _join(at[x[0]], x) if x[0] in at else x
        items = [[x[0], 1, 1, *x[3:]] for x in at.values()]
    if len(items) > widest:  # tags are made up
        made = _slot(items[0])
        for x in items[1:]:
            made = _join(made, _slot(x))
        items = [_many(made)]
    return _runs([x if x[0] == "#" else [*x[:3], _coarse(x[3], depth + 1, deepest, widest)] for x in items])


def _slot(x: list) -> list:
    """One slot for all texts of an item."""
    if x[0] == "#":
        return x
    out = ["#", x[1], 1, None, None, 0, 0, None]
    for y in x[3]:
        out = _join(out, _slot(y))
    return out


def bounded(items: list[list], most: int = MOST) -> list[list]:
    """items, made coarser step by step until there are at most about `most`."""
    deepest = DEEPEST + 1
    for widest in (256, 64, 16):
        if count(items) <= most:
            return items
        items = _coarse(items, 0, deepest, widest)
    while count(items) > most and deepest > 1:
        deepest = deepest * 2 // 3
        items = _coarse(items, 0, deepest, 16)
    return items


def merged(wrappers: Iterable[str]) -> str:
    out: list[list] | None = None
    for w in wrappers:
        out = json.loads(w) if out is None else bounded(merge(out, json.loads(w)))
    return json.dumps(out or [], ensure_ascii=False, separators=(",", ":"))


# ---- what the slots hold


def judge(wrapper: list[list]) -> list[list]:
    """The wrapper with a verdict as the last field of each slot: 'same' if different pages have the same text in it, 'template' if that
    is no part of their text, 'notice' if it is none inside an article unless most of that is such, 'links' for a repeated slot of
    links, or None."""
    slots: list[tuple[list, int, str]] = []
    missing: set[int] = set()  # slots that not every article has

    def walk(items: list[list], place: int, name: str, some: int) -> None:
        for x in items:
            if x[0] == "#":
                slots.append((x, place, name))
                if some or x[1] or x[2]:
                    missing.add(id(x))
            elif x[0] == "+":
                walk(x[3], place, name, 1)
            else:
                below = _below(place, x[0])
                # a page without an article has none of its texts either
                walk(x[3], below, x[0].partition(" ")[0], 0 if below > max(place, 0) else some | x[1] | x[2])

    walk(wrapper, 0, "", 0)
    # whether other texts vary: in the body, and besides headings in articles and main parts
    varies = {p: any(x[3] is None and (place > 0) == p and place >= 0 and not (p and name in HEADING) for x, place, name in slots) for p in (False, True)}
    for x, place, name in slots:
        pages = len(x[4]) if x[3] is not None else 0
        x[7] = "same" if pages >= FEW else None
        if place >= 1:
            if pages >= FEW and name not in HEADING and id(x) not in missing and varies[True]:
                x[7] = "notice"
        elif pages >= FEW and varies[False]:
            x[7] = "template"
        elif x[2] and x[6] >= 0.9 * x[5] > 0 and place == 0:
            x[7] = "links"
    return wrapper


def verdicts(own: list[list], wrapper: list[list]) -> dict[int, str]:
    """The verdicts of the slots that a page's blocks are aligned with, by block number."""
    out: dict[int, str] = {}
    todo = [(own, wrapper)]
    while todo:
        for x, y in align(*todo.pop()):
            if x is None or y is None:
                continue
            if x[0] != "#":
                todo.append((x[3], y[3]))
            elif y[7] is not None:
                out |= dict.fromkeys(x[7] or (), y[7])
    return out


def extract(page: str | None, wrapper: list[list]) -> str:
    """A page's text, given the judged wrapper of its host (or an empty one)."""
    own, blocks, own_place = read(page or "", ids=True)
    if not blocks:
        return ""
    top = max(p for _, p, _ in blocks)
    if top < (0 if own_place else -1):
        return ""
    said = verdicts(own, wrapper) if wrapper else {}
    notices = [k for k, (_, p, _) in enumerate(blocks) if p == top and said.get(k) == "notice"]
    if 2 * sum(len(blocks[k][0]) for k in notices) >= sum(len(x) for x, p, _ in blocks if p == top):
        notices = []
    kept = {k for k, (_, p, _) in enumerate(blocks) if p == top and said.get(k) not in ("template", "links")}.difference(notices)
    if not kept:
        kept = {k for k, (_, p, _) in enumerate(blocks) if p == top}
    if top > 0 and not any(blocks[k][2] == "h1" for k in kept):
        kept |= {k for k, (_, p, name) in enumerate(blocks) if 0 <= p < top and name == "h1" and k not in said}
    return " ".join(blocks[k][0] for k in sorted(kept))


# ---- tables


def partial(batches: Iterator[pd.DataFrame], most_hosts: int = 500) -> Iterator[pd.DataFrame]:
    """One wrapper a host for the pages of a task, or several if it has pages of many hosts."""
    at: dict[str, list] = {}

    def out() -> pd.DataFrame:
        made = pd.DataFrame({"host": list(at), "wrapper": [json.dumps(w, ensure_ascii=False, separators=(",", ":")) for w in at.values()]}, dtype=object)
        at.clear()
        return made

    for batch in batches:
        for host_, page in zip(batch["host"], batch["html"]):
            own = read(page or "")[0]
            at[host_] = bounded(merge(at[host_], own)) if host_ in at else bounded(own)
            if len(at) >= most_hosts:
                yield out()
    if at:
        yield out()


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", group: int = 32) -> DataFrame:
    """(host, wrapper). Each task merges the pages that it reads; these partial wrappers, whose size is bounded, are merged in
    groups of about `group`, again and again, so no task holds a host's pages."""

    @F.pandas_udf("string")
    def merge_all(lists: pd.Series) -> pd.Series:
        return pd.Series([merged(sorted(x)) for x in lists], dtype=object)

    rows = cut(pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInPandas(partial, "host string, wrapper string").distinct())
    while True:
        sizes = cut(rows.groupBy("host").agg(F.ceil(F.count("*") / group).alias("parts"), F.count("*").alias("n")))
        most = sizes.agg(F.max("n")).first()[0] or 1
        if most == 1:
            return rows
        dealt = rows.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("parts")))
        rows = cut(dealt.groupBy("host", "part").agg(F.collect_list("wrapper").alias("w")).select("host", merge_all("w").alias("wrapper")).distinct())


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (code points). Pages are read twice; only partial wrappers are shuffled, and the
    wrappers, one row a host, are joined by what Catalyst knows of their size."""
    known = cut(wrappers(pages, url_col, html_col).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper")))

    @F.pandas_udf("string")
    def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        judged = _Cache(lambda w: judge(json.loads(w or "[]")), 1000)
        for pages_, wrappers_ in batches:
            yield pd.Series([extract(p, judged[w]) for p, w in zip(pages_, wrappers_)], dtype=object)

    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.join(known, host(F.col(url_col)) == known["__host"], "left")
    return rows.select(*rest, texts(F.col(html_col), F.col("__wrapper")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
