"""Main text of HTML pages by tree scoring.

A tolerant scan builds a small tree of block containers. Every paragraph
gives points for its length and its commas to its parent, half of them to the
grandparent and less further up; a container's points are discounted by the
share of its text that stands in links and shifted by what its tag, class and
id say. The best container and those of its siblings that score well enough,
or hold a running paragraph, are the article. Boilerplate inside it (menus,
asides, adverts, forms, comments of readers) is left out while the tree is
walked.

Defined results: null and empty html give an empty text, as do pages without
any text outside boilerplate. Unclosed and misnested tags are closed where
HTML closes them; markup that is cut off at the end ends there. A page's depth
is bounded by a stack, not by recursion, and open elements are counted by name,
so the work grows with the page's length and not with its depth. Every row of
the table gives a row, also repeated ones; an empty table gives none. The other
columns of the input stay as they are, but for ``text`` and ``n_chars``, which
the result's own columns replace.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# a comment, which ">" or "->" ends at once, a tag, or another declaration; only
# after an equals sign does a quote open a value, and ">" then doesn't end the tag
_TOKEN = re.compile(
    r"<!--(?:-?>|(.*?)(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WHITE = re.compile(r"[\s ]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_SKIP = frozenset(
    "script style head title noscript iframe noembed noframes xmp template nav aside form button select option textarea input label fieldset legend "
    "svg canvas audio video object embed applet map dialog menu datalist output progress meter".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul summary".split()
)
_SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"thead", "tbody"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}

# Words that class and id names of page furniture are made of. A name says what
# an element is only if all its parts are such words: "related-links" does, but
# "related-work" and "legal-history" are what somebody wrote about.
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted outbrain taboola comment comments commentlist disqus "
    "respond replies reply discussion sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot masthead header topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommend recommended "
    "recommendations readmore trending popular tags tag taglist meta byline legal disclaimer copyright skip hidden search searchbox form rating ratings feedback shoutbox poll".split()
)
_SURE = frozenset(
    "comment comments commentlist disqus respond replies sidebar newsletter cookie cookies consent gdpr advert adverts advertisement advertising adsense sponsor sponsored sponsors promo share sharing "
    "social related recommended recommendations breadcrumb breadcrumbs navbar menu popup modal subscribe outbrain taboola".split()
)
_READERS = frozenset("comment comments commentlist disqus respond replies".split())
_GOOD = frozenset("article articles body content entry main maincontent page post posts text blog story storybody hentry prose".split())
_PLAIN = frozenset(
    "list item items box boxes block blocks wrapper wrap container inner outer area areas section sections panel panels bar bars top bottom left right center middle title titles heading link links "
    "icon icons button buttons btn group row rows col cols column columns grid card cards module component unit units slot zone region primary secondary global local site pages field fields "
    "count counter author avatar thread threads toggle open close closed fixed sticky floating mobile desktop small large medium full wide narrow has with no is js layout both none wp image images "
    "img logo network networks media buttonset more read stories news latest recent view bottombar feed reader readers user users form forms policy settings message messages skyscraper leaderboard".split()
)
_SIDES = frozenset("left right both none no".split())
_TOPICS = frozenset("category categories cat tag tagged topic".split())
_LAYOUT = frozenset("has with no is js layout".split())
_PARTS = re.compile(r"[^-_:./]+")
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog status tooltip".split())


class _Node:
    __slots__ = ("children", "links", "name", "parent", "score", "weight", "size", "skip", "own", "doubt", "id")

    def __init__(self, name: str, parent: "_Node | None", skip: bool, weight: float):
        self.name, self.parent, self.skip, self.weight = name, parent, skip, weight
        self.children: list = []  # nodes, and texts as (text, in a link)
        self.score, self.links, self.size, self.own, self.doubt, self.id = 0.0, 0, 0, 0, False, ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "" for m in _ATTR.finditer(raw)}


def _layout(parts: list[str]) -> bool:
    """Names that say on which side of the page something stands."""
    aside = [x for x in parts if x.startswith(("sidebar", "menu", "navbar"))]
    return bool(aside) and len(parts) > 1 and (parts[-1] in _SIDES or parts[0] in _SIDES and parts[-1] == "sidebar")


def _names(words: list[str]) -> list[list[str]]:
    """The parts of the names that say what an element is. Names of a topic
    don't, nor do those of the layout, if there are others."""
    every = [_PARTS.findall(x.lower()) for x in words]
    out = [x for x in every if x and not (len(x) > 1 and (x[0] in _TOPICS or x[0] == "post" and x[1] in _TOPICS and len(x) > 2))]
    return [x for x in out if not _layout(x)] or out


def _kind(name: str, raw: str, inside: bool) -> tuple[bool, float, bool, str]:
    """Whether an element is boilerplate, the weight of its names, whether it
    is boilerplate by a name that others of its names speak against or that
    may be its heading's, and its id."""
    weight = {"article": 25.0, "main": 25.0, "section": 3.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "div": 5.0, "body": 0.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0, "th": -5.0}.get(name, 0.0)
    doubt, own_id = False, ""
    skip = name in _SKIP or (name in ("header", "footer") and not inside)
    if raw and not raw.isspace():
        a = _attributes(raw)
        if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _BAD_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
            skip = True
        own_id = a.get("id", "")
        # a heading's id is made from its words
        names = _names(f"{a.get('class', '')} {'' if name in _HEADINGS else own_id}".split())
        if names and name not in ("html", "body", "main"):
            good = any(not _GOOD.isdisjoint(x) for x in names)
            said = [x for x in names if all(y in _BAD or y in _GOOD or y in _PLAIN or y.isdigit() for y in x)]
            sure = [x for x in said if not _SURE.isdisjoint(x) and not (len(x) > 1 and (x[0] in _LAYOUT or x[-1] in ("layout", "page")))]
            by_name = any(x[0] in _READERS if name == "article" else not _READERS.isdisjoint(x) for x in sure) or name != "article" and bool(sure) and not good
            if name != "article":
                bad = any(not _BAD.isdisjoint(x) for x in said)
                weight += 25 * good - 25 * bad
                by_name |= bad and not good
                doubt = bool(sure)
            if name == "section" and by_name and own_id and not any(not _BAD.isdisjoint(x) for x in _names(a.get("class", "").split())):
                by_name, doubt = False, True
            skip |= by_name
            doubt &= not skip
    return skip, weight, doubt, own_id


def _tree(page: str) -> _Node:
    """The tree of block elements; inline markup leaves only its text."""
    root = _Node("", None, False, 0.0)
    at, links, depth_of_skip = root, 0, None
    stack: list[str] = []
    nodes: list[_Node] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # open elements of a name
    blocks: list[int] = []  # open elements that aren't inline
    pos, n = 0, len(page)

    def text(s: str) -> None:
        if s and not at.skip:
            at.children.append((s, links > 0))

    def close(k: int) -> None:
        nonlocal at, links
        for name in stack[k:]:
            links -= name == "a"
            if name:
                places[name].pop()
        while blocks and blocks[-1] >= k:
            blocks.pop()
        for node in reversed(nodes[k:]):
            if node is not None:
                at = node.parent
        del stack[k:], nodes[k:]

    for m in _TOKEN.finditer(page):
        if m.start() < pos:
            continue
        if m.start() > pos:
            text(page[pos : m.start()])
        pos = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            if name == "br":
                text(" ")
            elif name == "p" and not places["p"]:
                at.children.append(_Node("p", at, at.skip, 0.0))
            elif places[name]:
                k = places[name][-1]
                # an inline end tag doesn't close blocks that were opened inside it
                if name in _INLINE and blocks and blocks[-1] > k:
                    links -= name == "a"
                    places[name].pop()
                    stack[k] = ""  # closed, but its place stays
                else:
                    close(k)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if name in _P_ENDS and places["p"]:
            close(places["p"][-1])
        if name in _SAME_ENDS:
            # the innermost element that this one ends, unless its list or table was opened since
            scope = max((places[x][-1] for x in _SCOPE.get(name, ()) if places[x]), default=-1)
            ends = [places[x][-1] for x in _SAME_ENDS[name] if places[x] and places[x][-1] > scope]
            if ends:
                close(max(ends))
        if name in ("br", "hr"):
            text(" ") if name == "br" else at.children.append(_Node("hr", at, True, 0.0))
            continue
        if name in _VOID or m[4].endswith("/") and name not in _INLINE and name in ("svg", "path"):
            continue
        if name in _INLINE:
            skip = False
            if m[4] and not m[4].isspace():
                hard, _, doubt, _ = _kind(name, m[4], True)
                skip = (hard or doubt) and name == "span"
            if skip:
                node = _Node(name, at, True, 0.0)
                at.children.append(node)
                at = node
                nodes.append(node)
            else:
                nodes.append(None)
            places[name].append(len(stack))
            stack.append(name)
            links += name == "a"
            continue
        skip, weight, doubt, own_id = _kind(name, m[4], name == "header" and bool(places["article"] or places["main"]))
        node = _Node(name, at, skip or at.skip, weight)
        node.doubt, node.id = doubt and not node.skip, own_id
        at.children.append(node)
        at = node
        places[name].append(len(stack))
        blocks.append(len(stack))
        stack.append(name)
        nodes.append(node)
    if pos < n:
        text(page[pos:])
    return root


def _squeeze(parts: list[str]) -> str:
    return _WHITE.sub(" ", _html.unescape("".join(parts))).strip()


def _blocks(top: _Node, out: list[str], begin: list[str] | None = None) -> None:
    """Texts of the blocks below ``top`` in page order."""
    run: list[str] = []
    work: list = [iter(top.children)]
    while work:
        for child in work[-1]:
            if isinstance(child, tuple):
                run.append(child[0])
                continue
            if run:
                if s := _squeeze(run):
                    out.append(s)
                run = []
            if not child.skip:
                work.append(iter(child.children))
                break
        else:
            work.pop()
            if run:
                if s := _squeeze(run):
                    out.append(s)
                run = []


def _named_by_heading(node: _Node) -> bool:
    """Whether an element's id is made from the words of its first heading,
    and most of its text isn't links."""
    work, words, found, size, linked = [node], "", False, 0, 0
    while work:
        x = work.pop()
        for c in x.children:
            if isinstance(c, tuple):
                size += len(c[0])
                linked += len(c[0]) * c[1]
        if x.name in _HEADINGS and not found:
            words, found = _squeeze([c[0] for c in x.children if isinstance(c, tuple)]), True
        work += [c for c in reversed(x.children) if not isinstance(c, tuple) and not c.skip]
    slug = lambda t: re.findall(r"\w+", t.lower().replace("_", " "))
    return found and bool(slug(words)) and slug(words) == slug(node.id) and 2 * linked <= size and _READERS.isdisjoint(slug(node.id)[:1])


def _settle(root: _Node) -> None:
    """An element in doubt stays if it holds most of the page's text outside
    of links, or if it is a section that has its heading's name; the others
    are boilerplate."""
    order, work, in_doubt = [], [root], False
    while work:
        node = work.pop()
        order.append(node)
        in_doubt |= node.doubt
        work += [c for c in node.children if not isinstance(c, tuple) and not c.skip]
    if not in_doubt:
        return
    held: dict[int, int] = {}
    for node in reversed(order):
        mine = sum(len(_WHITE.sub(" ", c[0]).strip()) for c in node.children if isinstance(c, tuple) and not c[1])
        held[id(node)] = mine + sum(held[id(c)] for c in node.children if not isinstance(c, tuple) and not c.skip)
    for node in order:
        node.skip |= node.doubt and 2 * held[id(node)] <= held[id(root)] and not (node.name == "section" and _named_by_heading(node))


def _measure(root: _Node) -> list[_Node]:
    """Sizes and points of all containers, from the leaves up."""
    order, work = [], [root]
    while work:
        node = work.pop()
        order.append(node)
        work += [c for c in node.children if not isinstance(c, tuple) and not c.skip]
    for node in reversed(order):
        own = "".join(c[0] for c in node.children if isinstance(c, tuple))
        linked = sum(len(c[0]) for c in node.children if isinstance(c, tuple) and c[1])
        own_text = _WHITE.sub(" ", own).strip()
        node.size += len(own_text)
        node.links += min(linked, len(own_text))
        node.own = len(own_text)
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
        if len(own_text) >= 25:
            points = 1 + own_text.count(",") + own_text.count("，") + own_text.count("、") + min(len(own_text) // 100, 3)
            points *= 1 - linked / max(len(own), 1)
            is_block = node.name in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd", "dt", "blockquote", "figcaption")
            up, level = (node.parent if is_block and node.parent is not None else node), 0
            while up is not None and level < 5:
                up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1
    return order


def extract_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not page:
        return ""
    root = _tree(page)
    _settle(root)
    order = _measure(root)
    density = lambda x: x.links / x.size if x.size else 0.0
    value = {id(x): (x.score + (x.weight if x.score else 0)) * (1 - density(x)) for x in order}
    named = [x for x in order if x.name in ("article", "main") and x.size and density(x) < 0.5]
    scored = [x for x in order if x.score > 0]
    if not scored and not named:
        out: list[str] = []
        _blocks(root, out)
        return "\n\n".join(out)
    best = max(scored or named, key=lambda x: (value[id(x)], x.size))
    while best.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "tr", "tbody", "thead", "ul", "ol", "dl", "dd", "dt", "") and best.parent is not None and best.name != "":
        best = best.parent
    # a parent whose only other text is the best one's own is the better
    # container, and so is the article that the best one is a part of
    while best.parent is not None and best.parent.name not in ("", "html", "body") and value[id(best.parent)] > 0.75 * value[id(best)]:
        best = best.parent
    up = best
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    if up is not None and density(up) < 0.5:
        best = up
    out = []
    if best.parent is None:
        siblings = [best]
    else:
        least = max(10.0, 0.2 * value[id(best)])
        siblings = []
        for c in best.parent.children:
            if isinstance(c, tuple) or c.skip:
                continue
            running = c.name in ("p", "pre", "blockquote") and c.size and (c.size > 80 and density(c) < 0.25 or c.size <= 80 and not c.links)
            title = c.name in ("h1", "h2", "h3") and c.size and not c.links
            if c is best or value.get(id(c), 0) >= least or running or title:
                siblings.append(c)
    for c in siblings:
        _blocks(c, out)
    return "\n\n".join(out)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` without the html, with ``text`` and
    ``n_chars`` (its code points)."""
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                text = [extract_text(x.as_py()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], [*rest, "text", "n_chars"])

    schema = pages.select(*rest).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*rest, html).mapInArrow(work, schema)
