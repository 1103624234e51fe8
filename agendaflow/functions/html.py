"""A small element tree over markup, selector paths, and Spark functions on them.

A path has segments joined by ``>``; a segment is ``tag.class.class`` with ``:eq(n)`` or
``:not([class])``; the empty path is the block itself. If every segment ends with ``)`` segments may
be any number of levels apart, else each is a child of the one before.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import text

#: Elements without an end tag, and those that end others by beginning (fixed values of the markup standard).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dd dt".split()
)
#: A tag that begins: the open elements that it ends, and the elements beyond which it ends nothing.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_CELLS, _TABLE = {"td", "th", "caption"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
_SEGMENT = re.compile(r"^([\w*-]*)((?:\.[^.:>\s]+)*)((?::(?:eq\(\d+\)|not\(\[class\]\)))*)$")


class Node:
    """An element. ``texts`` has its strings and elements in order; all text of a page is one list of
    ``pieces``, of which an element has those from ``begin`` to ``end``."""

    __slots__ = ("tag", "attrs", "parent", "depth", "children", "texts", "pieces", "begin", "end", "numbers")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = 0 if parent is None else parent.depth + 1
        self.children: list[Node] = []
        self.texts: list[str | Node] = []
        self.pieces: list[str] = [] if parent is None else parent.pieces
        self.begin = self.end = len(self.pieces)
        self.numbers: dict[int, tuple[int, int]] | None = None

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator["Node"]:
        """The elements inside, in document order."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.children[::-1]

    def text(self) -> str:
        """All text inside, nested ones set apart by blanks."""
        return " ".join(" ".join(self.pieces[self.begin : self.end]).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.open = [self.root]

    def _close(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        for n in self.open[k:]:
            n.end = len(self.root.pieces)
        del self.open[k:]

    def _end_implied(self, ended: set[str], stop: set[str]) -> None:
        at = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in stop:
                break
            if self.open[k].tag in ended:
                at = k
        if at is not None:
            self._close(at)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._end_implied({"p"}, {"table", "td", "th", "button"})
        if tag in IMPLIED:
            self._end_implied(*IMPLIED[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        self.open[-1].texts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        # closes the nearest open element of that name in its cell; a stray end is ignored
        stop = {"table"} - {tag} if tag in _TABLE else _CELLS | {"table"}
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._close(k)
                break
            if self.open[k].tag in stop:
                break

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].texts.append(data)
            self.root.pieces.append(data)


def parse(html: str | None) -> Node:
    """The root of a page's elements. Elements whose end tag may be left out end as the markup standard
    says; none is added that is not written (html, body, tbody)."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    b._close(0)
    return b.root


def _matches(node: Node, segment: str) -> bool:
    m = _SEGMENT.match(segment.strip())
    if not m:
        return False
    own = set(node.classes)
    return m[1].lower() in ("", "*", node.tag) and own.issuperset(m[2].split(".")[1:]) and not (":not([class])" in m[3] and own)


def _anywhere(path: str) -> bool:
    """Whether a path's segments may be any number of levels apart."""
    return all(s.strip().endswith(")") for s in path.split(">"))


def select(root: Node, path: str, anywhere: bool | None = None) -> list[Node]:
    """The elements that a path reaches, in document order."""
    if not path:
        return [root]
    segments = path.split(">")
    anywhere = _anywhere(path) if anywhere is None else anywhere
    found = [root]
    for s in segments:
        step: list[Node] = []
        for n in found:
            hits = [c for c in (n.walk() if anywhere else n.children) if _matches(c, s)]
            at = re.search(r":eq\((\d+)\)", s)
            step += hits[int(at[1]) : int(at[1]) + 1] if at else hits
        found = list(dict.fromkeys(step))
    return found


def nearest_href(node: Node) -> str | None:
    """The address of the element or of its nearest ancestor that has one."""
    while node is not None:
        if node.attrs.get("href"):
            return node.attrs["href"]
        node = node.parent
    return None


def extract_field(root: Node, key: str, paths: list[str]) -> str:
    """The text of a recipe key: an address for ``URL`` (first path only), names joined by commas,
    other texts by blanks."""
    if "URL" in key:
        hits = select(root, paths[0]) if paths else []
        return next((h for n in hits if (h := nearest_href(n) or next((c.attrs["href"] for c in n.walk() if c.attrs.get("href")), None))), "")
    texts = [t for p in paths for n in select(root, p) if (t := n.text())]
    return (", " if "Name" in key else " ").join(texts)


def wants_alternate(fields: dict[str, str], key: str) -> bool:
    """Alternate paths are read for every date and for fields that are missing or blank."""
    return "Date" in key or not (fields.get(key) or "").strip()


def _main(recipe: dict[str, list[str]]) -> dict[str, list[str]]:
    return {k: v for k, v in recipe.items() if "Multi" not in k}


def fields_of(root: Node, recipe: dict[str, list[str]], alternates: dict[str, list[str]] | None = None, before: dict[str, str] | None = None, linked: bool = False) -> dict[str, str]:
    """The fields of a block or page. Place and URL, and on a linked page every field, overwrite what is
    there ``before`` where they are not blank; other fields are appended to it. Alternate paths fill in
    what ``wants_alternate``, dates as altEventDate."""
    out = dict(before or {})
    for key, paths in _main(recipe).items():
        text = extract_field(root, key, paths)
        if linked or key in ("eventPlace", "eventURL"):
            out |= {key: text} if text else {}
        else:
            out[key] = (out.get(key) or "") + text
    for key, paths in _main(alternates or {}).items():
        if wants_alternate(out, key) and (text := extract_field(root, key, paths)):
            out["altEventDate" if "Date" in key else key] = text
    return out


def common_prefix(paths: list[str]) -> str:
    """The longest common run of leading segments."""
    out = []
    for same in zip(*(p.split(">") for p in paths)):
        if len(set(same)) > 1:
            break
        out.append(same[0])
    return ">".join(out)


def sub_events_of(root: Node, recipe: dict[str, list[str]], alternates: dict[str, list[str]] | None = None) -> list[dict[str, str]]:
    """The fields of each sub-event: the elements at the common prefix of all ``Multi`` paths, each read by
    the rest of the paths."""
    multi = {k: v for k, v in recipe.items() if "Multi" in k and v}
    other = {k: v for k, v in (alternates or {}).items() if "Multi" in k and v}
    paths = [p for v in (*multi.values(), *other.values()) for p in v]
    if not paths:
        return []
    top, out = common_prefix(paths), []
    inside = lambda v: [p[len(top) :].lstrip(">") for p in v]
    for n in select(root, top):
        own = {k.replace("Multi", ""): extract_field(n, k, inside(v)) for k, v in multi.items()}
        for k, v in other.items():
            key = k.replace("Multi", "")
            if wants_alternate(own, key):
                own["altEventDate" if "Date" in key else key] = extract_field(n, k, inside(v))
        out.append(own)
    return out


def links_of(root: Node, delimiter: str, recipe: dict[str, list[str]]) -> list[str]:
    """The addresses that a page's blocks lead to: those at the recipe's URL paths, inside sub-events too,
    and of a recipe without any those of the blocks themselves."""
    blocks, out = _descend(root, delimiter), []
    one, multi = recipe.get("eventURL") or [], recipe.get("eventMultiURL") or []
    if not one and not multi:
        return [h for n in blocks if (h := n.attrs.get("href"))]
    if one:
        out += [h for n in blocks for h in [extract_field(n, "eventURL", one)] if h]
    if multi:
        segments = multi[0].split(">")
        top, rest = (">".join(x for x in segments if x.endswith(")") == last) for last in (False, True))
        out += [h for n in blocks for sub in select(n, top) for a in select(sub, rest) if (h := nearest_href(a))]
    return out


def _own(node: Node) -> str:
    return node.tag + "".join("." + c for c in node.classes)


def _numbers(parent: Node) -> dict[int, tuple[int, int]]:
    """For each child its number among the children that its own segment matches, and how many those are:
    of its tag, with all its classes. Counted once for a parent, by the kinds of its children."""
    if parent.numbers is None:
        kinds: dict[tuple[str, frozenset], list[int]] = {}
        for k, c in enumerate(parent.children):
            kinds.setdefault((c.tag, frozenset(c.classes)), []).append(k)
        like = {kind: [own for (tag, classes), own in kinds.items() if tag == kind[0] and classes >= kind[1]] for kind in kinds}
        parent.numbers = {}
        for k, c in enumerate(parent.children):
            places = like[c.tag, frozenset(c.classes)]
            parent.numbers[id(c)] = sum(bisect.bisect_left(own, k) for own in places), sum(map(len, places))
    return parent.numbers


def absolute_path(node: Node, top: Node | None = None) -> str:
    """The path of an element from the root, or from ``top``, with its number among like siblings."""
    parts = []
    while node.parent is not None and node is not top:
        number, alike = _numbers(node.parent)[id(node)]
        parts.append(_own(node) + (f":eq({number})" if alike > 1 else ""))
        node = node.parent
    return ">".join(reversed(parts))


def smallest_holding(root: Node, strings: list[str]) -> Node | None:
    """The last deepest element whose text holds all strings."""
    best, low = None, [s.lower() for s in strings]
    for n in root.walk():
        if best is not None and n.depth < best.depth:
            continue
        inside = n.text().lower()
        if all(s in inside for s in low):
            best = n
    return best


def with_link(node: Node) -> Node:
    """The element, or its nearest ancestor with an address; itself where there is none."""
    n = node
    while n is not None and not n.attrs.get("href"):
        n = n.parent
    return n or node


def chain_end(root: Node, string: str) -> Node | None:
    """From the first element that holds the string down to the last one of the chain in which each holds
    the next."""
    found = [n for n in root.walk() if string in n.text()]
    k = 0
    while k + 1 < len(found) and found[k + 1].parent is found[k]:
        k += 1
    return found[k] if found else None


def shorten(root: Node, path: str) -> str:
    """The shortest end of a path that reaches the same text and has a class that the rest lacks."""
    classes = lambda segments: {c for s in segments for c in s.split(":")[0].split(".")[1:]}
    segments, text = path.split(">"), " ".join(n.text() for n in select(root, path))
    for k in range(len(segments) - 1, 0, -1):
        short = ">".join(segments[k:])
        if classes(segments[k:]) - classes(segments[:k]) and " ".join(n.text() for n in _descend(root, short)) == text:
            return short
    return path


def is_ancestor(a: Node, b: Node) -> bool:
    while b is not None and b is not a:
        b = b.parent
    return b is a


def common_ancestor(nodes: list[Node]) -> Node | None:
    """The deepest element that holds all of them (or is one of them)."""
    top = nodes[0] if nodes else None
    while top is not None and not all(is_ancestor(top, n) for n in nodes):
        top = top.parent
    return top


#: Elements that only set off text inside a line (fixed values).
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"}


def leaf_texts(root: Node) -> list[Node]:
    """The lowest elements with text, one for text that only inline elements divide; an element that has
    text of its own beside others stays as well."""
    out: list[Node] = []
    covered: set[int] = set()
    for n in [root, *root.walk()]:
        if id(n.parent) in covered:
            covered.add(id(n))
        elif n.text():
            if all(c.tag in INLINE or c.tag in VOID for c in n.walk()):
                out.append(n)
                covered.add(id(n))
            elif any(isinstance(t, str) and t.strip() for t in n.texts) and n.parent is not None:
                out.append(n)
    return out


def regroup_paths(paths: list[str]) -> list[str]:
    """Paths that differ in one ``:eq`` become one without it."""
    out = list(dict.fromkeys(paths))
    for a in paths:
        for b in paths:
            x, y = a.split(">"), b.split(">")
            differ = [k for k in range(len(x)) if x[k] != y[k]] if len(x) == len(y) else []
            strip = lambda s: re.sub(r":eq\(\d+\)", "", s)
            if len(differ) == 1 and strip(x[differ[0]]) == strip(y[differ[0]]):
                merged = ">".join([*x[: differ[0]], strip(x[differ[0]]), *x[differ[0] + 1 :]])
                out = [p for p in out if p not in (a, b)]
                if merged not in out:
                    out.append(merged)
    return out


def count_events(root: Node, delimiter: str, recipe: dict[str, list[str]]) -> int:
    """The distinct valid events (name and date, as far as the recipe has them) of a delimiter's blocks."""
    keys = [k for k in ("eventName", "eventDate") if recipe.get(k)]
    found = {tuple(extract_field(n, k, recipe[k]) for k in keys) for n in _descend(root, delimiter)}
    return sum(all(x) for x in found)


def loosen(root: Node, delimiter: str, recipe: dict[str, list[str]]) -> tuple[str, int]:
    """The delimiter without the classes that hide events, and how many it finds. Segment by segment the
    class goes without which most events are found, for as long as that finds more."""
    most = count_events(root, delimiter, recipe)
    while True:
        segments = delimiter.split(">")
        for k, segment in enumerate(segments):
            tag, *classes = segment.split(".")
            if len(classes) < 2:
                continue
            tries = [">".join([*segments[:k], ".".join([tag, *classes[:j], *classes[j + 1 :]]), *segments[k + 1 :]]) for j in range(len(classes))]
            found = [count_events(root, t, recipe) for t in tries]
            if max(found) > most:
                most, delimiter = max(found), tries[found.index(max(found))]
                break
        else:
            return delimiter, most


def date_strings(root: Node, delimiter: str, recipe: dict[str, list[str]]) -> list[str]:
    """The date texts of each block and of its sub-events, from which a date format is inferred."""
    out = []
    for n in _descend(root, delimiter):
        out += [t for k in ("eventDate",) if recipe.get(k) and (t := extract_field(n, k, recipe[k]))]
        out += [t for sub in sub_events_of(n, recipe) if (t := sub.get("eventDate"))]
    return out


def induce_paths(html: str, samples: dict[str, list[str]]) -> tuple[str, dict[str, list[str]]]:
    """A recipe from sample strings of one event: the block's path, and for each key the paths of the
    elements that hold its strings, inside the block; of ``Multi`` keys without their numbers."""
    root = parse(html)
    block = smallest_holding(root, [s for v in samples.values() for s in v])
    if block is None:
        return "", {}
    out = {}
    for key, strings in samples.items():
        hits = [smallest_holding(block, [s]) or block for s in strings]
        paths = regroup_paths([absolute_path(n, block) for n in hits])
        out[key] = list(dict.fromkeys(re.sub(r":eq\(\d+\)", "", p) for p in paths)) if "Multi" in key else paths
    return absolute_path(block), out


def analyse(html: str, samples: dict[str, list[str]], links: bool = True) -> dict:
    """A whole recipe from sample strings of one event: delimiter, mainPage, events (how many distinct ones
    it finds) and dates (their texts).

    The block is the smallest element with all strings, or its ancestor that holds a link; without its
    numbers, and without classes that hide events, its path is the delimiter. ``noUrl`` samples pass
    ``links`` as False.
    """
    root = parse(html)
    block = smallest_holding(root, [s for v in samples.values() for s in v])
    if block is None:
        return {"delimiter": None, "mainPage": {}, "events": 0, "dates": []}
    if links and not any(n.attrs.get("href") for n in [block, *block.walk()]):
        block = with_link(block)
    recipe = {}
    for key, strings in samples.items():
        hits = [chain_end(block, s) or smallest_holding(block, [s]) or block for s in strings if s]
        paths = regroup_paths([absolute_path(n, block) for n in hits])
        recipe[key] = list(dict.fromkeys(re.sub(r":eq\(\d+\)", "", p) for p in paths)) if "Multi" in key else paths
    segments = [re.sub(r":eq\(\d+\)", "", s) for s in absolute_path(block).split(">")]
    delimiter, events = loosen(root, ">".join(segments), recipe)
    short = shorten(root, delimiter)
    if count_events(root, short, recipe) == events:
        delimiter = short
    return {"delimiter": delimiter, "mainPage": recipe, "events": events, "dates": date_strings(root, delimiter, recipe)}


def revise(html: str, delimiter: str, recipe: dict[str, list[str]], marked: dict[str, list[str]]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """A recipe and its alternates after elements were marked (key to strings of one block that should be
    read): paths are induced in the block that holds the strings; what reaches nothing in other
    blocks stays in the recipe, and the new path becomes an alternate."""
    root = parse(html)
    blocks, main, other = _descend(root, delimiter), {k: list(v) for k, v in recipe.items()}, {}
    for key, strings in marked.items():
        block = next((n for n in blocks if all(s in n.text() for s in strings)), None)
        if block is None:
            continue
        new = regroup_paths([absolute_path(chain_end(block, s) or block, block) for s in strings])
        kept = [p for p in main.get(key, []) if not select(block, p) and any(select(n, p) for n in blocks)]
        if kept:
            other[key] = [p for p in new if p not in kept]
        else:
            main[key] = new
    return main, other


NODE_SCHEMA = "node_id int, parent_id int, last_id int, depth int, tag string, classes array<string>, href string, sib_index int, text string"


@udtf(returnType=NODE_SCHEMA)
class HtmlNodes:
    """A row for each element of a page; those inside it have the numbers after its own up to last_id."""

    def eval(self, html: str):
        root = parse(html)
        nodes = list(root.walk())
        number = {id(n): k for k, n in enumerate(nodes)} | {id(root): -1}
        last = list(range(len(nodes)))
        for k in range(len(nodes) - 1, -1, -1):
            up = number[id(nodes[k].parent)]
            if up >= 0:
                last[up] = max(last[up], last[k])
        earlier: dict[int, Counter] = {}
        for k, n in enumerate(nodes):
            like = earlier.setdefault(id(n.parent), Counter())
            own = frozenset(n.classes)
            index = sum(c for (tag, classes), c in like.items() if tag == n.tag and classes >= own)
            like[n.tag, own] += 1
            yield k, number[id(n.parent)], last[k], n.depth - 1, n.tag, n.classes, n.attrs.get("href"), index, n.text()


def register(spark: SparkSession) -> None:
    """Makes ``html_nodes`` known to SQL, for use after LATERAL."""
    spark.udtf.register("html_nodes", HtmlNodes)


def _descend(root: Node, path: str) -> list[Node]:
    """As ``select``, the first segment at any depth and its number among all such elements."""
    first, _, rest = path.partition(">")
    tops = [n for n in root.walk() if _matches(n, first)]
    if at := re.search(r":eq\((\d+)\)", first):
        tops = tops[int(at[1]) : int(at[1]) + 1]
    return list(dict.fromkeys(x for n in tops for x in select(n, rest, _anywhere(path)))) if rest else tops


def _map(x) -> dict:
    return dict(x) if x is not None else {}


def event_blocks(html: Column, delimiter: Column, recipe: Column | None = None, alternates: Column | None = None) -> Column:
    """The blocks of a page for a delimiter path, parsed once: an array of block_no, html (their inside),
    href, text, fields for a recipe with alternates, and the fields of sub-events."""

    @F.pandas_udf("array<struct<block_no:int,html:string,href:string,text:string,fields:map<string,string>,subs:array<map<string,string>>>>")
    def run(pages: pd.Series, paths: pd.Series, recipes: pd.Series, others: pd.Series) -> pd.Series:
        def one(h, p, r, o):
            if not h or not p:
                return []
            r, o = _map(r), _map(o)
            return [(k, outer(n), nearest_href(n), n.text(), fields_of(n, r, o), sub_events_of(n, r, o)) for k, n in enumerate(_descend(parse(h), p))]

        return pd.Series([one(*x) for x in zip(pages, paths, recipes, others)])

    none = F.lit(None).cast("map<string,array<string>>")
    return run(html, delimiter, none if recipe is None else recipe, none if alternates is None else alternates)


def outer(node: Node) -> str:
    """Markup that parses to the node's inside again."""
    out: list[str] = []
    stack: list[str | Node] = node.texts[::-1]
    while stack:
        t = stack.pop()
        if isinstance(t, Node):
            attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in t.attrs.items())
            out.append(f"<{t.tag}{attrs}>")
            if t.tag not in VOID:
                stack += [_End(t.tag), *t.texts[::-1]]
        elif isinstance(t, _End):
            out.append(f"</{t}>")
        else:
            out.append(t.replace("&", "&amp;").replace("<", "&lt;"))
    return "".join(out)


class _End(str):
    """The name of an element that ends here."""


def extract_fields(block: Column, recipe: Column, alternates: Column | None = None, before: Column | None = None, linked: bool = False) -> Column:
    """``fields_of`` a block or page for a recipe (map of key to paths) as a map of key to text."""

    @F.pandas_udf("map<string,string>")
    def run(blocks: pd.Series, recipes: pd.Series, others: pd.Series, earlier: pd.Series) -> pd.Series:
        return pd.Series([fields_of(parse(b), _map(r), _map(o), _map(e), linked) for b, r, o, e in zip(blocks, recipes, others, earlier)])

    none = F.lit(None).cast("map<string,array<string>>")
    return run(block, recipe, none if alternates is None else alternates, F.lit(None).cast("map<string,string>") if before is None else before)


def recipe_links(html: Column, delimiter: Column, recipe: Column) -> Column:
    """``links_of`` a page as an array."""

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series, paths: pd.Series, recipes: pd.Series) -> pd.Series:
        return pd.Series([links_of(parse(h), p, _map(r)) if h and p else [] for h, p, r in zip(pages, paths, recipes)])

    return run(html, delimiter, recipe)


def leaves(html: Column) -> Column:
    """``leaf_texts`` of a page as an array of path and text."""

    @F.pandas_udf("array<struct<path:string,text:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([[(absolute_path(n), n.text()) for n in leaf_texts(parse(h))] if h else [] for h in pages])

    return run(html)


def analyse_pages(html: Column, samples: Column, links: Column) -> Column:
    """``analyse`` as a struct of delimiter, mainPage, events and dates."""

    @F.pandas_udf("struct<delimiter:string,mainPage:map<string,array<string>>,events:int,dates:array<string>>")
    def run(pages: pd.Series, strings: pd.Series, links: pd.Series) -> pd.DataFrame:
        found = [analyse(h or "", {k: list(v) for k, v in _map(s).items()}, bool(u)) for h, s, u in zip(pages, strings, links)]
        return pd.DataFrame(found, columns=["delimiter", "mainPage", "events", "dates"])

    return run(html, samples, links)


def clean_attribute_classes(html: Column) -> Column:
    """Class values without punctuation that selector paths give a meaning."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        fix = lambda m: m[1] + re.sub(r"[~!@$%^&*()+=,./';:?><\[\]\\{}|`#]", "", m[2]) + '"'
        return s.map(lambda x: x if x is None else re.sub(r'(<[^>]*?class=")([^"]*)"', fix, x))

    return run(html)


def _text_column(change) -> Callable[[Column], Column]:
    """A column function from a function of one string; null stays null."""

    def column(html: Column) -> Column:
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: x if x is None else change(x))

        return run(html)

    return column


def _with_depth(source: str) -> str:
    root = parse(source)
    used = {c for n in root.walk() for c in n.classes}
    prefix = "depth"
    while any(c.startswith(prefix) for c in used):
        prefix += "X"
    for n in root.walk():
        n.attrs["class"] = " ".join([*n.classes, f"{prefix}{n.depth}"])
    return outer(root)


def _close_links(source: str) -> str:
    """Ends a link where the next one begins."""
    out, inside = [], False
    for part in re.split(r"(<a\b[^>]*>|</a>)", source):
        if part.startswith("<a"):
            out.append("</a>" + part if inside else part)
            inside = True
        elif part != "</a>":
            out.append(part)
        elif inside:
            out.append(part)
            inside = False
    return "".join(out)


def _shape(node: Node) -> str:
    """Element names with their inside in parentheses."""
    out: list[str] = []
    stack: list[str | Node] = node.texts[::-1]
    while stack:
        t = stack.pop()
        if isinstance(t, Node):
            out.append(f"{t.tag}(")
            stack += [_End(t.tag), *t.texts[::-1]]
        elif isinstance(t, _End):
            out.append(")")
        elif t.strip():
            out.append(t.strip())
    return re.sub(r" \)", ")", re.sub(r"\( ", "(", " ".join(out)))


def _compact(source: str, keep: bool) -> str:
    root, names = parse(source), {}
    for n in root.walk():
        classes = n.classes
        n.attrs = {}
        if keep and classes:
            n.attrs["class"] = " ".join(names.setdefault(c, f"c{len(names)}") for c in classes)
    return outer(root)


lower_text = _text_column(lambda x: re.sub(r"(<[^>]*>)|([^<]+)", lambda m: m[1] or m[2].lower(), x))
add_depth = _text_column(_with_depth)
close_links = _text_column(_close_links)
#: Shorter forms of a page: classes renumbered, no classes, text lines, nested ``tag(...)``.
compact = _text_column(lambda x: _compact(x, True))
minimal = _text_column(lambda x: _compact(x, False))
plain_text = _text_column(lambda x: "\n".join(t for n in [parse(x)] for e in [n, *n.walk()] if (t := " ".join(p.strip() for p in e.texts if isinstance(p, str) and p.strip()))))
parenthesis = _text_column(lambda x: _shape(parse(x)))


def clean_page(html: Column) -> Column:
    """The cleaning that stored pages get: native steps first, then those that need the tree."""
    html = text.remove_forms(text.remove_useless_tags(text.wrap_broken_lines(text.clean_scripts(html))))
    return add_depth(text.fix_images(close_links(clean_attribute_classes(html))))


def path_hits(block: Column, recipe: Column) -> Column:
    """How many elements each key's paths reach in a block."""

    @F.pandas_udf("map<string,int>")
    def run(blocks: pd.Series, recipes: pd.Series) -> pd.Series:
        one = lambda b, r: {k: sum(len(select(b, p)) for p in v) for k, v in (r or {}).items()}
        return pd.Series([one(parse(b), dict(r) if r is not None else None) for b, r in zip(blocks, recipes)])

    return run(block, recipe)
