"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of block tags and texts (tags within a line belong to the text). Inference aligns streams, one after
another: equal tags match; a run of like siblings becomes a repeated group, and what one side lacks an optional group,
each with its inner stream aligned in turn; texts that differ become a slot. The result has groups, optional and
repeated, but no alternatives; too many neighbours become one repeated group in which each label stands once. Pages of
one layout are merged first, in any order, and then a host's layouts by their hash, so every page of a host counts and
the result doesn't depend on how rows fall into tasks.

Each page is then matched with its host's wrapper part by part, and its texts are judged by the slots they take. A
text that the wrapper has as a constant of many pages is template; a slot that holds mostly links is a menu; elements
that say what they are (nav, footer, class names) are believed. Where the parts that a page takes mark its article,
the texts within the mark are kept, all of them, and no others, else all that are left. Parts that the wrapper doesn't know are judged by the page
alone.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, slices, table

# The kinds of HTML elements, and words in names of parts that aren't the article.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A block inside a paragraph ends it.
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOUNDARY = set("ul ol table dl div section article body td".split())
NOT_MAIN = set("head nav header footer aside form button select menu dialog".split())
NOT_MAIN_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that name a place or a container and so leave what another word says: `cookie-bar` is a notice, `related-work` isn't.
NEUTRAL = set("area bar block bottom box col column container content footer global group header holder inner item items left link links list main outer page panel posts right row section sidebar site slot top unit wrap wrapper".split())
MAIN = {"article", "main"}
MAIN_NAMES = set("article content entry main post story".split())

#: What may stand in a head; anything else ends it, as its end tag may be left out.
METADATA = set("base link meta noscript script style template title".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SPECIAL = re.compile("[>\"']")
RAW_ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Neighbours in a wrapper; more of them become a repeated group that has each label once.
LONGEST = 100
#: Groups of layouts of a host that are aligned at once, and parts held in a task before they are sent on.
SALTS, HELD_PARTS = 256, 500_000
#: Elements nested deeper than this lend their texts to the one at this depth, with what their labels say of them.
DEEPEST = 150
#: A constant is template from so many pages on, but never within an article that a page marks.
TEMPLATE_PAGES = 3
#: The share of linked words from which a slot is a menu.
LINKED = 0.5
#: Wrappers (compressed) are broadcast up to so many bytes in all; beyond, pages and wrappers are joined by host.
BROADCAST_BYTES = 32 << 20
#: What labels of elements below DEEPEST say of a text.
PLAIN, OUT, WITHIN = 0, 1, 2


class Node:
    """An element: its label (tag, and names where they tell), and its parts: elements, texts as (text, linked, what
    deeper labels say), and None where a block ends."""

    __slots__ = ("label", "parts")

    def __init__(self, label: str):
        self.label, self.parts = label, []


def names_of(value: str) -> set[str]:
    """The telling words of a class, id or role: of `cookie-bar` the first, of `related-work` none."""
    out = set()
    for name in value.lower().split():
        words = [w for w in re.split("[_-]+", name) if w]
        if all(w in NOT_MAIN_NAMES or w in MAIN_NAMES or w in NEUTRAL for w in words):
            out.update(w for w in words if w in NOT_MAIN_NAMES or w in MAIN_NAMES)
    return out


def label_of(tag: str, attributes: str) -> str:
    names = set().union(*(names_of(m[1] or m[2] or m[3] or "") for m in NAME.finditer(attributes)))
    return ".".join([tag, *sorted(names)])


def tokens(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, tag or text, attributes, end) of each piece of markup: kind is "" for text, "<" and ">" for tags that begin and
    end an element. A caller that sends a place goes on from there. Time is linear: of a "<" that begins no whole tag, which
    is text, what was looked at is kept in mind, so that no later one looks at it again."""
    at, last = 0, html.rfind(">")
    failed: set[int] = set()  # signs that lead to no end of a tag, when met outside of quotes
    ahead = -1  # the next sign from where one was last looked for

    def special(start: int) -> int:
        nonlocal ahead
        if ahead < start:
            m = SPECIAL.search(html, start)
            ahead = m.start() if m else len(html)
        return ahead

    def end_of_tag(start: int) -> int:
        """The place behind the ">" that ends a tag, or -1."""
        seen = []
        sign = special(start)
        while sign < len(html) and sign not in failed:
            if html[sign] == ">":
                return sign + 1
            seen.append(sign)
            close = html.find(html[sign], sign + 1)
            if close < 0:
                break
            m = SPECIAL.search(html, close + 1)
            sign = m.start() if m else len(html)
        failed.update(seen)
        return -1

    while at < len(html):
        if at > last:  # no tag ends here; a comment that isn't ended goes to the end
            cut = html.find("<!--", at)
            yield "", html[at : len(html) if cut < 0 else cut], "", len(html)
            return
        less = html.find("<", at)
        if less != at:
            end = len(html) if less < 0 else less
            yield "", html[at:end], "", end
            at = end
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = len(html) if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            at = html.index(">", at) + 1
            continue
        m = TAG.match(html, at)
        end = end_of_tag(m.end()) if m else -1
        if end < 0:
            yield "", "<", "", at + 1
            at += 1
            continue
        on = yield "</" if m[1] else "<", m[2].lower(), html[m.end() : end - 1], end
        at = end if on is None else on
        if on is not None:
            yield "", "", "", at


def said_below(says: int, label: str) -> int:
    """What labels below DEEPEST say of a text, with one more of them."""
    return OUT if says == OUT or is_boilerplate(label, says == WITHIN) else WITHIN if says == WITHIN or is_main(label) else PLAIN


def parse(html: str) -> Node:
    """The tree of block elements. Never fails: stray end tags are ignored, open elements end with their parents, and of
    elements whose end tags may be left out (paragraphs, items, cells, the head) what can't stand in them ends them."""
    root = Node("")
    # The node that takes the parts, the element's own tag, and what labels below DEEPEST say of its texts.
    stack, anchors = [(root, "", PLAIN)], 0
    opened: dict[str, int] = {}

    def add(text: str, linked: bool) -> None:
        if stack[-1][1] == "head" and text.strip():
            close(len(stack) - 1)
        stack[-1][0].parts.append((text, linked, stack[-1][2]))

    def close(k: int) -> None:
        if len(stack) > DEEPEST:
            stack[-1][0].parts.append(None)
        for _, tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    pieces = tokens(html)
    for kind, tag, attributes, at in pieces:
        if not kind:
            if tag:
                add(entities.unescape(tag), anchors > 0)
            continue
        if kind == "<" and stack[-1][1] == "head" and tag not in METADATA:
            close(len(stack) - 1)
        if tag in RAW and kind == "<":
            m = RAW_ENDS[tag].search(html, at)
            pieces.send(len(html) if not m else html.find(">", m.start()) + 1 or len(html))
        elif tag in INLINE:
            if tag == "a":
                anchors = max(0, anchors + (-1 if kind == "</" else 1))
            elif tag == "br":
                add(" ", False)
        elif kind == "</":
            anchors = 0
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == tag:
                        close(k)
                        break
                    if tag in ("p", "li") and stack[k][1] in BOUNDARY:
                        break
        else:
            anchors = 0
            closes = SELF_CLOSING.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            if any(opened.get(c) for c in closes):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] in closes:
                        close(k)
                        break
                    if stack[k][1] in BOUNDARY:
                        break
            label, open_ = label_of(tag, attributes), tag not in VOID and not attributes.rstrip().endswith("/")
            if len(stack) < DEEPEST:
                node, says = Node(label), PLAIN
                stack[-1][0].parts.append(node)
            else:
                node, says = stack[-1][0], said_below(stack[-1][2], label)
                node.parts.append(None)
            if open_:
                stack.append((node, tag, says))
                opened[tag] = opened.get(tag, 0) + 1
    return root


# A wrapper's part: [label, quantifier, text, words, linked, pages, parts]. Texts have the label "#"; their text is the
# constant as the hash (32 hexadecimal digits) of all of it and its begin for display, or None for a slot. Quantifiers: "1", "?", "+", "*".
def stream(node: Node) -> list:
    """The page itself as a wrapper: every text constant, like siblings not yet folded."""
    parts, run = [], []

    def close() -> None:
        text = " ".join("".join(t for t, *_ in run).split())
        if text:
            parts.append(["#", "1", xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass")) + text[:80], len(text.split(" ")), sum(len(t.split()) for t, linked, _ in run if linked), 1, []])
        run.clear()

    for part in node.parts:
        if isinstance(part, Node):
            close()
            parts.append(stream(part))
        elif part is None:
            close()
        else:
            run.append(part)
    close()
    parts = fold(parts)
    return [node.label, "1", None, 0, 0, 1, parts if len(parts) <= LONGEST else bag(parts)]


def fold(parts: list) -> list:
    """Neighbours with one label become a repeated group."""
    out: list = []
    for p in parts:
        if out and out[-1][0] == p[0]:
            q = merged(out[-1], p, same_page=True)
            q[1] = "*" if out[-1][1] in "?*" and p[1] in "?*" else "+"
            out[-1] = q
        else:
            out.append(p)
    return out


def is_bag(parts: list) -> bool:
    return bool(parts) and parts[0][0] == "()"


def bag(parts: list) -> list:
    """A repeated group in which each label stands once, optional and repeated, in the order of labels."""
    if is_bag(parts):
        return parts
    by: dict[str, list] = {}
    for p in parts:
        by[p[0]] = merged(by[p[0]], p, same_page=True) if p[0] in by else p
    return [["()", "*", None, 0, 0, max((p[5] for p in parts), default=0), [[k, "*", *by[k][2:]] for k in sorted(by)]]]


def join_bags(a: list, b: list, same_page: bool) -> list:
    x, y = ({p[0]: p for p in group[0][6]} for group in (a, b))
    inner = [merged(x[k], y[k], same_page) if k in x and k in y else x.get(k) or y[k] for k in sorted(x.keys() | y.keys())]
    return [["()", "*", None, 0, 0, max(a[0][5], b[0][5]) if same_page else a[0][5] + b[0][5], inner]]


def merged(a: list, b: list, same_page: bool = False) -> list:
    """Two parts with one label aligned."""
    many, maybe = a[1] in "+*" or b[1] in "+*", a[1] in "?*" or b[1] in "?*"
    quantifier = ("*" if maybe else "+") if many else ("?" if maybe else "1")
    pages = max(a[5], b[5]) if same_page else a[5] + b[5]
    return [a[0], quantifier, a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], pages, align(a[6], b[6], same_page)]


def align(a: list, b: list, same_page: bool = False) -> list:
    """Two streams aligned by a longest common subsequence of labels; what one lacks is optional."""
    if a and b and (is_bag(a) or is_bag(b)):
        return join_bags(bag(a), bag(b), same_page)
    if [p[0] for p in a] == [p[0] for p in b]:
        return [merged(x, y, same_page) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    optional = {"1": "?", "+": "*", "?": "?", "*": "*"}
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(merged(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], optional[a[i][1]], *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], optional[b[j][1]], *b[j][2:]])
            j += 1
    out = fold(out)
    return out if len(out) <= LONGEST else join_bags(bag(a), bag(b), same_page)


def n_parts(part: list) -> int:
    return 1 + sum(map(n_parts, part[6]))


def layout(part: list) -> str:
    """Labels and quantifiers. Merging parts of one layout keeps it, and gives the same in any order."""
    return f"{part[0]}{part[1]}({' '.join(map(layout, part[6]))})"


def expression(part: list) -> str:
    """The wrapper as a regular expression over tags, texts and slots."""
    if part[0] == "#":
        inner = "TEXT" if part[2] is None else re.escape(part[2][32:])
    else:
        inner = f"<{part[0]}>" + "".join(map(expression, part[6])) + f"</{part[0].split('.')[0]}>" if part[0] not in ("", "()") else "".join(map(expression, part[6]))
    return inner if part[1] == "1" else f"({inner}){part[1]}"


def is_boilerplate(label: str, in_main: bool) -> bool:
    tag, *names = label.split(".")
    if tag in MAIN:
        return False
    return (tag in NOT_MAIN and not (in_main and tag == "header")) or any(n in NOT_MAIN_NAMES for n in names)


def is_main(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in MAIN or (any(n in MAIN_NAMES for n in names) and not any(n in NOT_MAIN_NAMES for n in names))


# A rule is what a wrapper's part says of a page's: [label, required, kept, pages if constant, holds text, parts,
# alignments, whether the parts are a repeated group of labels].
def rules(wrapper: list) -> list:
    """The wrapper with each text judged: it is kept unless it is template or mostly links."""
    inner_of = wrapper[6][0][6] if is_bag(wrapper[6]) else wrapper[6]
    inner = [rules(x) for x in inner_of]
    constant = wrapper[5] if wrapper[2] is not None else 0
    kept = wrapper[0] == "#" and constant < TEMPLATE_PAGES and wrapper[4] < LINKED * wrapper[3]
    holds = wrapper[3] > 0 or any(x[4] for x in inner if not is_boilerplate(x[0], True))
    return [wrapper[0], wrapper[1] in "1+", kept, constant, holds, inner, {}, is_bag(wrapper[6])]


def places(labels: tuple, rule: list) -> list:
    """For each of a page's neighbours, the rule it takes, or None: as many as can be, and the fewest required ones left
    out. Neighbours with one label are one."""
    known = rule[6].get(labels)
    if known is None and rule[7]:
        by = {p[0]: p for p in rule[5]}
        known = [by.get(label) for label in labels]
    elif known is None:
        parts = rule[5]
        n, m, much = len(labels), len(parts), len(parts) + 1
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n, -1, -1):
            for j in range(m - 1, -1, -1):
                skip = best[i][j + 1] - parts[j][1]
                if i < n:
                    skip = max(skip, best[i + 1][j], best[i + 1][j + 1] + much if labels[i] == parts[j][0] else skip)
                best[i][j] = skip
        known, i, j = [], 0, 0
        while i < n:
            if j < m and labels[i] == parts[j][0] and best[i][j] == best[i + 1][j + 1] + much:
                known.append(parts[j])
                i, j = i + 1, j + 1
            elif j < m and best[i][j] == best[i][j + 1] - parts[j][1]:
                j += 1
            else:
                known.append(None)
                i += 1
        if len(rule[6]) < 1000:
            rule[6][labels] = known
    return known


def neighbours(node: Node) -> list[tuple[str, list]]:
    """The parts by runs of one label: elements, and texts with what deeper labels say of them."""
    out: list[tuple[str, list]] = []
    run: list[tuple] = []

    def add(label: str, part) -> None:
        if out and out[-1][0] == label:
            out[-1][1].append(part)
        else:
            out.append((label, [part]))

    def close() -> None:
        text = " ".join("".join(t for t, *_ in run).split())
        if text:
            add("#", (text, next(says for t, _, says in run if t.strip())))
        run.clear()

    for part in node.parts:
        if isinstance(part, Node):
            close()
            add(part.label, part)
        elif part is None:
            close()
        else:
            run.append(part)
    close()
    return out


def taken(tree: Node, wrapper: list | None) -> tuple[list[tuple[str, bool, bool, list | None]], bool]:
    """Every text of the page with whether it lies in a marked article, whether in what isn't one, and the rule it
    takes; and whether the page marks its article, which the parts it takes decide, not other pages' parts."""
    out: list = []
    marked = False

    def walk(node: Node, rule: list | None, in_main: bool, out_of: bool, shut: bool) -> bool:
        nonlocal marked
        shut = shut or is_boilerplate(node.label, False)
        runs, holds = neighbours(node), False
        of = places(tuple(label for label, _ in runs), rule) if rule else [None] * len(runs)
        for (label, parts), r in zip(runs, of, strict=True):
            if label == "#":
                for text, says in parts:
                    out.append((text, in_main or says == WITHIN, out_of or says == OUT, r))
                    marked = marked or (says == WITHIN and not shut)
                    holds = holds or says != OUT
                continue
            inside = in_main or is_main(label)
            for part in parts:
                full = walk(part, r, inside, out_of or is_boilerplate(label, inside), shut)
                holds = holds or (full and not is_boilerplate(label, True))
        if is_main(node.label) and not shut and (holds or (rule and rule[4])):
            marked = True
        return holds

    walk(tree, wrapper, False, False, False)
    return out, marked


def main_text(html: str, known: list | None) -> str:
    """The main text of a page. known: the rules of its host. Texts that the wrapper doesn't have, and pages of which it
    only has constants (so that nothing tells template from article), are judged by the page alone."""
    tree = parse(html or "")
    found, marked = taken(tree, known)
    if marked:
        return "\n".join(text for text, in_main, out_of, _ in found if in_main and not out_of)
    if any(r is None for *_, r in found) or all(r[3] for *_, r in found):
        varies = any(r is not None and not r[3] for *_, r in found)
        alone, _ = taken(tree, rules(stream(tree)))
        found = [x if varies and x[3] is not None else y for x, y in zip(found, alone, strict=True)]
    return "\n".join(text for text, _, out_of, r in found if not out_of and r is not None and r[2])


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], list] = {}
    size = 0

    def send() -> pa.RecordBatch:
        columns = [[h for h, _ in held], [k for _, k in held], [json.dumps(w) for w in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "layout", "wrapper"])

    for batch in slices(batches, "html", 4 << 20):
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not html:
                continue
            page = stream(parse(html))
            key = (host, xxhash.xxh3_128_hexdigest(layout(page)))
            if key in held:
                held[key] = merged(held[key], page)
            else:
                held[key] = page
                size += n_parts(page)
        if size > HELD_PARTS:
            yield send()
            held.clear()
            size = 0
    yield send()


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """All layouts of the group as one wrapper: first the parts of each layout, then the layouts in order."""
    by: dict[str, list] = {}
    for key, text in zip(pdf["layout"], pdf["wrapper"], strict=True):
        part = json.loads(text)
        by[key] = merged(by[key], part) if key in by else part
    whole = None
    for key in sorted(by):
        whole = by[key] if whole is None else merged(whole, by[key])
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "layout": [min(by)], "wrapper": [json.dumps(whole)]})


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (as JSON; `expression` shows it as a regular expression), from all pages with html.

    Layouts of a host meet in up to SALTS groups by their hash, whose wrappers then meet in one, so a group stays small
    however many pages the host has.
    """
    kind = "host string, layout string, wrapper string"
    part = pages.select(host_of().alias("host"), "html").mapInArrow(_infer, kind)
    salted = part.withColumn("salt", F.pmod(F.xxhash64("layout"), F.lit(SALTS)))
    once = salted.groupBy("host", "salt").applyInPandas(_combine, kind)
    return once.groupBy("host").applyInPandas(_combine, kind).select("host", "wrapper")


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers without their texts, compressed, as rows of pages carry them."""

    def bare(p: list) -> list:
        return [p[0], p[1], None if p[2] is None else "", *p[3:6], [bare(x) for x in p[6]]]

    for batch in batches:
        small = [zlib.compress(json.dumps(bare(json.loads(w))).encode(), 9) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(small, pa.binary())], ["host", "wrapper"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row of pages (page_id, url, html): blocks of the main text joined by newlines.

    Null and empty html give an empty text; very long and deeply nested pages are read whole. Pages without a host form
    the host ''. Repeated rows get the same text; of equally good alignments the one that leaves out a page's later
    parts is taken, so reruns agree. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list] = {}
        for batch in slices(batches, "html", 4 << 20):
            out = []
            for html, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper is not None and wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = rules(json.loads(zlib.decompress(wrapper)))
                out.append(main_text(html, known.get(wrapper)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    hosted = pages.select("page_id", "url", "html", host_of().alias("host"))
    wrappers = durable(infer(pages).mapInArrow(_slim, "host string, wrapper binary"))
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    # Few wrappers go to the pages. Of many, each goes with its host's pages, and adaptive execution splits hot hosts.
    if size <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    return hosted.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string")


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
