import itertools
import os
import random
import re
import time
from html.parser import HTMLParser

import pytest

from lexloom.llm import wrappers as wr

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>{title}</h1><p>{one} <b>bold</b> &amp; more<p>Second &lt;tag&gt;
  text</article><aside>side</aside><form><p>Enter</p></form>
<div id="comments"><p>reader says</p></div><script>var x = "<p>no</p>";</script><footer>&copy; f</footer></body></html>"""


def test_marked_article():
    assert wr.main_text(PAGE.format(title="T", one="First"), None) == "T\nFirst bold & more\nSecond <tag> text"


@pytest.mark.parametrize("html", ["", None, "<", "a < b", "<p", "</p></div>", "<!-- x", "<script>never closed", "<div>" * 3000 + "deep" + "</div>" * 3000, "<a href='x>y'>q</a>"])
def test_never_fails(html):
    assert isinstance(wr.main_text(html, None), str)


@pytest.mark.parametrize(
    "html,text",
    [
        ("<html><head><title>t</title><body><p>Hello...</p><p>Second.</p></body></html>", "Hello...\nSecond."),
        ("<title>t</title><p>One<p>Two", "One\nTwo"),
        ("<html><head><meta charset=x><title>t</title><link rel=a><p>One</p>", "One"),
        ("<html><head><style>p {}</style>Bare text<div>Two</div>", "Bare text\nTwo"),
        ("<head><script>x</script></head><ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><th>c</table><dl><dt>d<dd>e</dl>", "a\nb\nc\nd\ne"),
        ("<p>One<div>Two</div><script>İİİ</script>Three</SCRIPT >Four", "One\nTwo\nThreeFour"),
    ],
)
def test_end_tags_that_are_left_out(html, text):
    assert wr.main_text(html, None) == text


@pytest.mark.parametrize("piece", ["<p ", "</x ", '<p "', '<p ">" ', "<a '\"", "<! ", "<!-- ", "<blockquote>", "<li><blockquote>", "<script>", "a<"])
@pytest.mark.parametrize("end", ["", ">", '">"'])
def test_long_broken_markup_takes_linear_time(piece, end):
    def seconds(n):
        start = time.perf_counter()
        wr.parse(piece * (n // len(piece)) + end)
        return time.perf_counter() - start

    assert seconds(5_000_000) < 30 and seconds(1_000_000) < 30 * seconds(100_000) + 0.2


def test_texts_of_a_marked_article_stay_however_often_they_are_repeated(spark):
    page = "<body><nav>menu</nav><article><p>running text {} of the page</p><p>Under a licence of the host.</p></article></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(12)]
    got = {r.page_id: r.text for r in wr.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"running text {i} of the page\nUnder a licence of the host." for i in range(12)}


def test_unmarked_pages_need_their_host(spark):
    """Without marks for the article, the template's fixed texts only show beside the host's other pages."""
    page = "<html><body><div class=\"top\">This line of ten or more words stands on every page of the host here</div><div><p>{}</p></div></body></html>"
    words = "running text of page {} that goes on for quite a few words more than ten of them"
    rows = [(i, f"http://h.example/{i}", page.format(words.format(i))) for i in range(6)] + [(9, "http://other.example/", None)]
    got = {r.page_id: r.text for r in wr.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: words.format(i) for i in range(6)}, 9: ""}


def test_a_page_without_marks_beside_marked_pages(spark):
    """Whether a page marks its article is its own matter; the other pages tell what is template."""
    top = "<div>This line of ten or more words stands on every page of the host here</div>"
    words = "running text of page {} that goes on for quite a few words more than ten of them"
    marked = "<body>" + top + "<article><p>{}</p></article></body>"
    plain = "<body>" + top + "<div id=x><p>{}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", (plain if i % 2 else marked).format(words.format(i))) for i in range(8)]
    got = {r.page_id: r.text for r in wr.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: words.format(i) for i in range(8)}


def test_slots_of_one_path_are_told_apart():
    top, words = "This line of ten or more words stands on every page of the host here", "running text {} that goes on for quite a few words more than ten of them"
    pages = [f"<div>{top}</div><h2>t {i}</h2><div>{words.format(i)}</div>" for i in range(4)]
    whole = stream(pages[0])
    for page in pages[1:]:
        whole = wr.merged(whole, stream(page))
    assert wr.main_text(pages[2], wr.rules(whole)) == f"t 2\n{words.format(2)}"
    assert wr.main_text(pages[2], None) == f"{top}\nt 2\n{words.format(2)}"  # nothing but the wrapper tells


def test_texts_with_one_beginning_are_not_constant():
    lead = "From our own correspondent, who has been there for many years and writes every week now: "
    texts = [f"{lead}story {i} in running words" for i in range(4)]
    whole = stream(f"<div>{texts[0]}</div>")
    for text in texts[1:]:
        whole = wr.merged(whole, stream(f"<div>{text}</div>"))
    assert wr.main_text(f"<div>{texts[3]}</div>", wr.rules(whole)) == texts[3]


def test_hosts_with_very_many_layouts_have_a_wrapper_under_any_partitioning(spark):
    rng, top = random.Random(0), "<div class=top>This line of ten or more words stands on every page of the host here</div>"
    words = "running text of page {} that goes on for quite a few words more than ten of them"
    rows = []
    for i in range(60):
        tags = [rng.choice("h2 p ul table pre section dl blockquote".split()) for _ in range(rng.choice((5, 40, 400)))]
        rows.append((i, f"http://h.example/{i}", top + f"<div><p>{words.format(i)}</p>" + "".join(f"<{t}><div><p>{t} {words.format(i)} {k}</p></div></{t}>" for k, t in enumerate(tags)) + "</div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, other = (wr.infer(pages.repartition(n, "page_id")).collect() for n in (1, 7))
    assert len(one) == 1 and one == other
    got = {r.page_id: r.text for r in wr.extract(pages).collect()}
    for i, _, html in rows:
        assert got[i] == "\n".join(re.findall("<p>([^<]+)", html))


def stream(html):
    return wr.stream(wr.parse(html))


def test_alignment_gives_optional_and_repeated_groups_and_slots():
    a = stream("<div><h2>One</h2><p>x</p><p>y</p><ul><li>i</li></ul></div>")
    b = stream("<div><h2>Two</h2><p>z</p></div>")
    assert wr.expression(wr.merged(a, b)) == "<div><h2>TEXT</h2>(<p>TEXT</p>)+(<ul><li>i</li></ul>)?</div>"


def test_alignment_order_gives_the_same_kinds():
    pages = [stream(h) for h in ("<div><p>a</p></div>", "<div><p>b</p><p>c</p></div>", "<div><h2>t</h2><p>d</p></div>")]
    left = wr.merged(wr.merged(pages[0], pages[1]), pages[2])
    right = wr.merged(pages[0], wr.merged(pages[1], pages[2]))
    assert wr.expression(left) == wr.expression(right) == "<div>(<h2>t</h2>)?(<p>TEXT</p>)+</div>"


def test_the_same_text_is_template_in_one_slot_and_article_in_another():
    """Only the part that a page's text takes tells: on the odd page the article says what the box says elsewhere."""
    box = "The board meets on every first Monday of the month"
    pages = [f"<div><p>{box}</p></div><h2>t {i}</h2><div><p>{box if i == 3 else f'story {i}'}</p></div>" for i in range(6)]
    whole = stream(pages[0])
    for page in pages[1:]:
        whole = wr.merged(whole, stream(page))
    known = wr.rules(whole)
    assert wr.main_text(pages[3], known) == f"t 3\n{box}"
    assert wr.main_text(pages[4], known) == "t 4\nstory 4"


def test_nothing_of_a_marked_article_is_template():
    """A line that closes every article, such as its licence, is part of it."""
    pages = [f"<article><h1>t {i}</h1><p>story {i}</p><div>Write to the editor about this</div></article>" for i in range(12)]
    whole = stream(pages[0])
    for page in pages[1:]:
        whole = wr.merged(whole, stream(page))
    assert wr.main_text(pages[0], wr.rules(whole)) == wr.main_text(pages[0], None) == "t 0\nstory 0\nWrite to the editor about this"


def test_copies_of_one_page_are_not_template():
    page = "<article><h1>t</h1><p>story</p></article>"
    whole = stream(page)
    for _ in range(20):
        whole = wr.merged(whole, stream(page))
    assert wr.main_text(page, wr.rules(whole)) == "t\nstory"


@pytest.mark.parametrize(
    "html,text",
    [
        ("<div><p>Short one.</p><p>Tiny.</p></div>", "Short one.\nTiny."),
        ("<article><p>a</p><div class=related-work>b</div><div class='notice-board'>c</div><div class='cookie-bar'>d</div><div class='x related_posts'>e</div></article>", "a\nb\nc"),
        ("<div>" * 400 + "<nav>menu</nav><article>one<p>two</p><div class=ad>buy</div></article><article>three</article>" + "</div>" * 400, "one\ntwo\nthree"),
        ("<div>" * 400 + "<p>one</p><footer>f</footer><p>two</p>", "one\ntwo"),
    ],
)
def test_pages_by_themselves(html, text):
    assert wr.main_text(html, None) == text


def regex(part):
    inner = "T" if part[0] == "#" else "".join(map(regex, part[6]))
    inner = inner if part[0] in ("#", "()") else f"<{part[0]}>{inner}</>"
    return inner if part[1] == "1" else f"(?:{inner}){part[1]}"


def written(node):
    out, text = f"<{node.label}>", ""
    for part in [*node.parts, None]:
        if isinstance(part, wr.Node) or part is None:
            out += "T" * bool(text.strip())
            text = ""
            out += written(part) if part else ""
        else:
            text += part[0]
    return out + "</>"


def random_page(rng, depth=3):
    parts = []
    for _ in range(rng.randrange(4)):
        tag = rng.choice(["div", "p", "ul", "h2", "#"])
        parts.append(f"w{rng.randrange(3)} " if tag == "#" or not depth else f"<{tag}>{random_page(rng, depth - 1)}</{tag}>")
    return "".join(parts)


@pytest.mark.parametrize("seed", range(40))
def test_the_wrapper_matches_every_page_it_was_inferred_from(seed):
    rng = random.Random(seed)
    trees = [wr.parse(random_page(rng)) for _ in range(rng.randrange(1, 6))]
    whole = wr.stream(trees[0])
    for tree in trees[1:]:
        whole = wr.merged(whole, wr.stream(tree))
    for tree in trees:
        assert re.fullmatch(regex(whole), written(tree))


@pytest.mark.parametrize("seed", range(30))
def test_alignment_is_the_longest_of_all(seed):
    rng = random.Random(seed)

    def side():
        out = []
        for _ in range(rng.randrange(7)):
            tag = rng.choice([t for t in "abcd" if not out or t != out[-1][0]])
            out.append([tag, "1", None, 0, 0, 1, []])
        return out

    a, b = side(), side()
    subs = lambda x: {tuple(p[0] for p in c) for n in range(len(x) + 1) for c in itertools.combinations(x, n)}
    most = max(map(len, subs(a) & subs(b)))
    got = wr.align(a, b)
    assert sum(p[5] == 2 for p in got) >= most and len(got) <= len(a) + len(b) - most
    assert all(p[1] in "1?+*" for p in got)


def test_few_wrappers_are_broadcast_and_no_page_is_shuffled(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    plan = wr.extract(pages)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_many_wrappers_are_joined_by_host(spark, small_dir, monkeypatch):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    few = sorted(map(tuple, wr.extract(pages).collect()))
    monkeypatch.setattr(wr, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, wr.extract(pages).collect())) == few


def test_articles_of_all_pages(spark, small_dir):
    import html

    got = {r.page_id: r.text for r in wr.op7_wrappers(spark, small_dir).collect()}
    for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_awkward_rows(spark):
    schema = "page_id long, url string, html string, text string, host string"
    rows = [(None, None, None, "t", "h"), (1, "no url", "<p>" + "word " * 20_000, "t", "h"), (1, "no url", "<p>" + "word " * 20_000, "t", "h"), (2, "http://a/", "", "t", "h")]
    got = sorted((r.page_id or 0, len(r.text)) for r in wr.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0), (1, 99_999), (1, 99_999), (2, 0)]
    assert wr.extract(spark.createDataFrame([], schema)).count() == 0


NOT_ARTICLE = set("head nav header footer aside form button select menu dialog script style template noscript iframe textarea title".split())
SAYS_OUT = re.compile(r"\b(ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|menu|modal|nav\w*|newsletter|notice|popup|promo|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)\b")
SAYS_MAIN = re.compile(r"\b(article|content|entry|main|post|story)\b")


class Plain(HTMLParser):
    """The texts of a marked article, by the standard library's parser: within what says it is the article, outside of what
    says it isn't."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.now = [], [], []

    def end_block(self):
        text = " ".join("".join(self.now).split())
        self.blocks += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in wr.INLINE:
            if tag == "br":
                self.handle_data(" ")
            return
        self.end_block()
        if tag in wr.VOID:
            return
        if self.open and self.open[-1][0] == tag and tag in ("p", "li", "td", "tr"):
            self.open.pop()
        names = re.sub("[_-]", " ", " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower())
        main = tag in ("article", "main")
        out = not main and (tag in NOT_ARTICLE or bool(SAYS_OUT.search(names)))
        self.open.append((tag, out, main or (not out and bool(SAYS_MAIN.search(names)))))

    def handle_endtag(self, tag):
        if tag in wr.INLINE:
            return
        self.end_block()
        at = max((i for i, (name, *_) in enumerate(self.open) if name == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        within = False
        for tag, out, main in self.open:
            within = within or main
            if out and not (tag == "header" and within):
                return
        if within:
            self.now.append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_whole_query_is_a_plain_version(spark, small_dir, sf):
    folder = f"{os.path.dirname(small_dir)}/{sf}"
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = wr.op7_wrappers(spark, folder).collect()
    assert len(got) == len(html)
    for r in got:
        page = Plain()
        page.feed(html[r.page_id])
        page.close()
        page.end_block()
        assert r.text == "\n".join(page.blocks) and r.n_chars == len(r.text)
