"""Main text of web pages: flat text blocks, their word counts and link densities, and a decision tree.

The page is read once as a row of tags and texts. Text between block tags is one block, with its number of words, the
share of them inside links, the same two numbers of the blocks before and after, and evidence from what encloses it: whether it
stands in an article or main element, how many enclosing elements are boilerplate elements (menu, header, footer, aside, form) or
have a class, id or role that names boilerplate, and whether its own paragraph has such a name. An element is no evidence if it
holds the main element or the longest article (without either: more than half of the words of the page), however it is named.
A decision tree over these numbers says which blocks are main text. It is trained when the query runs, on the small labelled pages
below, in which names and words disagree as well.

Null and empty pages give the empty text. Broken markup (unclosed or misplaced tags, comments, quotes) is
read to the end of the page, in time that grows with the length of the page. Repeated rows are kept. No shuffle; a page of any
length is one row of work.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Batches, map_arrow, table

#: Elements whose content is not text of the page; those of them that may be written as empty (in HTML the others go on after a "/>").
HIDDEN = set("script style noscript template textarea iframe svg title select object canvas annotation annotation-xml".split())
FOREIGN = {"svg", "annotation", "annotation-xml"}
#: Elements that open a block, elements without content, boilerplate elements, and elements that are one paragraph (fixed values).
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video audio".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
FLOW = {"p", "span", "a", "b", "i", "em", "strong", "small", "font", "time", "code", "q", "u", "sup", "sub", "mark", "abbr", "cite"}
#: Elements that end others of a kind that are still open, down to their list or table.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Parts of class, id and role names of boilerplate.
NAMES = set("ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead footer foot contentinfo complementary comment comments commentlist disqus reply replies respond discussion related recommended recommendations share sharing social newsletter subscribe subscription signup login register form search popup modal overlay pagination pager toolbar copyright disclaimer skip hidden topbar header".split())
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Characters of a tag in which quotes are followed; a longer tag ends at the next ">".
LONGEST = 8192
ATTRIBUTES = re.compile(r"\b(class|id|role|aria-label|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "evidence", "own", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    element: int
    own: int
    heading: int
    article: int = 0
    evidence: int = 0


@dataclass
class Element:
    """An element that is evidence: an article or main element, a boilerplate element, or one with a boilerplate name."""

    parent: int
    tag: str
    hits: int
    header: int
    words: int = 0


def names_boilerplate(rest: str) -> tuple[int, int]:
    """How many class, id and role names of an element name boilerplate (an element that is not shown counts as one), and whether one is "header"."""
    hits, header = 0, 0
    for name, value in ATTRIBUTES.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hits += 1
        elif name == "style":
            hits += bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name not in ("aria-label", "aria-hidden"):
            found = {p.lower() for p in PARTS.findall(value)} & NAMES
            header = header or int("header" in found)
            hits += len(found - {"header"})
    return hits, header


def tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag, whether it ends, attributes) in order; hidden elements and comments give a space or nothing."""
    at = start = 0
    last = page.rfind(">")
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            break
        name = NAME.match(page, at)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[start:at], "", False, ""
            at = start = end + 3 if end >= 0 else len(page)
        elif name:
            ends, tag = name[1] == "/", name[2].lower()
            rest = REST.match(page, name.end(), name.end() + LONGEST)
            stop = rest.end() if rest else page.find(">", name.end()) + 1
            text, attributes = page[start:at], rest[1] if rest else ""
            if tag in HIDDEN and not ends:
                if not (tag in FOREIGN and attributes.endswith("/")):
                    after = re.compile(rf"</{tag}\s*+>", re.I).search(page, page.find(">", name.end()) + 1)
                    stop = after.end() if after else len(page)
                yield text, " ", False, ""
            else:
                yield text, tag, ends, attributes
            at = start = stop
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            yield page[start:at], "", False, ""
            at = start = page.find(">", at) + 1
        else:
            at += 1
    yield page[start:], "", False, ""


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, int, int]] = []  # open elements: tag, innermost evidence, names of the paragraph around
    places: dict[str, list[int]] = {}  # where each tag stands in the stack
    solid: list[int] = []  # where elements other than paragraphs and inline ones stand
    parts: list[str] = []
    link = words = linked = heading = 0

    def close() -> None:
        nonlocal words, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, element, own = stack[-1] if stack else ("", -1, 0)
                out.append(Block(text, max(words, 1), linked, element, own, heading))
                if element >= 0:
                    elements[element].words += max(words, 1)
            parts.clear()
        words = linked = 0

    def cut(size: int) -> None:
        for tag, *_ in stack[size:]:
            places[tag].pop()
        del stack[size:]
        while solid and solid[-1] >= size:
            solid.pop()

    for text, tag, ends, rest in tags(page):
        if text:
            parts.append(text)
            n = len(text.split())
            words += n
            linked += n if link else 0
        if tag == " " or tag == "br":
            parts.append(" ")
        if tag in ("", " ") or tag in VOID and tag not in BLOCKS:
            continue
        if tag == "a":
            link = 0 if ends else 1
        block = tag in BLOCKS
        if block:
            close()
            link = 0
        if tag[0] == "h" and tag[1:].isdigit():
            heading = 0 if ends else 1
        if tag in VOID:
            continue
        if ends:
            if open_at := places.get(tag):
                size = open_at[-1]
                # A paragraph or inline element does not end what holds it.
                if tag not in FLOW or not solid or solid[-1] < size:
                    if tag in FLOW and stack[size][2] != (stack[size - 1][2] if size else 0):
                        close()
                    cut(size)
            continue
        if rest.endswith("/") and tag not in ("p", "div", "li"):
            continue
        if block:  # a block ends open paragraphs and inline elements
            cut(solid[-1] + 1 if solid else 0)
            if tag in ENDS:
                ended, within = ENDS[tag]
                floor = max((places[t][-1] for t in within if places.get(t)), default=-1)
                ended_at = min((p for t in ended if places.get(t) for p in places[t][-1:] if p > floor), default=None)
                if ended_at is not None:
                    cut(ended_at)
        _, element, own = stack[-1] if stack else ("", -1, 0)
        named, header = names_boilerplate(rest) if rest else (0, 0)
        if tag in FLOW:
            if named and not own and tag != "p":
                close()
            own += named
        else:
            own = 0
            hits = named + (tag in BOILER)
            if hits or header or tag in ("article", "main"):
                elements.append(Element(element, tag, hits, header))
                element = len(elements) - 1
            solid.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, element, own))
    close()
    weigh(out, elements)
    return out


def weigh(row: list[Block], elements: list[Element]) -> None:
    """Fills in the evidence of the blocks."""
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].words += e.words
    total = sum(b.words for b in row)
    mains = [k for k, e in enumerate(elements) if e.tag == "main"]
    articles = [k for k, e in enumerate(elements) if e.tag == "article"]
    anchor = mains[0] if mains else max(articles, key=lambda k: (elements[k].words, -k), default=-1)
    if mains:  # an article that holds most of the main element stands for it
        inside = [False] * len(elements)
        for k in range(anchor, len(elements)):
            inside[k] = k == anchor or (elements[k].parent >= 0 and inside[elements[k].parent])
        best = max((k for k in articles if inside[k]), key=lambda k: (elements[k].words, -k), default=-1)
        anchor = best if best >= 0 and 2 * elements[best].words > elements[anchor].words else anchor
    holders, k = set(), anchor
    while k >= 0:
        holders.add(k)
        k = elements[k].parent
    article, evidence = [], []
    for k, e in enumerate(elements):
        inside, hits = (article[e.parent], evidence[e.parent]) if e.parent >= 0 else (0, 0)
        holds = k in holders if anchor >= 0 else 2 * e.words > total
        if not holds and not (e.tag == "header" and inside):  # the header of an article is its own
            hits += e.hits + (0 if inside else e.header)
        article.append(inside or int(e.tag in ("article", "main")))
        evidence.append(hits)
    for b in row:
        if b.element >= 0:
            b.article, b.evidence = article[b.element], evidence[b.element]


def features(row: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in row], float)
    links = np.array([min(1.0, b.linked / b.words) for b in row])
    edge = np.zeros(1)
    own = np.array([(b.article, b.evidence, b.own, b.heading) for b in row], float)
    return np.column_stack([words, links, np.r_[edge, words[:-1]], np.r_[edge, links[:-1]], np.r_[words[1:], edge], np.r_[links[1:], edge], own])


class DecisionTree:
    """Binary tree with the splits of least Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.feature, self.cut, self.child, self.value = [], [], [], []
        self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.feature)
        self.feature.append(-1)
        self.cut.append(0.0)
        self.child.append((0, 0))
        self.value.append(float(y.mean()))
        best = None
        if depth and 0 < y.mean() < 1:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, t = x[order, f], y[order]
                n = np.arange(1, len(v))
                ones = np.cumsum(t)[:-1]
                left, right = ones / n, (t.sum() - ones) / (len(v) - n)
                loss = n * left * (1 - left) + (len(v) - n) * right * (1 - right)
                loss[v[1:] == v[:-1]] = np.inf
                if len(loss) and np.isfinite(loss.min()) and (best is None or loss.min() < best[0] - 1e-12):
                    k = int(loss.argmin())
                    best = (float(loss[k]), f, float(v[k] + v[k + 1]) / 2)
        if best and best[0] < len(y) * y.mean() * (1 - y.mean()) - 1e-12:
            _, f, cut = best
            low = x[:, f] < cut
            self.feature[me], self.cut[me] = f, cut
            a = self._grow(x[low], y[low], depth - 1)
            self.child[me] = (a, self._grow(x[~low], y[~low], depth - 1))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0 or not len(rows):
                out[rows] = self.value[node]
                continue
            low = x[rows, self.feature[node]] < self.cut[node]
            todo += [(self.child[node][0], rows[low]), (self.child[node][1], rows[~low])]
        return out


#: The labelled table: pages written for this purpose; blocks that begin with ``+`` are main text.
LABELLED = (
    """<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></nav><article><h1>+ River levels fall after a dry spring</h1>
    <p>+ The river has fallen to its lowest level since records began, and farmers along the valley have been asked to share what water is left.<p>+ No.<p>+ It was dry.</p>
    <p>+ Rain is not expected <a href=/w>this week</a>, the weather office said.</p><p>+ <a href=/full>The full report can be read here</a></p></article><footer>Copyright the valley paper, all rights reserved</footer></body>""",
    """<div class="cookie-notice"><p>This site uses cookies so that it can remember what you have chosen, and so that we can count visits. By staying here you accept them.</p><button>Accept</button></div>
    <div id=menu><a href=1>Start</a> <a href=2>Shop</a> <a href=3>Help</a></div><div id=content><h1>+ How to mend a chair</h1><p>+ Take the broken leg out of its hole and clean both of old glue with a sharp knife before anything else.</p>
    <p>+ Then wait.</p><p>+ Press the parts together, wipe away what comes out and leave the chair alone for a day or two until it has dried.</p></div>
    <div class=sidebar><h3>Popular</h3><p>Ten things that every workshop needs, from a good vice to a bad radio.</p><ul><li><a href=a>Vices compared</a><li><a href=b>Radios we like</a></ul></div>""",
    """<header><div>The Morning Post</div><p>News and opinion since the year the bridge was built</p></header><main><article><header><h1>+ Council votes</h1><p>+ By our reporter</p></header><p>+ After a long night the council has voted for the new road, by nine to eight.</p>
    <aside><p>Read also: what the road will cost the town and who is going to pay for it in the end</p></aside><div class="ad banner">Buy two tyres and get the third one at half the price, only this week at the garage.</div><p>+ Work begins in May.</p></article>
    <section id="comments"><h3>2 comments</h3><div class=comment><p>I have lived here for thirty years and nobody has ever asked me about any of this, which is a shame.</p></div><div class=comment><p>Good.</p></div></section></main>
    <form action=/subscribe><p>Leave your address and we send you the best of the week every Friday morning.</p><input name=m></form>""",
    """<table><tr><td><a href=1>index</a> | <a href=2>archive</a> | <a href=3>about</a></td></tr></table><p>+ This is a page from the old days, when nobody used any of the newer elements and everything was a paragraph or a table of some kind.</p>
    <p>+ It still works.</p><p>+ The machine was switched off last year, but its disk had been copied by then, and so the page lives on here.</p><hr><p><a href=1>index</a> <a href=2>archive</a></p><p><a href=m>mail</a></p>""",
    """<div class="top-bar nav"><span>Welcome</span></div><section><h2>+ Soup of the day</h2><ul><li>+ two onions</li><li>+ a litre of water</li></ul><p>+ Cook the onions in a little oil until they are soft, add the water and let it boil for twenty minutes.</p>
    <blockquote>+ Better the next day.</blockquote></section><div class="related-posts"><h4>You may also like</h4><p>A bread that needs no kneading and only a little patience from the cook</p></div><div class="share">Tell your friends about this recipe</div><footer><p>Written in the kitchen with love and with far too much salt, as always.</p></footer>""",
    """<div class="wrap"><p class="notice">The shop is closed from the first to the tenth of the month while we count what is on the shelves.</p><article><p>+ Short one.</p><p>+ A longer paragraph stands between two short ones so that all of them are read as one text by anyone who comes.</p><p>+ End.</p><h2>+ A part</h2>
    <p>+ <a href=x>Only a link</a></p><div class="comments"><p>First!</p><p>A reader has written a long remark under the article, and it has nothing at all to do with what stands above it.</p></div></article></div>""",
    "<p>+ All that this page has to say stands in one paragraph, so nothing comes before it and nothing comes after it.</p>",
    "<h1>+ A plain page</h1><p>+ It begins with its title.</p><p>+ Then it ends, and <a href=c>a link</a> leads on to the next one in the row.</p><div><a href=1>first</a> / <a href=2>last</a></div>",
    "<div>+ Words.</div>",
    """<article class="post comments-open has-sidebar"><h1>+ Night trains return</h1><p class="share-price">+ The price of a share in the company that runs the trains rose by a tenth on the day after the news came out.</p>
    <p class="ad-free">+ Four lines will run again from the spring, and more are to follow when enough sleeping cars have been built.</p><p>+ So be it.</p><p class="share">Share this</p><p class="tags">+ Filed from the capital by our own reporter</p></article>
    <ul><li class="comment"><p>I took that train when I was a child and I would take it again tomorrow if only they let me.</p></li><li class="comment">At last.</li></ul><table><tr><td class="sidebar">Our ten best journeys by rail, by boat and on foot</td></tr></table><h3 class="related">More on this</h3>""",
    """<form id="aspnetForm" class="search"><div class="wrap no-nav"><div>Home</div><div>About us</div><div>Contact</div><div>+ The museum opened its doors in the year of the great flood, and it has not been closed for a single day since then.</div>
    <div>+ It is worth a visit.</div><div>+ Among the things to be seen there are a boat that was found under the market square and the bell of the old town hall.</div><div>+ Both are old.</div><div>+ Children come in free, and so does everybody who was born in the town, if they can show a paper that says so.</div><div>+ Really.</div><div>+ The tower is closed in winter, and nobody has ever been able to say why that should be, as there is no snow.</div><div>Terms</div><div>Privacy</div><div>Imprint</div></div></form>""",
    """<div class="layout with-sidebar"><div>Products</div><div>Prices</div><div>Sign in</div><div>+ We have moved the whole of the archive to a new machine, which took three nights and a good deal of coffee to get done.</div><div>+ Nothing was lost.</div>
    <div>+ If a page that you look for is not there any more, please write to us and we will look for it in the copies that we have kept.</div><div><a href=1>Older</a></div><div><a href=2>Newer</a></div><div>All rights reserved</div><div>Made in the north</div></div>""",
    """<div><p>Weather</p><p>Traffic</p><p>Lottery</p></div><div><p>+ A bear has been seen near the edge of the wood, and walkers have been told to keep their dogs on a lead until it has gone.</p><p>+ It looked well fed.</p><p>+ The last bear was seen here forty years ago, and nobody who saw it then is sure that it was one.</p></div>
    <div><p><a href=1>Two lost dogs found again after a week in the hills above the village</a></p><p><a href=2>What to do when you meet a bear and have nothing to give it</a></p><p><a href=3>The forty years without a bear, told by those who missed it</a></p></div><div><p>Contact</p><p>Help</p></div>""",
    """<main><article><h1>+ A new bridge</h1><p>+ The bridge was opened on Sunday.</p><ul><li>+ Length: nine hundred metres</li><li>+ Height: sixty metres</li></ul><p>+ <a href=p>Pictures of the opening</a></p><p>+ See also <a href=q>the old bridge</a>.</p>
    <ul><li><a href=1>The mayor resigns</a></li><li><a href=2>Ferry sold abroad</a></li><li><a href=3>Tolls to rise</a></li></ul></article></main><div><p>Subscribe now and read everything that we write for one month without paying for it.</p></div>""",
    """<nav><a href=1>Home</a><div>A paper for the valley and the hills</div></nav><div class="ad">Fly to the sun for less.</div><article><h1>+ Chess in the park</h1><p>+ One.<p>+ Two to one.<p>+ A draw.</p><p>+ He won.</p><p>+ They shook hands.</p><p>+ Nobody spoke.</p><p>+ It rained.</p><p>+ Then.</p><p>+ Check.</p><p>+ No way out was left for the queen.</p><p>+ Mate.</p>
    <p>+ So the oldest player of the club has won the summer cup for the third time in a row, and he is eighty years of age.</p><p>+ Well played!</p></article><div class="promo">Boards and clocks at half the price until the end of the week, in our shop beside the station.</div><footer><p>Chess every Sunday, rain or shine, since the park was laid out.</p><div>Imprint</div></footer>""",
    """<div class="banner">Win a week by the lake.</div><div class="breadcrumbs"><span>Home</span> / <span>Garden</span></div><main><p>+ Sow early.</p><p>+ Beans want warm ground, so wait until the cold nights are over before you put them out.</p><p>+ Water.</p><p>+ Wait.</p><p>+ Pick.</p></main><div class="related"><p>Peas do well in cool summers, but they want a fence.</p><p>Roses.</p></div>
    <div class="widget">Today the sun rises at six and sets at eight.</div><div class="newsletter">Every week one good idea for the garden, by mail.</div><section class="comments"><p>My beans never came up at all, and I had put them where you said.</p><p>Mine did.</p><p>Thanks for this, it was a great help to us when we began.</p></section><aside>Slugs do not like coffee</aside><form><label>Search the garden</label><p>Ask our gardener what you want to know, and you will hear from her within a week.</p></form>""",
    """<header><p>The oldest weekly of the coast</p></header><div class="notice">We were down for an hour on Monday because a digger had cut the cable in front of the house.</div><div id="menu"><p>Boats</p><p>Nets</p></div><article><h1>+ Herring</h1><p>+ <b>Herring is back.</b></p><p>+ The boats came home full.</p><h2>+ Why</h2><p>+ The water is colder than last year, the young fish were left alone, and the big ships have stayed away.</p><p>+ Good.</p></article><div class="social">Follow us</div><footer><div>Write to the editor if you know better than we do</div></footer>""",
    """<div>Start</div><div>Shop</div><article><h1>+ Rain</h1><p>+ Drip.</p><p>+ Drop.</p><p>+ It fell on the roof and on the road and on the heads of all who had not thought of taking a hat.</p><p>+ Drip.</p><p>+ Drop.</p><p>+ Then it stopped.</p><p>+ Silence.</p></article><div>Top</div><div>Contact</div><div>We answer all letters that reach us, but it may take us a week or two to do so.</div>""",
    """<div>Poems</div><article><h2>+ Snow</h2><p>+ White.</p></article><article><h2>+ Fog</h2><p>+ Grey.</p><p>+ Grey again.</p></article><div>Next</div><div>Back</div><p>+ These two are the shortest poems that we have ever printed, and they are also the ones that most of you have asked us to print again.</p><div>Index</div>""",
    """<div>Menu</div><main><h1>+ Opening hours</h1><p>+ Monday</p><p>+ Closed</p><p>+ Tuesday</p><p>+ Nine to five</p><p>+ Sunday</p><p>+ Closed</p></main><div>Print</div><div>Share</div>""",
)


def labelled(page: str) -> list[Block]:
    """Blocks of a labelled page; the mark is no word of the text."""
    row = blocks(page)
    for b in row:
        b.words -= b.text.startswith("+")
    return row


def table_of_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all labelled blocks."""
    rows = [labelled(page) for page in LABELLED]
    return np.concatenate([features(row) for row in rows]), np.array([b.text.startswith("+") for row in rows for b in row], float)


def trained() -> DecisionTree:
    return DecisionTree(*table_of_blocks())


def main_text(page: str, tree: DecisionTree) -> str:
    row = blocks(page)
    if not row:
        return ""
    keep = tree.predict(features(row)) >= 0.5
    return "\n".join(b.text for b, k in zip(row, keep) if k)


def extract(pages: DataFrame, page: str = "html", carry: tuple[str, ...] = ("page_id", "url"), tree: DecisionTree | None = None) -> DataFrame:
    """Carried columns, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(tree or trained())
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Batches) -> Batches:
        tree = shared.value
        for batch in batches:
            texts = [main_text(p.as_py() or "", tree) for p in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carry, "text", "n_chars"])

    return map_arrow(pages.select(*carry, page), run, f"{kinds}, text string, n_chars long")


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
