"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page becomes a list of text blocks. A small classifier gives each the cost of calling it content or
boilerplate; these costs are the capacities to the two terminals. Neighbours in page order and blocks of
one container are tied by smoothness edges. The minimum cut is the cheapest labelling of all blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import table

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "script style noscript template head title svg math iframe object audio video canvas select option "
    "textarea button label datalist map frameset noframes".split()
)
RAW = frozenset("script style noscript template textarea title iframe noframes svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr input".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("div section main article td body span".split())
# Words in tags, classes, ids and roles that tell a container's part.
BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment "
    "comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr header login "
    "masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager "
    "pagination paywall popup promo promoted recommended related replies reply respond rss search share "
    "sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tagcloud toolbar "
    "topbar trackback widget".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main maintext post prose story text".split())

# Of these, words that never name a wrapper around a whole page.
FIRM_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising comment comments consent cookie cookies copyright disqus gdpr "
    "newsletter notice replies reply respond sponsored trackback".split()
)
# Words that make a class of a section tell what the page has, not what the section is ("has-sidebar").
STATE_WORDS = frozenset("has with without no not open closed enabled disabled layout".split())
# What the hints of a block mean.
CONTENT, NEITHER, BOILER, SILENCE, FORM, NAMED_BOILER = 1, 0, -1, -2, -3, -4

SPECIAL = re.compile("[\"'>]")
BROKEN = re.compile("[^<>]*>?")
OPENED = re.compile("[a-zA-Z][^\\s/>]*")
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_ENDS = {tag: re.compile("</" + tag, re.I | re.A) for tag in sorted(RAW)}
ITEMS = ("dt", "dd", "li", "td", "th")
# Open elements that the start of another one ends.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


def container(tag: str, attributes: str, inside_content: bool) -> int:
    """What kind of container an element opens: one of the hints above.

    Every word of class, id and role counts as a whole: it names boilerplate if a part of it does, content
    if none does but a part names content. Words of both kinds leave the element to its text.
    """
    if tag in SILENT:
        return SILENCE
    words, hidden = [], False
    if attributes:
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                words += [{w.lower() for w in PIECES.findall(x)} for x in value.split()]
            elif name == "style":
                hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            else:
                hidden |= value.lower() != "false" if name == "aria-hidden" else name == "hidden"
    if tag in ("html", "body"):
        return NEITHER
    if hidden:
        return SILENCE
    if tag in BOILER_TAGS or tag == "header" and not inside_content:
        return BOILER
    if tag in CONTENT_TAGS:
        return CONTENT
    if tag in SECTIONS:
        words = [w for w in words if not w & STATE_WORDS]
    boiler = any(w & BOILER_WORDS for w in words)
    content = tag in SECTIONS and any(w & CONTENT_WORDS and not w & BOILER_WORDS for w in words)
    if boiler or content:
        firm = any(w & FIRM_WORDS for w in words)
        return NEITHER if boiler and content else BOILER if firm else NAMED_BOILER if boiler else CONTENT
    return FORM if tag == "form" else NEITHER


def markup(page: str):
    """Pieces of a page in order: (text before, closing, tag, attributes, end); tag is None for what is no element.

    One forward pass: a tag ends at the first `>` outside quotes; places from which no tag ends are kept,
    so that no stretch of a page is searched over and over. Such a tag reaches to the next `<` or `>`.
    The caller may send the place where to go on.
    """
    last = {c: page.rfind(c) for c in "\"'>"}
    hopeless, special, at, text_from = set(), (0, -1), 0, 0
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= len(page):
            yield page[text_from:], "", None, "", len(page)
            return
        if page.startswith("<!--", at):
            ends = [x + n for x, n in ((page.find("-->", at + 4), 3), (page.find("--!>", at + 4), 4)) if x >= 0] if last[">"] > at else []
            end = min(ends, default=len(page))
            yield page[text_from:at], "", None, "", end
            at = text_from = end
            continue
        closing = page[at + 1] == "/"
        name = OPENED.match(page, at + 1 + closing)
        end = -1
        if name:
            place, tried = name.end(), []
            while place not in hopeless and place <= last[">"]:
                if not special[0] <= place <= special[1]:
                    special = (place, SPECIAL.search(page, place).start())
                mark = special[1]
                if page[mark] == ">":
                    end = mark + 1
                    break
                tried.append(place)
                if mark + 1 > last[page[mark]]:
                    break
                place = page.find(page[mark], mark + 1) + 1
            if end < 0:
                hopeless.update(tried)
        if end >= 0:
            go = yield page[text_from:at], "/" if closing else "", name.group().lower(), page[name.end() : end - 1], end
            at = text_from = end if go is None else go
            if go is not None:
                yield None
        elif closing or page[at + 1] in "!?":
            end = page.find(">", at) + 1 if last[">"] > at else len(page)
            yield page[text_from:at], "", None, "", end
            at = text_from = end
        elif name:
            end = BROKEN.match(page, at + 1).end()
            yield page[text_from:at], "", None, "", end
            at = text_from = end
        else:
            at += 1


def blocks_of(page: str) -> list[tuple[str, str, int, int, int]]:
    """Text blocks in page order: (text, tag, hint, container number, characters within links).

    Character references are decoded, white space becomes one space, blocks without text are left out.
    The hint is that of the innermost container that has one. Unclosed elements end with their parent,
    a paragraph or list item also where the next one starts; a tag cut off by the end of the page is no text.
    Time is in proportion to the page: places of open elements are kept by name.
    """
    from html import unescape

    blocks, stack, held, linked, count = [], [], [], 0, 0
    places, solid, walls = {}, [], []  # where in the stack: each name, elements not inline, those that no start tag ends

    def topmost(names):
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def leave(depth):
        while len(stack) > depth:
            i = len(stack) - 1
            places[stack.pop()[0]].pop()
            for kept in (solid, walls):
                if kept and kept[-1] == i:
                    kept.pop()

    def close():
        nonlocal held, linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                tag, _, number, _ = stack[solid[-1]] if solid else ("", 0, 0, 0)
                around = stack[-2][2] if len(stack) > 1 and tag in ("p", "li", *HEADINGS) else number
                blocks.append((text, tag, stack[-1][1] if stack else NEITHER, around, linked))
        held, linked = [], 0

    pieces = markup(page)
    for text, closing, tag, attributes, at in pieces:
        if text and not (stack and stack[-1][1] == SILENCE):
            held.append(text)
            if any(x[0] == "a" for x in stack[-4:]):
                linked += len(text)
        if tag is None:
            continue
        if tag not in INLINE:
            close()
        elif tag == "br":
            held.append(" ")
        if closing:
            i = topmost((tag,))
            if i >= 0 and (tag not in INLINE or not solid or i > solid[-1]):  # an inline end tag closes no block
                leave(i)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in RAW:
            continue
        if tag not in INLINE:
            same = ENDED_BY.get(tag, ())
            wall = walls[-1] if walls else -1
            if same:
                wall = max(wall, topmost([n for n in ("li", "td", "th") if n not in same]))
            i = topmost(("p", *same))
            if i >= 0 and i >= wall:
                leave(i)
        outer = stack[-1][1] if stack else NEITHER
        content = stack[-1][3] if stack else False
        hint = container(tag, attributes, content)
        if outer == SILENCE or hint == FORM and outer in (BOILER, NAMED_BOILER):
            hint = outer
        count += 1
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            solid.append(len(stack))
            if tag not in ITEMS and tag != "p":
                walls.append(len(stack))
        stack.append((tag, hint or outer, count, hint == CONTENT or content and hint >= 0))
        if tag in RAW:
            over = RAW_ENDS[tag].search(page, at)
            pieces.send(over.start() if over else len(page))
    close()
    return blocks


def margin(text: str, tag: str, hint: int, linked: int) -> int:
    """How much cheaper it is to call a block content than boilerplate, in hundredths."""
    return plain_margin(text, tag, linked) + (900 if hint == CONTENT else -1200 if hint in (BOILER, NAMED_BOILER) else 0)


def plain_margin(text: str, tag: str, linked: int) -> int:
    """The margin by the text alone: its length, its end, its links."""
    words = text.count(" ") + 1
    score = 90 * min(words, 60).bit_length() - 250
    if text[-1] in ".!?…。":
        score += 100
    if linked * 2 > len(text):
        score -= 400
    if "©" in text or "all rights reserved" in text.lower():
        score -= 400
    if tag in HEADINGS:
        score += 200
    return score


def form_cost(blocks) -> int:
    """What a block within a form pays to be content: 1200, and nothing where forms hold half of the prose.

    Prose are the words of blocks outside of boilerplate that pass for content by their text.
    """
    words = {True: 0, False: 0}
    for text, tag, hint, _, linked in blocks:
        if hint in (CONTENT, NEITHER, FORM) and plain_margin(text, tag, linked) > 0:
            words[hint == FORM] += text.count(" ") + 1
    return 1200 * max(0, words[False] - words[True]) // max(1, words[True] + words[False]) if any(words.values()) else 1200


def smoothness(blocks) -> list[tuple[int, int, int]]:
    """Edges (i, j, weight): neighbours in page order, and the last block of the same container."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        same = last.get(block[3])
        if i:
            edges.append((i - 1, i, 200 if same == i - 1 else 60))
        if same is not None and same != i - 1:
            edges.append((same, i, 100))
        last[block[3]] = i
    return edges


def minimum_cut(margins: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least total cost: a negative margin pays to be True, a positive one to be False, and
    each edge between unequal labels pays its weight. Ties are False.

    A node whose margin outweighs all its edges is settled at once and its edges move to the margins of
    its neighbours; what is left is cut by maximum flow over shortest augmenting paths.
    """
    n = len(margins)
    margins, near = list(margins), [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(margins[i]) >= sum(near[i].values()) and (margins[i] or not near[i]):
            label[i] = margins[i] > 0
            for j, w in near[i].items():
                margins[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    source, sink = n, n + 1
    room = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        if margins[i] > 0:
            room[source][i], room[i][source] = margins[i], 0
        elif margins[i] < 0:
            room[i][sink], room[sink][i] = -margins[i], 0
    while True:
        level, front = {source: 0}, [source]
        while front and sink not in level:
            onward = []
            for a in front:
                for b, w in room[a].items():
                    if w > 0 and b not in level:
                        level[b] = level[a] + 1
                        onward.append(b)
            front = onward
        if sink not in level:
            for i in rest:
                label[i] = i in level
            return label
        ways = {a: iter(list(room[a])) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                steps = list(zip(path, path[1:]))
                flow = min(room[x][y] for x, y in steps)
                for x, y in steps:
                    room[x][y] -= flow
                    room[y][x] = room[y].get(x, 0) + flow
                full = next(k for k, (x, y) in enumerate(steps) if not room[x][y])
                del path[full + 1 :]
                continue
            for b in ways[a]:
                if room[a][b] > 0 and level.get(b, -1) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()


def labelled(page: str) -> list[tuple[str, bool]]:
    """The blocks of a page and whether each is content.

    Where class names of boilerplate leave no content at all, they are worth nothing and the text decides;
    elements that name their part (menus, footers, asides), comments, adverts and notices stay what they are.
    """
    blocks = blocks_of(page)
    forms, edges = form_cost(blocks), smoothness(blocks)
    margins = [margin(text, tag, hint, linked) - forms * (hint == FORM) for text, tag, hint, _, linked in blocks]
    label = minimum_cut(margins, edges)
    if NAMED_BOILER in (b[2] for b in blocks) and not any(label):
        margins = [m + 1200 * (b[2] == NAMED_BOILER) for m, b in zip(margins, blocks)]
        label = minimum_cut(margins, edges)
    return [(b[0], bool(x)) for b, x in zip(blocks, label)]


def _label(batches):
    import pyarrow as pa

    run = labelled
    kind = pa.list_(pa.struct([("text", pa.string()), ("content", pa.bool_())]))
    for batch in batches:
        got = [[{"text": t, "content": c} for t, c in run(x or "")] for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, kind)], ["page_id", "url", "blocks"])


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url and blocks (text, content) of every row, in page order.

    Null html is empty and has no blocks. Repeated rows are all returned; other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string")
    )
    return rows.mapInArrow(_label, "page_id long, url string, blocks array<struct<text:string,content:boolean>>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the content blocks joined by line ends, empty if there are none."""
    kept = F.filter("blocks", lambda b: b["content"])
    return page_blocks(pages).select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
