"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block from its own figures:
markup that names its role (navigation, footers, adverts, comments), link density, length and stop-word
density. Short or middling blocks stay undecided; the second pass gives them the label of the nearest
decided neighbour, within their article if they have one.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import map_batches, texts_in

LINK_DENSITY, SHORT, DENSE, SPARSE = 0.5, 70, 0.25, 0.12
#: Of the text outside decided markup, the share that article or main must hold to stand for the page.
ARTICLE_SHARE = 0.2

STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was we were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind und von vor war wie wird zu zum zur "
    "al como con del el ella ellos era esta este fue ha las lo los más me mi muy no nos o para pero por porque sin sobre su sus también te tiene una uno y ya".split()
)
#: Those of more languages, for pages with few of the above.
MORE_STOP_WORDS = STOP_WORDS | frozenset(
    "che di è gli i per più si sono una uno alla della delle nel anche come ma questo ao aos às com da das do dos ele em foi isso mais não os pela pelo são seu sua também um uma "
    "de een en het ik is maar met niet of ook op te van voor werd zijn aan dat die dit door er hij wordt att av den det ett för från har inte jag med och om på som till är var ikke og være "
    "ale do i jak jest na nie o od po się to w z za że był była było przez dla oraz a je jako když se že v ve "
    "в во и на не с со что он она они это как по из за к у о от для но а то бы же его её их был была было при так или мы вы я до также та і що як з у є "
    "bir bu da de gibi için ile ise çok daha en her kadar ki ne o olan olarak sonra var ve veya".split()
)
#: Their languages inflect more and have fewer of them: what counts as dense and sparse there.
MORE_DENSE, MORE_SPARSE = 0.12, 0.04
#: Elements whose content is never shown as text.
HIDDEN = frozenset("script style noscript template textarea svg math iframe object canvas audio video select option datalist head title button".split())
RAW = frozenset("script style noscript template textarea iframe title svg".split())
#: Of these, those that hide nothing but their own tag if they have no end tag.
MAY_STAY_OPEN = frozenset("svg template noscript".split())
#: Elements that may stand in a head; any other one ends it, as `</head>` may be left out.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript object script style template title".split())
#: Elements that hold furniture of the page.
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark furniture.
ROLES = frozenset(
    "ad adbox ads adsbygoogle adslot adunit adv advert advertisement advertising advertorial adverts alert announcement banner breadcrumb breadcrumbs byline comment commentlist comments complementary consent contentinfo "
    "cookie cookiebar cookies copyright disclaimer discussion disqus dropdown feedback foot footer form forms gdpr hidden legal login mainmenu masthead menu menubar menus metadata modal nav navbar navigation newsletter "
    "notice notices notification notifications pager pagination popup promo promoted promotion rail recommended related replies reply respond responses search share sharing sidebar sidebars sidenav signup skip social "
    "sponsor sponsored submenu subscribe subscription tags teaser toc toolbar topbar topnav widget widgets".split()
)
#: The same, but for containers within an article or named after one (`entry-header`).
PAGE_ROLES = frozenset("header headers side aside".split())
CONTENT = frozenset("article content entry main post section story".split())
#: Of the words above, those that pages use for their subject as well, and those that name a part of the layout.
COMMON = frozenset("ad alert copyright form hidden legal rail search social tags".split())
LAYOUT = frozenset("hidden menu nav navigation rail sidebar sidebars search social toc".split())
#: Words of containers, which leave the meaning of a name to its other words.
BOXES = frozenset("area bar block bottom box btn button buttons col column container fixed floating global group header icon icons inner item items js left link links list main media mobile module outer page panel primary right row secondary section site sticky text title top unit web wrap wrapper".split())
DOUBTED, SURE = 1, 2
#: Class names that begin so say what a container has, not what it is (`with-sidebar`).
ABOUT = frozenset("has with no not is without show hide enable disable".split())
TAG = re.compile(r"""<(?:!--(?P<comment>)|[!?][^>]*>|(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:_-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>)""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@dataclass
class Block:
    text: str
    links: int
    furniture: bool
    article: int  # the number of the article it lies in, or 0
    tag: str = ""
    good: bool | None = field(default=None)


def _names_furniture(parts: list[str], article: int) -> int:
    """What the parts of a class name, id or role say: ``DOUBTED`` where what they name may hold the article as well."""
    if parts[0] in ABOUT:
        return 0
    roles = [x for x in parts if x in ROLES]
    if roles:
        if all(x in COMMON for x in roles) and parts[-1] not in COMMON and not all(x in ROLES or x in PAGE_ROLES or x in CONTENT or x in BOXES or x.isdigit() or not x for x in parts):
            return 0  # `social-science`, `news-search-engine`: a word of the subject, where `contact-form` is a form
        return DOUBTED if all(x in LAYOUT for x in roles) else SURE
    if not article and not PAGE_ROLES.isdisjoint(parts) and CONTENT.isdisjoint(parts):
        return DOUBTED
    return 0


def _marked(rest: str, article: int = 0) -> int:
    """Whether the attributes name furniture or hide the element: 0, ``DOUBTED`` or ``SURE``."""
    found = 0
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return SURE
        else:
            found = max([found, *(_names_furniture(re.split(r"[^a-z0-9]+", x), article) for x in value.split())])
    return found


def blocks(page: str, hints: bool = True) -> list[Block]:
    """The blocks of a page in order, with white space collapsed and character references decoded.

    ``hints``: whether class, id and role of an element may mark it as furniture.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, hidden, furniture (0 no, DOUBTED, SURE), article
    hidden, furniture, article, articles = False, 0, 0, 0
    pieces: list[str] = []
    links, link_depth, breaks = 0, 0, 0
    endless: set[str] = set()  # names without an end tag from here on

    def end_block():
        nonlocal links, breaks
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, links, bool(furniture), article, stack[-1][0] if stack else ""))
        pieces.clear()
        links, breaks = 0, 0

    def add(raw: str):
        nonlocal links, breaks
        if hidden or not raw:
            return
        text = html.unescape(raw)
        pieces.append(text)
        if not text.isspace():
            breaks = 0
            if link_depth:
                links += len(" ".join(text.split()))

    def close(index: int):
        nonlocal hidden, furniture, article, link_depth
        end_block()
        del stack[index:]
        _, hidden, furniture, article = stack[-1] if stack else ("", False, 0, 0)
        link_depth = 0

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m["comment"] is not None:
            stop = page.find("-->", at)
            at = end if stop < 0 else stop + 3
            continue
        if not m["name"]:
            continue
        name, rest = m["name"].lower(), m["rest"] or ""
        if m["end"]:
            if name == "a":
                link_depth = max(0, link_depth - 1)
            elif name == "p" and not any(x[0] == "p" for x in stack):
                end_block()
            elif name not in INLINE or any(x[0] == name for x in stack):
                index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
                if index >= 0:
                    close(index)
            continue
        if name not in IN_HEAD and (index := next((i for i, x in enumerate(stack) if x[0] == "head"), -1)) >= 0 and not any(x[0] == "object" for x in stack[index:]):
            close(index)
        if name in RAW:
            if name == "svg" and rest.endswith("/") or name in endless:
                continue
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if not stop and name in MAY_STAY_OPEN:
                endless.add(name)
                continue
            at = stop.end() if stop else end
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                end_block()
            else:
                pieces.append(" ")
            continue
        if name == "hr":
            end_block()
        if name in VOID or rest.endswith("/") and name not in ARTICLE:
            continue
        if name == "a":
            link_depth = 1
        if name in INLINE and not (hints and rest and _marked(rest, article)):
            continue
        if name == "body":
            continue
        if name not in INLINE:  # an open paragraph or item ends where the next block begins
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close(len(stack) - 1)
            else:
                end_block()
        else:
            end_block()
        if name in ARTICLE and not article:
            articles += 1
            article = articles
        marked = SURE if name in FURNITURE or name == "header" and not article else _marked(rest, article) if name not in ARTICLE and name != "html" and hints and rest else 0
        if name in ARTICLE and furniture == DOUBTED:  # a container's name may say what else it holds
            furniture = 0
        hidden, furniture = hidden or name in HIDDEN, max(furniture, marked)
        stack.append((name, hidden, furniture, article))
    end_block()
    return out


def _density(words: list[str], known: frozenset[str]) -> float:
    return sum(w.strip(".,;:!?\"'()") in known for w in words) / max(1, len(words))


def _language(plain: list[Block]) -> tuple[frozenset[str], float, float] | None:
    """Stop words to judge a page by, with the densities of main text and of other text; None if hardly any are known."""
    words = [w for b in plain if _width(b.text) >= SHORT for w in b.text.lower().split()]
    if _density(words, STOP_WORDS) >= SPARSE:
        return STOP_WORDS, DENSE, SPARSE
    return (MORE_STOP_WORDS, MORE_DENSE, MORE_SPARSE) if _density(words, MORE_STOP_WORDS) >= MORE_DENSE else None


def _width(text: str) -> int:
    """Length, with East Asian characters counted twice: they say more than a letter."""
    return len(text) if text.isascii() else len(text) + sum(c >= "\u2e80" for c in text)


def classify(found: list[Block]) -> list[Block]:
    """Decide each block: own figures first, then the nearest decided neighbour."""
    plain = [b for b in found if not b.furniture and b.links <= LINK_DENSITY * len(b.text)]
    inside = sum(len(b.text) for b in plain if b.article)
    by_article = inside >= ARTICLE_SHARE * sum(len(b.text) for b in plain) and inside > 0
    language = _language(plain)
    for b in found:
        size = len(b.text)
        if b.furniture or by_article and not b.article:
            b.good = False
        elif b.links > LINK_DENSITY * size:
            # a paragraph of an article that is a link but reads like prose is left to its neighbours
            prose = b.article and b.tag == "p" and size >= SHORT and _density(b.text.lower().split(), (language or (STOP_WORDS,))[0]) >= (language or (0, DENSE))[1]
            b.good = None if prose else False
        elif language is None and not b.article:  # in an unknown language, length and links decide
            if _width(b.text) >= SHORT:
                b.good = True
        elif size >= SHORT:
            known, dense, sparse = language or (STOP_WORDS, DENSE, SPARSE)
            density = _density(b.text.lower().split(), known)
            if density >= (sparse if b.article else dense):
                b.good = True
            elif density < sparse and not b.article:  # in an article, code and tables go with their neighbours
                b.good = False
    _inherit(found)
    return found


def _inherit(found: list[Block]) -> None:
    """Undecided blocks get the label of the nearest decided one of their article; a tie goes to the main text."""
    near: list[list[tuple[int, bool]]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}  # by article: where the last decided block was, and its label
        for i in order:
            b = found[i]
            if b.good is None and b.article in last:
                at, label = last[b.article]
                near[i].append((abs(i - at), not label))
            elif b.good is not None and not b.furniture:
                last[b.article] = (i, b.good)
    for b, labels in zip(found, near):
        if b.good is None:
            b.good = not min(labels)[1] if labels else bool(b.article)


def main_text(page: str) -> str:
    """The main text; if class names have marked all of a page as furniture, they are not believed."""
    good = [b.text for b in classify(blocks(page)) if b.good]
    return "\n".join(good or [b.text for b in classify(blocks(page, hints=False)) if b.good])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``id_col``, ``url_col``, text, n_chars) for every row; a null or empty page has an empty text.

    Rows are independent: repeated rows give repeated results, ties cannot arise, other columns are
    ignored, and an empty table gives no rows. Malformed, truncated and very long pages are read whole.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.decode("utf-8", "replace")) for x in texts_in(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return map_batches(pages.select(id_col, url_col, F.col(html_col).cast("binary")), run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
