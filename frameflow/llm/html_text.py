"""Main text of web pages by two-pass block rules.

A page is read into blocks: runs of text between block-level tags. First pass, each block by itself: blocks in boilerplate
containers (by tag, role, or class and id) and blocks that are mostly links are bad; long blocks dense in stop words, and long ones of sentences in a
language without a stop-word list, are good; the others, mostly short ones, are undecided. Second pass: an undecided block takes the label of the
nearest decided block, looked for in its own section first, then in the section around that one, and so on (on a tie good wins); a heading
goes with the block after it. Where a page marks its article or main part, undecided blocks inside that have no decided one beside them are good and those outside are bad.

Classes and ids are only names: `has-sidebar` or `notice-board` on the wrapper of a page says nothing. So a name counts
where all of its parts are words for boilerplate or for its layout, and a container that is bad by name alone is taken back where it holds the heading and
more text of the first pass than all the rest of the page, or where the page has no main text without it. Names of reader comments count wherever one of their parts says so
(`user-comments`, `comment-body`), but for those that tell a state (`comments-open`, `no-comments`); as comments follow what they are about, such a container is taken back where it holds
the page's top heading or where no main text stands before it, and one named for a discussion or for responses also where it begins with a plain heading, like a part of an article.
Containers are judged from the outermost in: one inside a container that was taken back is judged again by itself.

Defined results: a null or empty page and a page without main text give an empty text; rows with equal ids stay rows of
their own; broken markup is read to its end; extra columns are not read.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_rows

#: Stop words of English, German, French and Spanish.
STOP = frozenset("""
a about all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its more my no not of on
or other our out she so some than that the their them then there they this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die dir doch du ein eine einem einen einer eines er es für hat ich ihr im ist ja kann
man mich mir mit nach nicht noch nur oder schon sein sich sie sind so über um und uns von vor war was wie wir zu zum zur
alors au aux avec ce cette ces dans de des du elle en est et eux il ils je la le les leur lui mais même mes ne nos notre nous on ou où par pas plus pour qu
que qui sa se ses son sont sur un une vous
al algo como con cuando de del desde donde el ella ellos en entre era es esta este fue ha hay la las lo los me mi muy nada ni no nos o para pero por porque
que se ser si sin sobre son su sus también te tiene todo tu un una uno y ya yo
""".split())
#: What tags mean.
BLOCK = frozenset("""address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
RAW = frozenset("script style textarea template iframe noembed noframes object svg math audio video canvas xmp title".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog button select datalist fieldset head noscript search".split())
#: Parts of class names and ids that mean boilerplate, and parts that may stand beside them without changing that.
BAD_PARTS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions banner banners sidebar sidebars sidenav nav navbar navigation menu menus
breadcrumb breadcrumbs footer masthead topbar comment comments respond disqus reply replies cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay newsletter newsletters subscribe subscription signup login
share sharing social related advertorial bio bios recommended recommendations widget widgets toolbar pagination pager outbrain taboola skiplink""".split())
LAYOUT_PARTS = frozenset("""a b x y s m l xs sm md lg xl top bottom left right first last main primary secondary global site page inner outer wrap wrapper container box block bar list lists area section zone region row col column columns item items group holder panel module
unit slot link links icons buttons posts articles stories header form mobile desktop fixed sticky js clearfix on the by id feed thread text count title toggle bottombar author authors about""".split())
#: Parts of names that mean reader comments, those that may mean a part of an article too, and those that make a name tell a state.
COMMENT_PARTS = frozenset("comment comments commenter commenters commentlist commentbox commentary respond disqus reply replies livefyre".split()) - {"commentary"}
TALK_PARTS = frozenset("discussion discussions responses feedback".split())
STATE_PARTS = frozenset("open opened closed off no non has have with without hide hidden show enabled disabled allow allowed count counts number status".split())
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
BAD_ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu|menubar|toolbar)\b", re.I)
NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\s(?:hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
#: A tag ends at the first > outside quotes, or with the page. Where a quote is never closed, the tag and all after it end at the first >.
#: Either way each search goes on where the last one ended, so that reading is linear in the page.
PIECE = re.compile(OTHER + r"<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|(?=([\"'])))", re.S)
PLAIN = re.compile(OTHER + r"<(/?)([a-zA-Z][\w:-]*+)([^>]*+)(?:>|\Z)", re.S)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")

#: Characters of scripts without spaces, each about three of others; marks that end sentences.
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0eff]")
STOPS = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4\u1362](?=[\s\"'\u201d\u00bb\u300d)]|$)|[\u3002\uff01\uff1f]")
LEGAL = re.compile(r"\u00a9|\(c\)\s*\d|all rights reserved", re.I)

LINKS, LONG, DENSE = 0.5, 60, 0.1
#: A page below this share of known stop words is in a language without a list.
UNKNOWN = 0.05
#: Sections within each other; deeper ones count as that one.
DEEP = 200
INLINE = ("span", "label", "b", "i", "em", "strong", "ins")


class Block:
    """bad: in a boilerplate container; flag: the innermost container around it that is bad by name, or 0; section: its innermost one; article: number or 0; para: a paragraph."""

    __slots__ = ("article", "bad", "dense", "flag", "head", "linked", "para", "section", "size", "text", "words")

    def __init__(self, text: str, linked: int, bad: bool, flag: int, article: int, head: int, section: int, para: bool):
        self.text, self.linked, self.bad, self.flag, self.article, self.head, self.section, self.para = text, linked, bad, flag, article, head, section, para
        words = WORD.findall(text.lower())
        self.words, self.dense = len(words), sum(w in STOP for w in words)
        self.size = len(text) + (2 * len(WIDE.findall(text)) if not text.isascii() else 0)

    def label(self, known: bool) -> bool | None:
        """The first pass: good, bad or undecided. known: the page's language has stop words here."""
        if self.linked > LINKS * len(self.text):
            return None if self.head or self.article and (self.para or self.size < LONG) else False
        if self.head:
            return None
        if self.size < LONG:
            return None
        if self.dense >= DENSE * self.words and self.dense:
            return True
        return True if not known and STOPS.search(self.text) else None


class Page:
    """Blocks of a page in order, and for each section the one around it and the blocks from its first to its last. flags: for each container that is bad by name its kind,
    the one around it and the article that it stands in."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parent, self.first, self.last = [0], [0], [0]
        self.flags: list[tuple[str, int, int]] = [("", 0, 0)]


def named(rest: str) -> str:
    """What a tag's class and id say: comments, talk (comments or a part of an article), name (other boilerplate) or nothing."""
    found = ""
    for a, b, c in NAMES.findall(rest):
        for token in (a or b or c).split():
            parts = {p.lower() for p in PARTS.findall(token)}
            joined = token.lower().replace("-", "").replace("_", "")
            if joined in COMMENT_PARTS or not parts.isdisjoint(COMMENT_PARTS) and parts.isdisjoint(STATE_PARTS):
                return "comments"
            if joined in BAD_PARTS or not parts.isdisjoint(BAD_PARTS) and parts <= BAD_PARTS | LAYOUT_PARTS:
                found = "name"
            elif not found and not parts.isdisjoint(TALK_PARTS) and parts.isdisjoint(STATE_PARTS):
                found = "talk"
    return found


def kind_of(tag: str, rest: str, in_article: bool) -> str:
    """bad: boilerplate by tag, role or as hidden; by class or id as named() says; else empty."""
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return "bad"
    if not rest or tag in ("body", "html"):
        return ""
    return "bad" if BAD_ROLES.search(rest) or HIDDEN.search(rest) else named(rest)


def blocks_of(page: str) -> Page:
    out = Page()
    parts: list[str] = []
    linked = depth_a = breaks = numbered = head = at = dropped = 0
    para = False
    piece = PIECE
    #: Open elements: tag, kind, section, article, flag.
    stack: list[tuple[str, str, int, int, int]] = [("", "", 0, 0, 0)]
    opened: dict[str, int] = {}
    bad = 0

    def close() -> None:
        nonlocal linked, breaks
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            _, _, section, article, flag = stack[-1]
            out.blocks.append(Block(text, linked, bad > 0, flag, article, head, section, para))
        parts.clear()
        linked = breaks = 0

    def add(text: str) -> None:
        nonlocal linked, breaks
        if text and not dropped:
            parts.append(text)
            if not text.isspace():
                breaks = 0
                if depth_a:
                    linked += len(SPACE.sub(" ", text).strip())

    def push(tag: str, kind: str, article: int) -> None:
        nonlocal bad, dropped
        _, _, section, around, flag = stack[-1]
        if kind not in ("", "bad") and tag not in INLINE:
            out.flags.append((kind, flag, around))
            flag = len(out.flags) - 1
        if tag in INLINE:
            dropped += kind != ""
        elif len(stack) < DEEP:
            out.parent.append(section)
            out.first.append(len(out.blocks))
            out.last.append(len(out.blocks))
            section = len(out.parent) - 1
        bad += kind == "bad" and tag not in INLINE
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, kind, section, article, flag))

    def pop() -> str:
        nonlocal bad, dropped
        tag, kind, section, _, _ = stack.pop()
        opened[tag] -= 1
        if tag in INLINE:
            dropped -= kind != ""
        else:
            bad -= kind == "bad"
            if section != stack[-1][2]:
                out.last[section] = len(out.blocks)
        return tag

    while True:
        m = piece.search(page, at)
        if m is not None and piece is PIECE and m[5]:
            piece = PLAIN
            m = piece.search(page, at)
        add(html.unescape(page[at : m.start() if m else len(page)]))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            add(m[1])
            continue
        if m[3] is None:
            continue
        end, tag, rest = m[2] == "/", m[3].lower(), m[4]
        if tag in RAW and not end and not rest.rstrip().endswith("/"):
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            if tag in BLOCK:
                close()
            continue
        if tag == "br":
            add(" ")
            breaks += 1
            if breaks > 1:
                close()
            continue
        if tag == "a":
            depth_a = 0 if end else 1
            continue
        block = tag in BLOCK
        if not block and tag not in INLINE:
            continue
        if block:
            close()
            depth_a = 0
            # a paragraph or heading ends where the next block begins, an item where the next item does
            while stack[-1][0] in INLINE or stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or not end and stack[-1][0] == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                pop()
            head = 0 if end or not re.fullmatch("h[1-6]", tag) else int(tag[1])
            para = tag == "p" and not end
        if end:
            if opened.get(tag):
                while pop() != tag:
                    pass
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            article = stack[-1][3]
            kind = kind_of(tag, rest, bool(article))
            if tag in ("article", "main") and not kind:
                if bad and not article:
                    # a container that was never closed does not hold an article
                    while bad:
                        pop()
                if not bad:
                    numbered += 1
                    article = article or numbered
            if kind or block and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html"):
                push(tag, kind, article)
    close()
    while len(stack) > 1:
        pop()
    out.last[0] = len(out.blocks)
    return out


def taken_back(page: Page, labels: list[bool | None]) -> set[int]:
    """Containers that are bad by name only but hold the page's main text. Outer ones are judged first; text counts as the page's own where every container around it was taken back."""
    blocks, flags = page.blocks, page.flags
    if len(flags) == 1:
        return set()
    own, top, start, opening = [0] * len(flags), [False] * len(flags), [len(blocks)] * len(flags), [""] * len(flags)
    plain, heading = 0, False
    for i, (b, good) in enumerate(zip(blocks, labels, strict=True)):
        if b.bad:
            continue
        size, f = b.size if good else 0, b.flag
        if not f:
            plain += size
            heading |= b.head == 1 or b.article > 0
        while f:
            kind, around, article = flags[f]
            own[f] += size
            top[f] |= b.head == 1 or kind == "name" and b.article > 0 and b.article != article
            if i < start[f]:
                start[f], opening[f] = i, b.text if b.head else ""
            f = around
    found: set[int] = set()
    # containers open in page order, and those around a block have been judged when the next one opens
    at, before = 0, False
    for f in range(1, len(flags)):
        kind, around, _ = flags[f]
        while start[f] < len(blocks) and at < start[f]:
            before = before or labels[at] is True and not blocks[at].bad and clear(blocks[at].flag, found, flags)
            at += 1
        if around and around not in found or not own[f] and kind == "name":
            continue
        # text of the page's own outside f: that of containers taken back, less f's
        outside = plain if not around else own[around] - own[f]
        if kind == "name":
            if top[f] and (own[f] > outside or not outside and not heading):
                found.add(f)
            continue
        begins = opening[f] and kind == "talk" and not re.search(r"\d", opening[f]) and COMMENT_PARTS.isdisjoint(WORD.findall(opening[f].lower()))
        if top[f] or begins or not before and own[f]:
            found.add(f)
    if not found and not plain and not heading:
        outer = [f for f in range(1, len(flags)) if not flags[f][1]]
        best = max(outer, key=lambda f: (own[f], -f), default=0)
        found = {best} if best and own[best] else set()
    return found


def clear(flag: int, found: set[int], flags: list[tuple[str, int, int]]) -> bool:
    """Whether all containers around are taken back."""
    while flag:
        if flag not in found:
            return False
        flag = flags[flag][1]
    return True


def second_pass(page: Page) -> list[bool]:
    blocks = page.blocks
    n, words = len(blocks), sum(b.words for b in blocks if not b.bad)
    known = sum(b.dense for b in blocks if not b.bad) >= UNKNOWN * words
    labels = [b.label(known) for b in blocks]
    back = taken_back(page, labels)
    # bad by where it stands: no evidence about its neighbours inside their own sections
    out_of_it = [b.bad or not clear(b.flag, back, page.flags) for b in blocks]
    marked = any(b.article and not o for b, o in zip(blocks, out_of_it, strict=True))
    if marked:
        out_of_it = [o or not b.article for b, o in zip(blocks, out_of_it, strict=True)]

    def sweep(order, known_at) -> list[int]:
        at, out = -1, [-1] * n
        for i in order:
            out[i] = at
            if known_at(i):
                at = i
        return out

    decided = lambda i: labels[i] is not None and not out_of_it[i]
    ahead, back_to = range(n), range(n - 1, -1, -1)
    before, after = sweep(ahead, decided), sweep(back_to, decided)
    wall_before, wall_after = sweep(ahead, out_of_it.__getitem__), sweep(back_to, out_of_it.__getitem__)
    any_good = any(labels[i] for i in range(n) if decided(i))

    def inherited(i: int) -> bool:
        b = blocks[i]
        p, q, section = before[i], after[i], b.section
        own = section
        while True:
            has_p, has_q = p >= page.first[section] and p >= 0, 0 <= q < page.last[section]
            if has_p or has_q:
                break
            if not section:
                # nothing on the page is decided but what stands in boilerplate
                return True if b.article or not any_good else False
            section = page.parent[section]
        near = [(i - p, not labels[p], p)] if has_p else []
        near += [(q - i, not labels[q], q)] if has_q else []
        away, bad, j = min(near)
        if b.article:
            return not bad if blocks[j].article == b.article else True
        if blocks[j].section != b.section and b.size < LONG and LEGAL.search(b.text):
            return False
        if not section and own and blocks[j].section != own:
            # far from any text: boilerplate between here and there counts
            walls = [abs(i - w) for w in (wall_before[i], wall_after[i]) if w >= 0]
            if walls and min(walls) < away:
                return False
        return not bad

    final = [False if o else x if x is not None else None for o, x in zip(out_of_it, labels, strict=True)]
    for i in range(n - 1, -1, -1):
        if final[i] is None:
            follows = i + 1 < n and not out_of_it[i + 1] and blocks[i].head and (not blocks[i + 1].head or final[i + 1])
            final[i] = (final[i + 1] if follows else inherited(i)) or blocks[i].head == 1 and inherited(i)
    return final


def main_text(page: str | None) -> str:
    if not page:
        return ""
    read = blocks_of(page)
    return "\n\n".join(b.text for b, good in zip(read.blocks, second_pass(read), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text and its length in code points for every page."""
    schema = StructType([pages.schema[id_col], pages.schema[url_col], StructField("text", StringType()), StructField("n_chars", LongType())])

    def make():
        def one(page_id, url, page):
            text = main_text(page)
            return [(page_id, url, text, len(text))]

        return one

    return map_rows(pages.select(id_col, url_col, html_col), make, schema, 512)
