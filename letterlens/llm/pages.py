"""Blocks of text of an HTML page, with the region of the page that each stands in."""

import html
import re
from bisect import bisect_left

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
DROPPED = frozenset("head script style noscript template svg math canvas iframe object select button textarea form nav footer header aside dialog menu noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset(("br", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "title"))
# Words in class, id and role that mark what is not the article: as a whole name, as its last word ("reader-comments"), or
# joined with words of CARRIER only ("share-buttons").
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation navi menu menubar"
    " breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside rail widget widgets related recommended cookie cookies"
    " consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search share sharing"
    " social comment comments reply replies respond disqus discussion pagination pager toolbar skip hidden contentinfo complementary"
    " dialog".split()
)
# Words that say nothing about a part but where it stands.
CARRIER = frozenset(
    "site page main global top bottom left right primary secondary wrapper wrap container inner outer box block area bar list links link"
    " items item button buttons icons section posts post articles stories slot unit panel text message policy form field input icon"
    " content row col column group thread the my js".split()
)
# Names with one of these tell a state of the page ("has-sidebar"); a header of these is the article's own.
STATE = frozenset("has have with without no not is are show shows hide open closed enabled disabled".split())
OWN_HEADER = frozenset("entry article post story".split())
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
SPLIT_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
FORM_END = re.compile(r"</form", re.I)
PAGE_PART = re.compile(r"<(?:article|footer|h1|header|main|nav)\b", re.I)

# An article element with one of these words is not the page's article, nor is one inside a part with one of them.
ASIDE_ARTICLE = frozenset(
    "comment comments reply replies respond discussion disqus teaser related recommended ad ads advert adverts advertisement promo"
    " promotion sponsor sponsored widget hidden dialog modal popup".split()
)
# Parts that may be wrapped around a whole page; what else is marked inside a "widget-area" is found by its own name.
AROUND = frozenset(("widget", "widgets"))

ARTICLE, MAIN, WRAPPED, OPEN, MARKED, OUTSIDE = range(6)


def _marks(value: str) -> set[str]:
    """The words of a class, id or role that mark a part."""
    found = set()
    for name in value.split():
        words = [part.lower() for part in SPLIT_NAME.split(name) if part]
        marks = CHROME.intersection(words)
        if len(words) == 1:
            marks |= (ASIDE_ARTICLE | {"main", "article"}).intersection(words)
        elif (
            STATE.intersection(words) or marks <= {"header"} and OWN_HEADER.intersection(words)
            or marks and words[-1] not in CHROME and not CHROME.union(CARRIER).issuperset(words)
        ):
            continue
        found |= marks
    return found


def _words(attributes: str) -> set[str]:
    """Marking words in class, id and role; "hidden" for parts that are not shown."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return set()
    found = set()
    for key, value, hidden in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            found |= _marks(value)
        elif (
            hidden or key == "hidden" or key == "aria-hidden" and value.lower() == "true"
            or key == "style" and HIDING.search(value)
        ):
            found.add("hidden")
    return found


class _Walk:
    """Open elements while a page is read once from front to back."""

    def __init__(self, page: str):
        self.page = page
        self.form_ends: list[int] | None = None
        self.page_parts: list[int] = []
        self.stack: list[tuple[str, int, bool]] = []  # name, region, whether its text counts at all
        self.blocks: list[tuple[int, str]] = []
        self.held: list[str] = []

    def state(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (OPEN, True)

    def text(self, raw: str) -> None:
        if self.state()[1]:
            self.held.append(raw)

    def end_block(self) -> None:
        if self.held:
            text = SPACE.sub(" ", html.unescape("".join(self.held))).strip()
            self.held.clear()
            if text:
                self.blocks.append((self.state()[0], text))

    def around_page(self, at: int) -> bool:
        """Whether the form that begins at `at` is wrapped around parts of a page and no form to fill in."""
        if self.form_ends is None:
            self.form_ends = [m.start() for m in FORM_END.finditer(self.page)]
            self.page_parts = [m.start() for m in PAGE_PART.finditer(self.page)]
        end = bisect_left(self.form_ends, at)
        part = bisect_left(self.page_parts, at)
        return part < len(self.page_parts) and (end == len(self.form_ends) or self.page_parts[part] < self.form_ends[end])

    def open(self, name: str, attributes: str, at: int) -> None:
        if name in CLOSES_P and any(x[0] == "p" for x in self.stack):
            self.close("p")
        if name in ("li", "dd", "dt", "option", "tr", "td", "th") and self.stack and self.stack[-1][0] == name:
            self.close(name)
        if name in BLOCKS:
            self.end_block()
        if name in VOID:
            return
        region, counts = self.state()
        words = _words(attributes)
        if name in ("article", "main") or words & {"main", "article"} and "role" in attributes:
            if words & ASIDE_ARTICLE or region == OUTSIDE:
                region = OUTSIDE
            elif region in (WRAPPED, MARKED):
                region = WRAPPED
            elif name == "main" or "main" in words and name != "article":
                region = min(region, MAIN)
            else:
                region = ARTICLE
        elif name == "form" and region != OUTSIDE and self.around_page(at):
            pass
        elif name not in ("html", "body") and (name in DROPPED or words & CHROME):
            if name in BLOCKS:
                around = name not in DROPPED and words & ASIDE_ARTICLE <= AROUND
                region = MARKED if around and region in (OPEN, MARKED) else OUTSIDE
            else:
                counts = False
        if name in RAW:
            counts = False
        self.stack.append((name, region, counts))

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.end_block()
        depth = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name), None)
        if depth is not None:
            if self.held and any(x[1] != self.stack[-1][1] for x in self.stack[depth - 1 if depth else 0 :]):
                self.end_block()
            del self.stack[depth:]


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(region, text) of each block in page order; character references decoded, white space made one space.

    ARTICLE and MAIN are what stands in such an element and in no part that is marked as something else, OUTSIDE and MARKED what
    stands in such a part, OPEN the rest. WRAPPED is an article or main element inside a MARKED part, one whose mark
    may belong to a wrapper of the whole page (a class such as "widget-area"). A form around parts of a page is no mark."""
    page = page or ""
    walk, at = _Walk(page), 0
    while match := MARKUP.search(page, at):
        if match.start() > at:
            walk.text(page[at : match.start()])
        at, name = match.end(), (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            walk.close(name)
            continue
        walk.open(name, match[3], at)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.start() if end else len(page)
    walk.text(page[at:])
    walk.end_block()
    return walk.blocks
