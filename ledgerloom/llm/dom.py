"""A tolerant reader of HTML: block-level nodes and text blocks of a page, with what a classifier of nodes needs."""

from __future__ import annotations

import html as entities
import re

# Fixed values of HTML: elements without end tag, inline elements, elements whose content is not text of the page,
# elements whose content is read up to their end tag, and what an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd label mark noscript object param q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
HIDDEN = frozenset("head template svg canvas audio video select button datalist".split())
RAW = frozenset("script style textarea title xmp iframe".split())
#: Elements that a head may hold: any other one, or text, ends a head whose end tag is omitted.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Inline elements that begin with white space.
SPACED = frozenset("br mtr mtd annotation".split())
#: Inline elements that end with their end tag even when blocks inside them are open.
ENCLOSING = frozenset("math noscript object".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
#: Elements inside which an open item, cell or paragraph of an outer element stays open.
SCOPES = frozenset("ul ol dl table body html article section div aside nav header footer main form blockquote td th figure object".split()) | HIDDEN

#: Kinds of tags, by what authors use them for; and words in class, id and role that speak for or against main text.
KINDS = {"root": "html body #root", "main": "article main", "nav": "nav menu", "aside": "aside", "header": "header hgroup", "footer": "footer address", "form": "form fieldset dialog", "section": "section div center", "paragraph": "p pre blockquote", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "table": "table thead tbody tfoot tr td th caption", "figure": "figure figcaption details summary", "text": "#text"}
FOR = frozenset("article articlebody main content contents post entry story body text page blog hentry prose document wrapper container".split())
AGAINST = {"navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pager pagination skip topbar links sitemap", "advert": "ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored sponsors affiliate offer", "side": "sidebar side aside rail widget widgets related recommended popular trending more tags share sharing social follow", "end": "footer foot bottom copyright colophon legal", "top": "header head masthead top logo branding", "notice": "cookie cookies consent gdpr notice notification alert modal popup overlay banner message warning disclaimer", "comments": "comment comments commentlist reply replies respond discussion disqus reviews", "form": "form newsletter subscribe subscription signup login search register contact"}
AGAINST_SETS = {k: frozenset(v.split()) for k, v in AGAINST.items()}
KIND_OF = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}

# A comment, a tag or a declaration. A quote opens a value only after an equals sign; what is not ended goes to the end of
# the page. No part gives back what it has taken, so the time is linear in the page.
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:\b|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_NAMED = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DECLARED = re.compile(r"(?:^|;)\s*display\s*:\s*([^;!]*?)\s*(!\s*important\s*)?(?=;|$)")

_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Page:
    """Nodes in page order; the parent of each comes before it. A text block is a node of tag ``#text``."""

    __slots__ = ("tags", "parents", "tokens", "texts", "links")

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.tokens: list[str] = []
        self.texts: list[str] = []
        self.links: list[int] = []

    def add(self, tag: str, parent: int, tokens: str = "", text: str = "", links: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.tokens.append(tokens)
        self.texts.append(text)
        self.links.append(links)
        return len(self.tags) - 1


def attribute_tokens(attributes: str) -> str:
    if "class" not in attributes and "id" not in attributes and "role" not in attributes and "=" not in attributes:
        return ""
    return " ".join(_TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes))).lower()))


def hides(attributes: str) -> bool:
    """Whether an element is hidden by an attribute ``hidden`` of its own or by ``display: none`` in its style."""
    attributes = attributes.lower()
    if "hidden" not in attributes and "display" not in attributes:
        return False
    own: dict[str, str] = {}
    for name, *values in _NAMED.findall(attributes):
        own.setdefault(name, "".join(values))  # the first of a name counts
    if own.get("hidden", "false").strip() != "false":
        return True
    shown = _DECLARED.findall(entities.unescape(own.get("style", "")))
    return bool(shown) and next((v for v, important in reversed(shown) if important), shown[-1][0]) == "none"


def parse(html: str) -> Page:
    page = Page()
    # inline elements stand on the stack as -1, hidden blocks as -2, both without a node
    stack: list[tuple[str, int]] = [("#root", page.add("#root", -1))]
    pending: list[str] = []
    in_link, linked, at, n = 0, 0, 0, len(html)
    hidden = 0  # where on the stack the outermost hidden element is

    def flush() -> None:
        nonlocal linked
        if pending:
            text = "".join(pending)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                page.add("#text", next(k for _, k in reversed(stack) if k >= 0), "", text, min(linked, len(text)))
            pending.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal in_link, hidden
        if any(node >= 0 for _, node in stack[k:]):
            flush()
        for tag, _ in stack[k:]:
            in_link -= tag == "a"
        del stack[k:]
        if k <= hidden:
            hidden = 0

    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            if hidden and stack[-1][0] == "head" and not text.isspace():
                close(len(stack) - 1)
            if not hidden:
                pending.append(text)
                if in_link:
                    linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            found = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if tag in INLINE:  # an inline end tag does not reach out of its block
                if found and (tag in ENCLOSING or all(k == -1 for _, k in stack[found:])):
                    close(found)
            else:
                if not hidden:
                    flush()
                if found:
                    close(found)
            continue
        if hidden and stack[hidden][0] == "head" and (tag == "body" or (hidden == len(stack) - 1 and tag not in IN_HEAD)):
            close(hidden)
        if tag in RAW:
            if not m[3].endswith("/"):
                at = after(html, tag, at)
            continue
        gone = tag in HIDDEN or (m[3] and hides(m[3]))
        if tag in INLINE:
            if tag in SPACED and not hidden and not gone:
                pending.append(" ")
            if tag not in VOID and not m[3].endswith("/"):
                if gone and not hidden:
                    hidden = len(stack)
                stack.append((tag, -1))
                in_link += tag == "a"
            continue
        if gone and (tag in VOID or m[3].endswith("/")) or (hidden and stack[hidden][0] == "svg" and m[3].endswith("/")):
            continue
        if tag not in HIDDEN:
            if not hidden:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ()):
                    close(k)
                    if tag not in CLOSES:
                        break
                elif stack[k][0] in SCOPES and stack[k][0] not in CLOSES.get(tag, ()):
                    break
        if tag in VOID:
            continue
        if hidden or gone:
            hidden = hidden or len(stack)
            stack.append((tag, -2))
            continue
        node = page.add(tag, next(k for _, k in reversed(stack) if k >= 0), attribute_tokens(m[3]) if m[3] else "")
        stack.append((tag, node))
    flush()
    return page


def after(html: str, tag: str, at: int) -> int:
    """Where the element of raw content that was opened just before ``at`` has ended: after its end tag, by whole name."""
    end = _ENDS[tag].search(html, at)
    return end.end() if end else len(html)
