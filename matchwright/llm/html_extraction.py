"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags, with the open elements above them. Features are the ancestors' tags and
the words in their class, id and role, and properties of the text (length,
links, closing punctuation). The field has two labels, article and other; it is
trained by maximum likelihood on pages with labels that ``labelled_pages`` writes
in many layouts, and a page is decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# HTML elements by their role in layout.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript script style svg template textarea xmp".split())
#: Form controls inside a block, whose text is none of the block's.
CONTROL_TAGS = frozenset("button label select datalist".split())
#: Words in class, id and role that tell something about an element.
HINTS = frozenset(
    "ad ads advert advertisement adverts alert article author banner bar body breadcrumb breadcrumbs button byline caption comment comments complementary consent content contentinfo cookie cookies copyright disclaimer discussion entry feedback footer form gdpr head header links login main masthead menu meta modal nav navbar navigation newsletter notice notices page pagination pager popup post posts promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored story subscribe tags text thread title toc toolbar top warning widget".split()
)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"=\s*([\"'])|>")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_CLOSERS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
#: Elements that close open ones when they begin, up to the nearest list or table.
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPES = frozenset(("ul", "ol", "dl", "table", "menu"))
_LINES = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))


@lru_cache(maxsize=10_000)
def hint(word: str) -> str | None:
    """The hint in a word of a class: itself, or the longest of four letters or more
    that it begins or ends with (``commentlist``, ``mainmenu``)."""
    if word in HINTS:
        return word
    return max((h for h in HINTS if len(h) > 3 and (word.startswith(h) or word.endswith(h))), key=lambda h: (len(h), h), default=None)


class Path:
    """An open element with those above it: their marks as a set, the element's own
    tag, and where elements stand that a later one may close. Elements of a page that
    are open in the same way are one Path."""

    __slots__ = ("parent", "tag", "marks", "depth", "open", "below")

    def __init__(self, parent: "Path | None", tag: str, marks: tuple[str, ...]):
        self.parent, self.tag = parent, tag
        above = parent.marks if parent else frozenset()
        self.marks = above if above.issuperset(marks) else above.union(marks)
        self.depth = parent.depth + 1 if parent else 0
        #: The lowest open element of each tag that another may close, up to a list or table.
        self.open = {} if parent is None or tag in _SCOPES else parent.open
        if tag in _IMPLIED and tag not in self.open:
            self.open = self.open | {tag: self}
        self.below: dict[tuple[str, ...], Path] = {}

    def child(self, marks: tuple[str, ...]) -> "Path":
        got = self.below.get(marks)
        if got is None:
            got = self.below[marks] = Path(self, marks[0], marks)
        return got


def _tokens(page: str):
    """(text, tag, closing, attributes) in order: either a text or a tag. Every
    character is looked at a bounded number of times: a search that finds nothing
    is not begun again."""
    at = seen = 0
    size, last_end, quotes = len(page), page.rfind(">"), True
    while (lt := page.find("<", seen)) >= 0 and (lt < last_end or page.startswith("<!--", lt)):
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = size if end < 0 else end + 3
            else:
                end = page.find(">", lt) + 1
            if lt > at:
                yield page[at:lt], None, False, ""
            at = seen = end
            continue
        closing = after == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            seen = lt + 1
            continue
        end, look = -1, name.end()
        while quotes and (m := _QUOTE_OR_END.search(page, look)):
            if m[1] is None:
                end = m.start()
                break
            look = page.find(m[1], m.end()) + 1
            if look == 0:
                break
        if end < 0:  # a quote is never closed: from here on quotes mean nothing
            quotes, end = False, page.find(">", name.end())
        if lt > at:
            yield page[at:lt], None, False, ""
        tag = name[0].lower()
        attrs = page[name.end() : end]
        at = seen = end + 1
        if not closing and tag in RAW_TAGS and not attrs.endswith("/"):
            stop = _CLOSERS[tag].search(page, at)
            at = seen = stop.end() if stop else size
            continue
        yield None, tag, closing, attrs
    if at < size:
        yield page[at:], None, False, ""


def attributes(text: str) -> dict[str, str]:
    """Names in lower case, and values, of the attributes of a tag; of repeated ones the first."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(attrs.get("style", "")))


def leaf_blocks(page: str) -> list[tuple[str, Path, float]]:
    """(text, path of the open elements, share of the text inside links) of each leaf
    block with text. A path's marks are tags and ``#hint`` words. Time is linear in
    the page, whatever its nesting and however broken its markup."""
    blocks: list[tuple[str, Path, float]] = []
    top = Path(None, "", ())
    stack = [top]
    count: dict[str, int] = {}
    parts: list[str] = []
    linked = links = 0
    #: A control or a hidden inline element whose text is left out: its tag, the depth it stands at, how often its tag is open.
    unread: list = []

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append((text, stack[-1], min(1.0, linked / max(1, len(text)))))
            parts, linked = [], 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            count[stack.pop().tag] -= 1
        if unread and depth < unread[1]:  # what was never closed ends with its block
            unread.clear()

    for raw, name, closing, attrs in _tokens(page):
        if name is None:
            if not unread:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if links:
                    linked += len(text.strip())
        elif name == "br":
            parts.append(" ")
        elif unread and name == unread[0]:
            unread[2] += -1 if closing else 1
            if not unread[2]:
                unread.clear()
        elif name in CONTROL_TAGS:
            if not closing and not unread:
                unread[:] = [name, len(stack), 1]
        elif name in VOID_TAGS:
            if name == "hr":
                end_block()
        elif name in BLOCK_TAGS:
            end_block()
            if closing:
                if count.get(name):
                    while stack[-1].tag != name:
                        close_to(len(stack) - 1)
                    close_to(len(stack) - 1)
                continue
            links = 0
            if stack[-1].tag in _LINES:  # a block cannot stand in a paragraph
                close_to(len(stack) - 1)
            if name in _IMPLIED:
                shut = [e.depth for t in _IMPLIED[name] if (e := stack[-1].open.get(t))]
                if shut:
                    close_to(min(shut))
            marks = [name]
            if attrs:
                found = attributes(attrs)
                if hidden(found):
                    marks.append("#hidden")
                hints = {"#" + h for a in ("class", "id", "role") for x in _WORD.findall(found.get(a, "")) if (h := hint(x.lower()))}
                marks += sorted(hints)
            stack.append(stack[-1].child(tuple(marks)))
            count[name] = count.get(name, 0) + 1
        else:
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
            if attrs and not closing and not unread and not attrs.endswith("/") and hidden(attributes(attrs)):
                unread[:] = [name, len(stack), 1]
    end_block()
    return blocks


def text_marks(text: str, link_share: float, before: Path | None, path: Path) -> list[str]:
    words = text.count(" ") + 1
    out = ["len:" + ("1" if words < 4 else "2" if words < 12 else "3" if words < 40 else "4"), "link:" + ("0" if link_share == 0 else "1" if link_share < 0.4 else "2")]
    out.append("stop:" + ("1" if text[-1] in ".!?…\"'”»" else "0"))
    if "©" in text or "copyright" in text.lower():
        out.append("legal")
    out.append("same" if before is path else "changed")
    return out


class Field:
    """Weights of marks for the label article against other, and of label pairs."""

    def __init__(self, weights: dict[str, float], pair: np.ndarray):
        self.weights, self.pair, self._paths = weights, pair, {}

    def _path(self, path: Path) -> float:
        key = (path.marks, path.tag)
        got = self._paths.get(key)
        if got is None:
            if len(self._paths) > 100_000:
                self._paths.clear()
            got = self._paths[key] = sum(self.weights.get(f, 0.0) for f in path_marks(path))
        return got

    def decode(self, blocks: list[tuple[str, Path, float]]) -> list[bool]:
        """The most likely labels; on a tie, other."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.pair.tolist()
        back: list[tuple[bool, bool]] = []
        other = article = 0.0
        before = None
        for k, (text, marks, link) in enumerate(blocks):
            gain = self._path(marks) + sum(self.weights.get(f, 0.0) for f in text_marks(text, link, before, marks))
            before = marks
            if k == 0:
                other, article = 0.0, gain
                continue
            to_other, to_article = article + ba > other + aa, article + bb > other + ab
            back.append((to_other, to_article))
            other, article = (article + ba if to_other else other + aa), (article + bb if to_article else other + ab) + gain
        label = article > other
        labels = [label]
        for to_other, to_article in reversed(back):
            label = to_article if label else to_other
            labels.append(label)
        return labels[::-1]


def path_marks(path: Path) -> list[str]:
    return [*sorted("in:" + m for m in path.marks), "own:" + (path.tag or "-"), "bias"]


def train(pages: list[tuple[str, list[bool]]], steps: int = 250, rate: float = 0.1, decay: float = 5e-4) -> Field:
    """Maximum likelihood by Adam; the gradient is the expected less the seen counts,
    from the forward and backward sums of all pages at once."""
    names: dict[str, int] = {}
    rows, owner, gold = [], [], []
    for p, (page, labels) in enumerate(pages):
        blocks, before = leaf_blocks(page), None
        if len(blocks) != len(labels):
            raise ValueError("a page's labels and blocks differ in number")
        for k, (text, marks, link) in enumerate(blocks):
            rows.append([names.setdefault(f, len(names)) for f in path_marks(marks) + text_marks(text, link, before, marks)])
            owner.append((p, k))
            gold.append(labels[k])
            before = marks
    n, longest = len(pages), max(k for _, k in owner) + 1
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r] = 1.0
    at = tuple(np.array(owner).T)
    here = np.zeros((n, longest), dtype=bool)
    here[at] = True
    y = np.zeros((n, longest), dtype=int)
    y[at] = gold
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][here[:, 1:]], y[:, 1:][here[:, 1:]]), 1)
    w, pair = np.zeros(len(names)), np.zeros((2, 2))
    m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    add = np.logaddexp
    for step in range(1, steps + 1):
        emit = np.zeros((n, longest, 2))
        emit[at[0], at[1], 1] = x @ w
        fore, aft = np.zeros_like(emit), np.zeros_like(emit)
        fore[:, 0] = emit[:, 0]
        for t in range(1, longest):
            z = fore[:, t - 1, :, None] + pair
            fore[:, t] = np.where(here[:, t, None], add(z[:, 0], z[:, 1]) + emit[:, t], fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            z = pair[None] + (aft[:, t + 1] + emit[:, t + 1])[:, None, :]
            aft[:, t] = np.where(here[:, t + 1, None], add(z[:, :, 0], z[:, :, 1]), 0.0)
        total = add(fore[:, -1, 0], fore[:, -1, 1])
        chance = np.exp(fore[:, :, 1] + aft[:, :, 1] - total[:, None])
        both = np.exp(fore[:, :-1, :, None] + pair + (emit[:, 1:] + aft[:, 1:])[:, :, None, :] - total[:, None, None, None])
        grad = np.concatenate([x.T @ (chance[at] - y[at]) / n + decay * w, ((both * here[:, 1:, None, None]).sum(axis=(0, 1)) - seen).ravel() / n])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[: len(names)]
        pair = pair - move[len(names) :].reshape(2, 2)
    return Field({k: float(w[i]) for k, i in names.items()}, pair)


def labelled_pages(count: int = 400, seed: int = 17) -> list[tuple[str, list[bool]]]:
    """Pages of invented words in many layouts, each with its blocks' labels."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]

    def words(low: int, high: int, stop: bool = True) -> str:
        text = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))
        return text.capitalize() + ("." if stop else "")

    def attr(*names: str) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if names else ""

    def page() -> tuple[str, list[bool]]:
        out: list[str] = []
        labels: list[bool] = []

        def say(tag: str, text: str, label: bool, extra: str = "") -> None:
            out.append(f"<{tag}{extra}>{text}</{tag}>" if rng.random() < 0.9 or tag not in ("p", "li") else f"<{tag}{extra}>{text}")
            labels.append(label)

        def menu(tag: str, extra: str) -> None:
            out.append(f"<{tag}{extra}><ul>")
            for _ in range(rng.randint(2, 8)):
                say("li", f'<a href="/x">{words(1, 2, False)}</a>', False)
            out.append(f"</ul></{tag}>")

        def junk(where: str) -> None:
            kind = rng.randrange(11)
            if kind == 0:
                tag, hints = rng.choice(["div", "div", "section", "aside", "p", "figure", "li"]), attr("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo-box", "ad-slot")
                if rng.random() < 0.5 or tag in ("p", "li"):
                    say(tag, words(3, 40), False, hints)
                else:
                    out.append(f"<{tag}{hints}>")
                    for _ in range(rng.randint(1, 3)):
                        say(rng.choice(["p", "p", "div", "h3", "h4"]), words(3, 40), False)
                    out.append(f"</{tag}>")
            elif kind == 1:
                out.append(f'<aside{attr("sidebar", "widget", "related-posts") if rng.random() < 0.6 else ""}>')
                for _ in range(rng.randint(1, 4)):
                    say(rng.choice(["p", "h3", "div", "li"]), words(2, 30), False)
                out.append("</aside>")
            elif kind == 2:
                say(rng.choice(["div", "section"]), words(5, 30), False, attr("cookie-notice", "notice", "gdpr-consent", "alert", "newsletter", "subscribe-box"))
            elif kind == 3:
                tag = rng.choice(["section", "div", "div", "ol", "ul", "aside"])
                out.append(f'<{tag}{attr("comments", "user-comments", "comment-list", "commentlist", "discussion", "replies", "reader-comments")}>')
                if rng.random() < 0.3 and tag not in ("ol", "ul"):
                    say(rng.choice(["h2", "h3", "h4"]), words(1, 4, False), False)
                for _ in range(rng.randint(1, 6)):
                    own = rng.choice(["", "", attr("comment", "reply", "comment-body")])
                    if tag in ("ol", "ul"):
                        nested = rng.random() < 0.5
                        out.append("<li>" if nested else "")
                        say("p" if nested else "li", words(3, 60), False, own)
                        out.append("</li>" if nested else "")
                    elif rng.random() < 0.4:
                        out.append(f'<{(inner := rng.choice(["div", "article", "blockquote"]))}{own}>')
                        say(rng.choice(["p", "div"]), words(3, 60), False)
                        out.append(f"</{inner}>")
                    else:
                        say(rng.choice(["p", "p", "div"]), words(3, 60), False, own)
                out.append(f"</{tag}>")
            elif kind == 4:
                out.append(f'<form{attr("search", "login", "signup-form") if rng.random() < 0.5 else ""}>')
                say(rng.choice(["p", "div", "legend"]), words(1, 12, rng.random() < 0.5), False)
                out.append("<label>name</label><input type=text><select><option>one<option>two</select><textarea>x</textarea><button>send</button></form>")
            elif kind == 5:
                menu(rng.choice(["nav", "div"]), attr("menu", "nav", "navigation", "breadcrumbs", "toc"))
            elif kind == 6:
                say("div", f'<a href="#">{words(1, 3, False)}</a> <a href="#">{words(1, 3, False)}</a>', False, attr("share", "social", "tags", "pagination"))
            elif kind == 7 and where != "article":
                out.append(f'<div{attr("sidebar", "related", "recommended", "widget")}>')
                for _ in range(rng.randint(1, 4)):
                    say(rng.choice(["p", "h4", "li"]), rng.choice([words(3, 30), f'<a href="/y">{words(3, 9, False)}</a>']), False)
                out.append("</div>")
            elif kind == 8 and where != "article":
                say("p", words(3, 20), False, attr("disclaimer", "legal-notice", "warning", "copyright"))
            elif kind == 9:
                unseen = rng.choice([" hidden", ' style="display:none"', ' style="color:red; display: none;"', ' aria-hidden="true"', ' style="visibility:hidden"'])
                if rng.random() < 0.5:
                    say(rng.choice(["p", "div", "li", "h2"]), words(2, 40), False, unseen)
                else:
                    out.append(f"<div{unseen}>")
                    for _ in range(rng.randint(1, 3)):
                        say("p", words(4, 50), False)
                    out.append("</div>")
            else:
                out.append("<script>if (a < b) { x = '<p>no</p>'; }</script><style>p{margin:0}</style><!-- <p>none</p> -->")

        out.append("<!DOCTYPE html><html><head><meta charset=utf-8>")
        if rng.random() < 0.85:
            say("title", words(2, 9, rng.random() < 0.2), False)
        out.append("<style>p{margin:0}</style></head><body>")
        bare = rng.random() < 0.15  # an article and little else
        if rng.random() < 0.5 and not bare:
            out.append(f'<header{attr("masthead", "top", "page-header") if rng.random() < 0.4 else ""}>')
            say(rng.choice(["h1", "p", "div"]), words(1, 8, False), False)
            out.append("</header>")
        if rng.random() < 0.8 and not bare:
            menu(rng.choice(["nav", "nav", "div"]), attr("menu", "nav", "navbar"))
        for _ in range(0 if bare else rng.randint(0, 2)):
            junk("page")
        style = rng.random()
        opener, closer = ("<article>", "</article>") if style < 0.5 else (f'<div{attr("content", "main-content", "post", "article-body", "entry-content", "story")}>', "</div>") if style < 0.75 else ("<main>", "</main>") if style < 0.9 else ("<main><article>", "</article></main>")
        out.append(opener)
        if rng.random() < 0.8:
            if rng.random() < 0.15:
                out.append("<header>")
                say("h1", words(2, 10, rng.random() < 0.4), True)
                out.append("</header>")
            else:
                say("h1", words(2, 10, rng.random() < 0.4), True)
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.65:
                text = words(1, 8, rng.random() < 0.7) if rng.random() < 0.3 else words(6, 80, rng.random() < 0.9)
                if rng.random() < 0.05:
                    text += " <button>copy</button>"
                say("p", text if rng.random() < 0.7 else f'{text} <a href="/z">{words(1, 4, False)}</a> {words(2, 9)}', True)
            elif r < 0.73:
                say(rng.choice(["h2", "h3"]), words(1, 7, False), True)
            elif r < 0.80:
                out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    say("li", words(2, 14, rng.random() < 0.5), True)
                out.append("</ul>")
            elif r < 0.84:
                say(rng.choice(["blockquote", "pre", "div"]), words(4, 40), True)
            elif r < 0.87:
                out.append("<table>")
                for _ in range(rng.randint(1, 3)):
                    out.append("<tr>")
                    say("td", words(1, 6, False), True)
                    say("td", words(1, 6, False), True)
                    out.append("</tr>")
                out.append("</table>")
            elif r < 0.90:
                out.append("<figure><img src=x>")
                say("figcaption", words(2, 10), True)
                out.append("</figure>")
            else:
                junk("article")
        out.append(closer)
        for _ in range(rng.randint(0, 3)):
            junk("page")
        if rng.random() < 0.85:
            out.append(f'<footer{attr("footer", "site-footer", "bottom") if rng.random() < 0.4 else ""}>' if rng.random() < 0.8 else '<div class="footer">')
            say("p", rng.choice(["&copy; ", "Copyright ", ""]) + words(2, 25), False)
            out.append("</footer>" if "<footer" in out[-2] else "</div>")
        if rng.random() < 0.9:
            out.append("</body></html>")
        return "".join(out), labels

    return [page() for _ in range(count)]


def main_text(field: Field, page: str | None) -> str:
    """The blocks that the field labels as article; a page without any element is its text."""
    blocks = leaf_blocks(page or "")
    if all(path.depth == 0 for _, path, _ in blocks):
        return "\n\n".join(b[0] for b in blocks)
    return "\n\n".join(b[0] for b, keep in zip(blocks, field.decode(blocks)) if keep)


_trained: list[Field] = []


def default_field() -> Field:
    """The field trained on ``labelled_pages``, once a process."""
    if not _trained:
        _trained.append(train(labelled_pages()))
    return _trained[0]


def extract(pages: DataFrame, html_column: str = "html", to: str = "main_text", field: Field | None = None) -> DataFrame:
    """``pages`` with a string column ``to`` (in place of one of that name): the main
    text, blocks joined by an empty line. A null or empty page, and a page without an
    article block, give an empty text. Text of form controls and of hidden elements is
    none of the article's. A block that is as likely article as not (a tie) is left out.
    Pages of any length, nesting and broken markup take time linear in their length.
    Rows and other columns stay; repeated rows are read each for itself; an empty table
    gives an empty one."""
    small_batches(pages.sparkSession)
    model = field or default_field()

    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        return pa.array([main_text(model, v.as_py()) for v in values], pa.string())

    return pages.withColumn(to, apply(F.coalesce(F.col(html_column), F.lit(""))))
