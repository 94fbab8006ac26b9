"""HTML as a sequence of leaf blocks: runs of text between block-level tags, each with the path of open elements."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape
from typing import NamedTuple
from zlib import crc32

#: Elements that begin and end blocks; all others lie inside a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody"
    " td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag.
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp svg math canvas audio video object".split())
#: What a start tag ends, if it is open and none of the second set is open inside it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
#: End tags of other elements don't reach beyond these.
WALLS = frozenset({"html", "table", "td", "th", "caption"})
#: Elements of a path that are features of a block, innermost first.
DEPTH = 16

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"  # quoted values may hold >
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Leaf(NamedTuple):
    """A block: its text with single spaces, hashes of its path's names, and how many of its characters are in links."""

    text: str
    path: tuple[int, ...]
    linked: int


def name_words(value: str) -> list[str]:
    """Words of an attribute, in lower case, without the s of a plural."""
    return [w[:-1] if len(w) > 2 and w.endswith("s") else w for w in map(str.lower, _WORD.findall(value))]


def names(tag: str, attributes: str) -> list[str]:
    """What an element is called: its tag, the words of its class, id, role and itemprop, and whether it isn't shown."""
    out = [f"<{tag}>"]
    for m in _NAMED.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "style":
            out += ["hidden"] * bool(_UNSEEN.search(value))
        elif kind == "hidden" or kind == "aria-hidden":
            out += ["hidden"] * (value.lower() != "false")
        else:
            out += name_words(value)
    return list(dict.fromkeys(out))


def hashed(name: str, innermost: bool) -> int:
    return crc32((b"0" if innermost else b"1") + name.encode())


@lru_cache(1 << 14)
def _hashes(tag: str, attributes: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Hashes of an element's names as the innermost of a path, and as one further out."""
    found = names(tag, attributes)
    return tuple(hashed(n, True) for n in found), tuple(hashed(n, False) for n in found)


def leaves(html: str | None) -> list[Leaf]:
    """The blocks of a whole page, in its order; those without text are left out. A null page has none.

    Scripts, styles, comments and other content that isn't shown as text are left out; character references are decoded;
    br counts as white space. Open elements that a start or end tag ends by HTML's rules are closed.
    """
    out: list[Leaf] = []
    if not html:
        return out
    stack: list[tuple[str, tuple]] = []
    open_: Counter[str] = Counter()  # how often an element is in the stack: what isn't there is not looked for
    parts: list[str] = []
    state = {"path": None, "linked": 0}

    def text(raw: str) -> None:
        got = unescape(raw) if "&" in raw else raw
        parts.append(got)
        if not got.isspace() and got:
            if state["path"] is None:
                held = stack[: -DEPTH - 1 : -1]
                state["path"] = tuple(x for k, (_, b) in enumerate(held) for x in (b[0] if k == 0 else b[1]))
            if any(name == "a" for name, _ in stack[-4:]):
                state["linked"] += len(got)

    def flush() -> None:
        if state["path"] is not None:
            shown = " ".join("".join(parts).split())
            out.append(Leaf(shown, state["path"], min(state["linked"], len(shown))))
        parts.clear()
        state["path"], state["linked"] = None, 0

    def close(ended, walls) -> None:
        if not any(open_[name] for name in ended):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ended:
                open_.subtract(name for name, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in walls:
                return

    at, end = 0, len(html)
    while at < end:
        m = _MARKUP.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in BLOCK:
                flush()
                close({tag}, WALLS - {tag})
            elif open_[tag]:  # an inline element ends alone
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k]
                        open_[tag] -= 1
                        break
                    if stack[k][0] in BLOCK and tag != "a":
                        break
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                found = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                stop = html.find(">", found.end()) if found else -1
                at = stop + 1 if stop >= 0 else end
            continue
        if tag in BLOCK:
            flush()
            close({"p"}, WALLS | {"button"})
            if tag in ENDS:
                close(*ENDS[tag])
        elif tag == "br":
            parts.append(" ")
        if tag not in VOID:
            open_[tag] += 1
            stack.append((tag, _hashes(tag, " ".join(x[0] for x in _NAMED.finditer(attributes)) if attributes else "")))
    flush()
    return out
