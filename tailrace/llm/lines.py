"""Lines of a page: how they are cut, folded and told apart. Plain functions on one text, used inside Arrow batches."""

from __future__ import annotations

import re

_KEEP = b"abcdefghijklmnopqrstuvwxyz\n"
_DROP = bytes(b for b in range(128) if b not in _KEEP)

HEADING = re.compile(r"#{1,6}\s")
ITEM = re.compile(r"(?:[-*•+]|\d{1,3}[.)])\s+")
CLOCK = re.compile(r"\d{1,2}:\d{2}(?::\d{2})?\s*[-–—|:]\s*\S")
SENTENCE_END = re.compile(r"[.!?][\"'”’)]*$")
SENTENCES = re.compile(r"(?<=[.!?])\s+(?=\S)")
NAME = re.compile(r"[^\W\d_]+(?:-[^\W_]+)+")
TRAIL = re.compile(r"(?:.*?\s(?:[|·»›>/]|::)\s){2}")
WORD = re.compile(r"[^\W_]+")

#: Kinds of lines, the leaves of the page tree.
H, T, L, C, P, B = "heading", "time", "item", "command", "prose", "bare"


def fold(text: str) -> bytes:
    """Letters only, lower-cased: what two lines share that differ in case, blanks, punctuation and digits."""
    out = text.lower().encode("utf-8", "surrogatepass").translate(None, _DROP + b"\n")
    return out if out.isascii() else _letters(out)


def _letters(raw: bytes) -> bytes:
    return "".join(filter(str.isalpha, raw.decode("utf-8", "surrogatepass"))).encode("utf-8", "surrogatepass")


def fold_lines(body: str) -> list[bytes]:
    """``fold`` of every line of ``body``, by one pass over the whole text."""
    parts = body.lower().encode("utf-8", "surrogatepass").translate(None, _DROP).split(b"\n")
    return [p if p.isascii() else _letters(p) for p in parts]


def kind_of(raw: str, stripped: str) -> str:
    """The kind of a non-blank line. ``raw`` keeps its indentation."""
    if stripped[0] == "#":
        return H if HEADING.match(stripped) else B
    if raw.startswith("    "):
        return C
    if stripped[0].isdigit() and CLOCK.match(stripped):
        return T
    if ITEM.match(stripped):
        return L
    if SENTENCE_END.search(stripped) and stripped.count(" ") >= 2 and not TRAIL.match(stripped):
        return P
    return B


def lead(text: str) -> str:
    """The first word of ``text`` with names and numbers masked: what an item or a title opens with."""
    text = ITEM.sub("", text, count=1).lstrip("»«←→>[“\"' ")
    first = text.split(None, 1)[0] if text.strip() else ""
    if any(ch.isdigit() for ch in first):
        return "0"
    if NAME.match(first) and not first.lower().startswith(("post-", "e-", "re-")):
        return "@"
    m = WORD.match(first.lower())
    return m.group() if m else ""
