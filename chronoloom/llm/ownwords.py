"""A forum post without what is not its author's own: quoted posts, shown code, signature, markup."""

from __future__ import annotations

import html
import re

_BB_QUOTE = re.compile(r"\[quote[^\]\n]*\]|\[/quote\]", re.I)
_HTML_QUOTE = re.compile(r"<blockquote\b[^>]*>|</blockquote\s*>", re.I)
_CODE = re.compile(r"\[code[^\]\n]*\].*?\[/code\]|```.*?(?:```|\Z)|<pre\b[^>]*>.*?(?:</pre\s*>|\Z)|<code>[^<]*</code>", re.I | re.S)
_BREAK = re.compile(r"<br\s*/?>|</?p\b[^>]*>|</?div\b[^>]*>|</?li\b[^>]*>|</?h[1-6]\b[^>]*>", re.I)
_TAG = re.compile(r"</?(?:span|b|i|u|em|strong|a|font|small|big|img|ul|ol|table|tr|td|th|sub|sup|s|strike|center|tt)\b[^>]*>", re.I)
_BB_TAG = re.compile(r"\[/?(?:b|i|u|s|url|img|size|color|list|center|email|spoiler|\*)(?:=[^\]\n]*)?\]", re.I)
_QUOTED_LINE = re.compile(r"^\s*(?:>|&gt;)")
_ATTRIBUTION = re.compile(r"^\s*(?:\S+\s+(?:wrote|schrieb|escribió|a écrit|ha escrito)|(?:on|am|el|le)\s.{3,80}(?:wrote|schrieb|escribió|a écrit))\s*:\s*$", re.I)
_SIGNATURE = re.compile(r"^(?:--\s?|_{5,}|-{5,})\s*$")
_MARKED = re.compile(r"[\[<>&`\r:]|^(?:--|__)", re.M)
_SPACES = re.compile(r"[ \t ​]+")


def _drop_nested(text: str, marks: re.Pattern) -> str:
    """Text outside of properly nested open/close marks; what an unclosed mark opens is dropped to the end."""
    if not marks.search(text):
        return text
    out, depth, at = [], 0, 0
    for m in marks.finditer(text):
        closing = m.group().startswith(("[/", "</"))
        if depth == 0:
            out.append(text[at : m.start()])
            if not closing:
                depth = 1
        else:
            depth += -1 if closing else 1
        at = m.end()
        if depth == 0:
            out.append("\n")
    if depth == 0:
        out.append(text[at:])
    return "".join(out)


def own_words(text: str | None) -> str:
    """The own words of a post, one line per line or paragraph, entities resolved; "" for null."""
    if not text:
        return ""
    if not _MARKED.search(text):
        return "\n".join(x for x in (_SPACES.sub(" ", line).strip() for line in text.split("\n")) if x)
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    t = _drop_nested(t, _BB_QUOTE)
    t = _drop_nested(t, _HTML_QUOTE)
    raw = t.split("\n")
    if any(_QUOTED_LINE.match(x) for x in raw):
        raw = [
            x for i, x in enumerate(raw)
            if not _QUOTED_LINE.match(x) and not (_ATTRIBUTION.match(x) and any(_QUOTED_LINE.match(y) for y in raw[i + 1 : i + 3]))
        ]
    t = _BREAK.sub("\n", _CODE.sub("\n", "\n".join(raw)))
    lines = []
    for i, line in enumerate(t.split("\n")):
        if i and _SIGNATURE.match(line):
            break
        lines.append(line)
    t = "\n".join(lines)
    t = _BB_TAG.sub("", _TAG.sub("", t))
    for _ in range(2):  # entities may have been escaped twice
        t = html.unescape(t)
    return "\n".join(x for x in (_SPACES.sub(" ", line).strip() for line in t.split("\n")) if x)
