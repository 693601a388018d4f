"""Seeds: what can be trusted, by its shape alone, as template residue or as a message of a page.

The rules know shapes, not sentences: delimiters of template parts, status codes with their phrases,
"enable / requires" with "scripts / cookies", the vocabulary of dummy text. Which other sentences are
messages is learned from the company they keep (``residue``).
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np

from chronoloom.llm.textprint import Prints, vocabulary

# Cited text does not count: between quotation marks or backticks, on one line.
_CITED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+[”\"]|„[^“”\n]+[“”\"]|«[^»\n]+»|`[^`\n]+`|‘[^’\n]+’|‚[^‘’\n]+[‘’]|'[^\w\s]+[^'\n]+[^\w\s]'")

# Names of template fields that stand in plain brackets (fixed values).
_FIELD = r"(?:(?:first|last|user|board|company|product|order|your) ?)?(?:name|id|user|member|date|title|subject|amount|board|city|code|company|currency|expiry|link|price|product|reason|season|thread|ticket|number|email|phone|address)"
# Delimiters of template parts that were never filled in.
_PART = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|<%[^%\n]+%>|\$\{[^{}\n]+\}|\{![^{}\n]+\}"
    r"|\{ ?[^\W\d][\w. -]*\}|\{\d+\}|\{[^{}|\n]+(?:\|[^{}|\n]+)+\}"
    r"|%%[^\W\d][\w. ]*%%|(?<![\w%])%[^\W\d][\w.]{2,}%|(?<![\w#])#[^\W\d][\w. ]+#|@@[^\W\d][\w. ]*@@"
    r"|(?<!\w)__[^\W\d_][\w. ]*__(?!\w)|\*\|[^|\n]+\|\*|\[\[[^\[\]\n]+\]\]|\(\([^\W\d][^()\n]*\)\)|<<[^<>\n]{2,}>>"
    r"|(?<![\w<])<[^\W\d][\w. ]+>(?![\w>])"
    rf"|\[(?i:your|insert|enter|add|hier|votre|su|tu|ihr|insérer|insertar)\b[^\]\n]+\]|\[[A-Z][A-Z]+(?:[_ ][A-Z]+)*\]|\[[a-z]+(?:_[a-z]+)+\]|\[(?i:{_FIELD})\]|\((?i:{_FIELD})(?: goes here)?\)"
    r"|\bMERGEFIELD\b|\bXXXX+\b|\b(?:DD|MM|YYYY|TT|JJ|JJJJ|AAAA)(?:[/.-](?:DD|MM|YY|YYYY|TT|JJ|JJJJ|AAAA)){2}\b|NaN/NaN|\[object Object\]"
    r"|(?<![\w%])%(?:\d+\$)?(?:\.\d+)?[sdf]\b[^%\n]*%(?:\d+\$)?(?:\.\d+)?[sdf]\b"
    r"|\b(?i:hello|hi|dear|by|hallo|hola|bonjour) (?:null|undefined)\b|\b(?:have|has) (?:null|undefined)\b"
)
# A field name in capitals where a value belongs: the rest of a line after its label, or the addressee.
_FIELD_LINE = re.compile(
    r"^(?:[^\W\d_][\w ]*:\s*)?[A-Z]{2,}(?:_[A-Z\d]+)+\s*[.,:;!]?$"
    r"|^(?i:dear|hello|hi|hallo|hola|bonjour|estimad[oa](?:/a)?|querid[oa](?:/a)?|cher(?:/ch[eè]re)?|ch[eè]re|sehr geehrte(?:r|s|/r|\(r\))?|liebe(?:r|s|/r|\(r\))?) [^\W\d_a-zß-ÿ]{3,}(?:[ _][^\W\d_a-zß-ÿ]{3,})+\s*[,:!]?$"
    r"|^(?:TODO|TBD|FIXME)\b ?[:-].*$",
    re.M,
)
# Every shape above holds one of these, which a plain post has not: a cheap first look.
_HINT = re.compile(r"[{}%#@<\[(*$]|__|[A-Z]{3}|NaN|null|undefined")

_THING = r"(?:web ?)?(?:page|site|file|url|link|resource|document|content|post|message|topic|thread|board|forum|section|image|article|item|app|application|address)s?"
_WHICH = rf"(?:(?:the|this|that|your|our) )?(?:requested |original )?{_THING}(?: (?:that )?(?:you|we) (?:requested|(?:are|were) (?:looking for|trying to (?:reach|view|open))))?"
_REASON = (
    rf"(?:bad request|unauthori[sz]ed|authorization required|payment required|forbidden|(?:{_THING} )?not found|{_THING} does not exist|method not allowed|not acceptable|request (?:time-?out|blocked)|conflict|gone|length required"
    r"|payload too large|uri too long|unsupported media type|unprocessable (?:entity|content)|too many requests|internal server error|internal error|not implemented|bad gateway|service (?:temporarily )?unavailable"
    r"|gateway time-?out|insufficient storage|network authentication required|access denied|permission denied|session (?:expired|timed out)|connection (?:timed out|refused|reset|closed)|database error|server error|fatal error)"
)
_STATUS = r"(?:error|http(?:/\d(?:\.\d)?)?|status|code|fehler|erreur)"
_ERROR = re.compile(
    # a status code with its phrase, or a label and a phrase; a phrase alone could be a member's answer
    rf"^(?:{_STATUS}[ :#-]*)*\(?\[?[1-5]\d\d\]?\)?\s*[:|–-]?\s*{_REASON}[.!…]*$"
    rf"|^(?:{_STATUS}[ :#-]*)*{_REASON}\s*[(\[:–-]*\s*(?:{_STATUS}\s*:?\s*)*[1-5]\d\d[)\]]?[.!…]*$"
    rf"|^(?:{_STATUS}\s*[:#–-]\s*)+{_REASON}[.!…]*$|^{_STATUS}\s*:?\s*[1-5]\d\d[.!…]*$"
    # one word and a reference
    r"|^[^\W\d_]+(?: ?id)?\s*[:#]?\s*(?=[0-9a-f-]*\d)(?=[0-9a-f-]*[a-f])[0-9a-f-]{5,}[.!…]*$|^(?:request|session|incident|trace|ray) ?id\s*:?\s*[0-9a-f-]*\d[0-9a-f-]*[.!…]*$"
    # what was asked for is not there (removed posts are no cases)
    rf"|^(?:(?:we(?:'re| are) )?sorry[,.!:-]? ?(?:but )?)?{_WHICH} (?:(?:(?:is|was|are|were|has|have|can|could|does|do|did)(?:n't| not| no longer)|cannot)(?: (?:been|be|currently|yet))* (?:found|exist|available|displayed|loaded|shown|opened|reached|respond|responding)"
    r"|(?:is|are) (?:(?:currently|temporarily|permanently) )?(?:unavailable|offline))(?: (?:on|at|in) (?:this|the|our) (?:web ?)?(?:site|server|board|forum))?[.!…]*$"
    r"|^(?:(?:we(?:'re| are) )?sorry[,.!:-]? ?(?:but )?)?(?:the|this) (?:requested )?(?:url|page|file|resource)(?: \S+)? was not found on (?:this|the|our) server[.!…]*$"
    rf"|^(?:(?:we(?:'re| are) )?sorry[,.!:-]? ?(?:but )?)?{_WHICH} (?:could not|cannot|can't|couldn't) be (?:located|retrieved|processed|completed)[.!…]*$"
    rf"|^(?:(?:sorry|oops)[,.!:-]? ?)?you (?:do not|don't|are not|aren't) (?:have (?:the )?(?:permission|access|rights?)|allowed|authori[sz]ed|permitted) (?:to )?(?:(?:view|see|read|access|open|enter) )?{_WHICH}[.!…]*$"
    r"|^(?:the|this|our|upstream) (?:web |database |origin )?(?:server|database|service) (?:(?:is|was|did|has|does)(?:n't| not)(?: (?:been|currently))* (?:available|respond(?:ing)?|answer(?:ing)?)|(?:is|was) (?:(?:currently|temporarily) )?(?:unavailable|overloaded))"
    r"(?: in time)?(?:[,;.]? (?:please )?try again (?:later|soon|in a few (?:minutes|moments)))?[.!…]*$"
)
_SCRIPTS = r"(?:(?:your )?(?:browser(?:'s)? )?(?:java ?script|js|cookies?|scripts?|scripting)(?: (?:and|or|&) (?:java ?script|js|cookies?|scripts?|scripting))*)"
_IN_BROWSER = r"(?: support)?(?: (?:in|on|by|for) (?:your|this|the) (?:web )?browser(?: settings)?)?"
_USE = rf"(?:run|view|see|use|read|continue|proceed|display|load|reload|access|open|visit|enter|refresh|try again)(?: (?:to|with|using))?(?: {_WHICH})?"
_NOTICE = re.compile(
    rf"^(?:sorry[,.!:-]? ?)?(?:(?:please|you (?:need|have) to|you must|to (?:continue|proceed|{_USE}),?(?: (?:please|you (?:need|have) to|you must))?) )(?:enable|activate|allow|accept|turn on|switch on) {_SCRIPTS}{_IN_BROWSER}(?:,? (?:(?:in order )?to|and(?: then)?|then|before) (?:you (?:can )?)?{_USE})?[.!…]*$"
    rf"|^to (?:continue|proceed|{_USE}),? (?:please )?(?:enable|activate|allow|accept|turn on|switch on) {_SCRIPTS}\b[^.!?]*[.!…]*$"
    rf"|^you (?:must|need to|have to) have {_SCRIPTS} (?:enabled|turned on|switched on|activated)(?: (?:to|in order to) {_USE})?[.!…]*$"
    rf"|^(?:enable|activate|turn on|switch on) {_SCRIPTS}{_IN_BROWSER},? (?:(?:in order )?to|and(?: then)?|then) {_USE}[.!…]*$"
    rf"|^{_WHICH} (?:needs?|requires?|works? only with|does not work without|doesn't work without|cannot be (?:shown|displayed) without) {_SCRIPTS}(?: (?:enabled|to (?:be (?:enabled|on)|{_USE}|work|function)))?{_IN_BROWSER}[.!…]*$"
    rf"|^(?:it (?:seems|looks like|appears) (?:that )?)?{_SCRIPTS} (?:(?:is|are|seems? to be|appears? to be)(?: currently)? (?:required|disabled|blocked|turned off|switched off|not (?:enabled|supported|available))|(?:must|needs? to|has to|have to) be (?:enabled|allowed|turned on|switched on))"
    rf"{_IN_BROWSER}(?: (?:to|for) (?:{_USE}|{_WHICH}))?[.!…]*$"
    rf"|^your (?:web )?browser (?:does not|doesn't|did not) (?:support|allow|accept|run) {_SCRIPTS}[.!…]*$"
    # the polite imperative of other languages
    r"|^(?:bitte )?(?:aktivieren|erlauben) sie (?:java ?script|skripte|cookies)\b[^.!?]*[.!…]*$|^veuillez (?:activer|autoriser) (?:java ?script|les scripts|les cookies)\b[^.!?]*[.!…]*$|^(?:por favor,? )?(?:active|habilite) (?:java ?script|las cookies|los scripts)\b[^.!?]*[.!…]*$"
)
_FILLER = re.compile(r"^(?:(?:your|sample|dummy|placeholder|example) (?:text|copy|paragraph|heading|title|content)(?: (?:goes )?here| for .*)?|(?:text|title|heading|content) goes here|(?:votre|su|tu|ihr) (?:texte|texto|text) (?:ici|aquí|hier))[.!…]*$")
# Page furniture: navigation words (fixed values) and lines of short items between bars.
_NAVIGATION = frozenset("home menu start search login register registrieren faq help boards forum forums foren foros accueil inicio anmelden suche connexion entrar prev previous next zurück weiter log in sign up".split())
_ITEMS = re.compile(r"^(?:\W*[^\W_]+(?: [^\W_]+){0,2}\W*[|»·]\s*)+\W*[^\W_]+(?: [^\W_]+){0,2}\W*$|^powered by \S+(?: [\d.]+)?\W*$|^(?:skip|jump) to (?:main )?content\W*$|^back to (?:the )?(?:top|front page|home ?page|start|index)\W*$")
# Dummy text: the vocabulary of the Latin filler, rows of keys, and stand-ins (fixed values).
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident porta sunt culpa qui officia deserunt mollit anim id est laborum mauris vitae viverra nunc pellentesque".split()
)
_ROWS = ("qwertyuiop", "qwertzuiopü", "azertyuiop", "asdfghjkl", "asdfghjklöä", "zxcvbnm", "yxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_STAND_IN = frozenset("foo bar baz foobar blah bla test testing sample text".split())
_WORD = re.compile(r"[^\W_]+")
# Every message, notice or piece of furniture holds one of these words or signs ("0": any number).
_LOOK = (
    "java javascript js script scripts scripting skripte cookie cookies error http status code fehler erreur id found exist available displayed loaded shown opened reached respond responding unavailable offline "
    "located retrieved processed completed permission access allowed authorized authorised permitted right rights answer answering answered overloaded denied text texte texto copy paragraph heading title content "
    "request unauthorized unauthorised forbidden gateway expired timed connection database server conflict gone implemented acceptable required large unsupported unprocessable insufficient 0 powered skip jump back | » · « »"
).split()


def vocabularies() -> list[np.ndarray]:
    """Token hashes of the words to look for, of Latin filler, of stand-ins and runs of keys, numbers, and navigation."""
    runs = {row[a:b] for row in _ROWS for a in range(len(row)) for b in range(a + 3, len(row) + 1)}
    return [vocabulary(v) for v in (_LOOK, _LATIN, _STAND_IN | runs, ["0"], _NAVIGATION)]


def template_part(own: str) -> bool:
    """True if uncited own words hold a template part that was never filled in."""
    if not _HINT.search(own):
        return False
    t = _CITED.sub(" ", own)
    return bool(_PART.search(t) or _FIELD_LINE.search(t))


def furniture(segment: str) -> bool:
    """True for a piece of page furniture (lower case): navigation, pagers, credits."""
    if _ITEMS.match(segment):
        return True
    words = _WORD.findall(segment)
    return len(words) >= 2 and all(w in _NAVIGATION or w.isdigit() for w in words) and sum(w in _NAVIGATION for w in words) >= 2


def kinds(prints: Prints, joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Per sentence: whether it is a seed (message, notice or filler by its shape alone), and whether it is furniture."""
    look, latin, stand, numbers, navigation = prints.hits
    mashed = np.minimum(stand + prints.runs, prints.words - numbers)  # a word may be a run of keys and of one letter
    seeds = ((latin >= 3) & (latin >= 0.8 * prints.words)) | ((mashed + numbers >= prints.words) & (4 * mashed >= prints.words))
    pieces = (navigation >= 2) & (navigation + numbers >= prints.words)
    for k in np.flatnonzero((look > 0) & ~seeds & ~pieces):
        s = joined[prints.begin[k] : prints.end[k]]
        if _ITEMS.match(s):
            pieces[k] = True
        elif _ERROR.match(s) or _NOTICE.match(s) or _FILLER.match(s):
            seeds[k] = True
    return seeds & ~pieces, pieces


# What marks a slot of a template: symbols, not the brackets and stops of plain writing.
_SYMBOL = r"[{}\[\]<>%$#@|~^*_=+/\\:!&§]"
_LETTERS = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
# A member speaking: no message that came with the page (fixed values).
_PERSONAL = frozenset("i my me mine im ive ich mein meine meinen mir mich je mon ma mes moi yo mi mis me".split())
ALIKE = 0.8


def slots(own: str) -> set[tuple[str, str, str]]:
    """``before, name, after`` of every template part outside of citations: its own words and the words around it."""
    t = _CITED.sub(" ", own)
    return {_around(t, m.start(), m.end()) for m in _PART.finditer(t) if _LETTERS.search(m.group())}


def _around(t: str, start: int, end: int) -> tuple[str, str, str]:
    line, stop = t.rfind("\n", 0, start) + 1, t.find("\n", end)
    before, after = _LETTERS.findall(t[line:start]), _LETTERS.findall(t[end : stop if stop >= 0 else len(t)])
    return (before[-1].lower() if before else "", " ".join(_LETTERS.findall(t[start:end])).lower(), after[0].lower() if after else "")


def holds_slot(own: str, known: set[tuple[str, str, str]]) -> bool:
    """True if a part named like one of ``known`` stands between symbols, uncited, between the same words."""
    t = _CITED.sub(" ", own)
    for name in {k[1] for k in known}:
        inner = r"[ _]".join(map(re.escape, name.split()))
        for m in re.finditer(rf"{_SYMBOL}+ ?{inner} ?{_SYMBOL}+", t, re.I):
            before, _, after = _around(t, m.start(), m.end())
            if (before, name, after) in known:
                return True
    return False


def sentences(own: str) -> set[str]:
    """Sentences of own words, lower case, furniture aside."""
    parts = (p.strip() for p in _SENTENCE.split(own.lower()))
    return {p for p in parts if p and not furniture(p)}


def says_the_same(sentence: str, known: set[str]) -> bool:
    """True if a known sentence has the same words but for a fifth of them (all of them below five words), none of a member's own voice."""
    words = _LETTERS.findall(sentence)
    for k in known:
        theirs = _LETTERS.findall(k)
        if words == theirs:
            return True
        if min(len(words), len(theirs)) < 5 or _PERSONAL & (set(words) - set(theirs)):
            continue
        if SequenceMatcher(None, words, theirs, autojunk=False).ratio() >= ALIKE:
            return True
    return False
