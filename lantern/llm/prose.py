"""From a raw text to the words of its running prose.

Line by line: fences, logs, commands, configuration, tables, headings and markup go; a line break inside a paragraph
doesn't end a sentence, a list item or a turn of a chat does.  What is left is cut into sentences, and identifiers are
left out of them.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

#: Texts repeat their words: what a word gives is kept for so many of them per Python worker.
KEPT = 1 << 16

_BLOCK = re.compile(r"</?(?:p|div|br|h[1-6]|ul|ol|table|tr|pre|section|article|blockquote)\b[^>]*>", re.I)
_ITEM_TAG = re.compile(r"<li\b[^>]*>", re.I)
_HEAD_TAG = re.compile(r"<(h[1-6]|pre|code|script|style|table)\b[^>]*>.*?</\1>", re.I | re.S)
_TAG = re.compile(r"</?[a-z][^<>]{0,200}>|<[A-Z*]{1,12}>", re.S)
_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s|^\s*[=\-_*]{3,}\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+\u2022]|\d{1,3}[.)])\s+")
_CHAT = re.compile(r"^\s*[\[(]?\d{1,2}:\d{2}(?::\d{2})?[\])]?\s+<?[\w.\-]{1,30}>?:\s+")
_QUOTE = re.compile(r"^\s*>+\s?")
_KEY = re.compile(r"^\s*[\w.\-\"']+\s*[:=]\s*\S*\s*$|^\s*[\w.\-]+\s+=\s|^\s*\[[^\]]*\]\s*$")
_CODE = re.compile(r"\w=\S|[{}]|\s--?\w+|\w\(\S*\)|::|\s/\w+/\w|^\s*at\s+\S+\(|\s\|\s|;\s*$|=>|&&|^\s*\$\s|\d\d:\d\d:\d\d")
_LEVEL = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\S*\s+)?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|warn|level=)\b")
_WORDLIKE = re.compile(r"^[(\"'\u2018\u201c]*[^\W\d_]+(?:['\u2019\-][^\W\d_]+)*[)\"'\u2019\u201d.,;:!?]*$")
_SHORTENED = re.compile(r"\b(e\.g|i\.e|E\.g|I\.e|etc|vs|cf|approx|Dr|Mr|Mrs|Fig)\.")
_END = re.compile(r"(?<=[.!?\u3002\uff01\uff1f])[\"'\u2019\u201d)\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*")


@lru_cache(KEPT)
def _wordlike(part: str) -> bool:
    return bool(_WORDLIKE.match(part)) and not (len(part) > 3 and part.isupper())


def _is_prose(line: str, going_on: bool) -> bool:
    if _KEY.match(line) or _LEVEL.match(line):
        return False
    parts = line.split()
    # Capitals mark a constant or a level only among other letters: a line all in capitals, or what goes on from one, may be prose.
    if line.isupper() and (len(parts) >= 4 or going_on):
        parts = line.lower().split()
    share = sum(map(_wordlike, parts)) / len(parts)
    return share >= (0.85 if _CODE.search(line) else 0.55)


def paragraphs(text: str) -> list[str]:
    """The paragraphs, list items and chat turns of running prose."""
    if "<" in text and ">" in text:
        text = _HEAD_TAG.sub("\n\n", text)
        text = _TAG.sub(" ", _ITEM_TAG.sub("\n\n- ", _BLOCK.sub("\n\n", text)))
    if "&" in text:
        text = html.unescape(text)
    out: list[str] = []
    current: list[str] = []
    fenced = False

    def close() -> None:
        if current:
            out.append(" ".join(current))
            current.clear()

    for line in text.splitlines():
        if _FENCE.match(line):
            fenced = not fenced
            close()
            continue
        if fenced:
            continue
        line = _QUOTE.sub("", line)
        if not line.strip() or _HEADING.match(line):
            close()
            continue
        for mark in (_CHAT, _ITEM):
            if m := mark.match(line):
                close()
                line = line[m.end() :]
                break
        if not line.strip():
            continue
        if _is_prose(line, bool(current)):
            current.append(" ".join(line.split()))
        else:
            close()
    close()
    return out


_CODED = re.compile(r"[\d_/=@\\<>{}#.]|-.*-|[a-z][A-Z]", re.S)


@lru_cache(KEPT)
def _words_of(token: str) -> tuple[str, ...]:
    """The words of a token; none of an identifier, a number or a symbol."""
    bare = token.strip("()[]\"'\u2018\u2019\u201c\u201d.,;:!?")
    return () if _CODED.search(bare) or any(map(str.isdigit, bare)) else tuple(_WORD.findall(bare))


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of the prose; identifiers, numbers and symbols are not words."""
    out = []
    for part in paragraphs(text):
        part = _SHORTENED.sub(lambda m: m.group(1).replace(".", ""), part)
        for s in _END.split(part):
            ws = []
            for token in s.split():
                ws += _words_of(token)
            if ws:
                out.append(ws)
    return out


_VOWELS = re.compile(r"[aeiouy]+")


@lru_cache(KEPT)
def syllables(word: str) -> int:
    """Vowel groups, without a silent final e."""
    w = word.lower()
    n = len(_VOWELS.findall(w))
    if n > 1 and w.endswith("e") and not w.endswith(("le", "ee", "ie", "ye")):
        n -= 1
    elif n > 1 and w.endswith("ed") and not w.endswith(("ted", "ded")):
        n -= 1
    elif n > 1 and w.endswith("es") and not w.endswith(("ses", "zes", "xes", "ches", "shes", "ges", "ces")):
        n -= 1
    return max(1, n)


#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were that it for on with as by at from this be are or not an which their its has have had but they we you a i he she his her our your can will would there than then when if so no do did does".split(),
    "de": "der die das und ist nicht ein eine mit auf f\u00fcr von zu den dem des im wurde war sich auch nach bei aus wird".split(),
    "fr": "le la les des et est une dans pour que du au aux sur pas plus avec ne en un il elle a \u00e9t\u00e9 d'abord puis".split(),
    "es": "el la los las de y en que un una por con del al se para no es su m\u00e1s fue lo despu\u00e9s a\u00fan".split(),
    "it": "il lo gli della che di e \u00e8 per con una sono nel non del alla".split(),
    "nl": "de het een en van is niet dat op met voor zijn wordt aan ook".split(),
    "pt": "o os da do em que uma para com n\u00e3o por mais dos das foi".split(),
}
#: The languages that each of these words belongs to.
_SPOKEN = {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v) for v in FUNCTION_WORDS.values() for w in v}


def is_english(words: list[str]) -> bool:
    """Mostly Latin letters, and more English function words than those of any other language here."""
    if not words:
        return False
    low = [w.lower() for w in words]
    if sum(w[0] < "\u0250" for w in low) < 0.85 * len(low):
        return False
    hits = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in low:
        for k in _SPOKEN.get(w, ()):
            hits[k] += 1
    return hits["en"] >= 0.06 * len(low) and hits["en"] >= max(v for k, v in hits.items() if k != "en")
