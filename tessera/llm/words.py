"""Word extraction and word hashing shared by the text operators (run inside tasks)."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufe00-\ufe0f\ufeff]")
_LINK_TARGET = re.compile(r"\]\([^)\s]*(?:\s+(?:\"[^\"]{0,200}\"|'[^']{0,200}'))?\)")
_INLINE_TAG = re.compile(r"</?(?:b|i|em|strong|span|u|s|code|a|sup|sub|mark|small|kbd|wbr|font|del|ins|tt|big|abbr|var|cite|samp)\b[^>]{0,200}>", re.I)
_OTHER_TAG = re.compile(r"</?[a-z][a-z0-9]{0,10}\b[^>]{0,200}>", re.I)
_INNER_MARK = re.compile(r"(?<=[^\W_])[*`~]+(?=[^\W_])")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑](?:[ \t]*\r?\n[ \t>|#*/;%]*)?(?=[^\W\d_])")
_SOFT_WRAP = re.compile("\u00ad[ \\t]*\\r?\\n[ \\t>|#*/;%]*(?=[^\\W\\d_])")
_MARKER = re.compile(r"\[\d+\]")

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker keeps; beyond it the cache starts anew.
_CACHE_WORDS = 500_000


def plain_words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased, with nothing undone."""
    return WORD.findall(text.lower())


def reading_words(text: str) -> list[str]:
    """The words as read, whatever the case, punctuation, wrapping, markup or typesetting.

    Character references, compatibility forms (ligatures, full width), invisible characters, inline
    tags, link targets, citation markers and emphasis inside words are undone; a hyphen between letters
    joins them, at a line end or not (marks of quotes and comments may open the next line), so that wrapped and hyphenated
    spellings agree. Case is folded, so that capitals of a sharp s agree with it.
    """
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if "\u00ad" in text:
            text = _SOFT_WRAP.sub("", text)
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "](" in text:
        text = _LINK_TARGET.sub(" ", text)
    if "<" in text:
        text = _OTHER_TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "*" in text or "`" in text or "~" in text:
        text = _INNER_MARK.sub("", text)
    if "-" in text or "‐" in text or "‑" in text:
        text = _HYPHEN.sub("", text)
    if "[" in text:
        text = _MARKER.sub(" ", text)
    return WORD.findall(text.casefold())


class WordHasher:
    """64-bit hashes of words, each distinct word hashed once per worker."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of word hashes; none if it is shorter than ``k``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * _STEP + words[j : j + n]
    return mix(h)
