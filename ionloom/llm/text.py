"""Text normalisation shared by the text operators (runs in Arrow batches)."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
#: Soft hyphen, zero-width and direction marks, byte order mark, variation selectors.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_TOKEN = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """NFKC, without invisible characters, mark-up tags and entities; case kept."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _TAG.sub(" ", text) if "<" in text else text


def tokens(text: str) -> list[str]:
    """Runs of letters and digits in lower case; case, punctuation, spacing,
    mark-up and Unicode form leave no trace."""
    return _TOKEN.findall(plain(text).casefold())


def words_of_tokens(text: str) -> tuple[list[str], list[int]]:
    """tokens, and for each the number of the blank-separated word it lies in."""
    out: list[str] = []
    at: list[int] = []
    for n, word in enumerate(plain(text).casefold().split()):
        for token in _TOKEN.findall(word):
            out.append(token)
            at.append(n)
    return out, at
