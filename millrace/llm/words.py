"""Words of a text as the operators on text compare them."""

from __future__ import annotations

import html
import re
import unicodedata

#: A run of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Elements whose tags leave no gap between the characters around them.
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr"
_INLINE = frozenset(INLINE.split())
_TAG = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*|/)?)>", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_LINK = re.compile(r"(?<=\])\((?:[a-z]+:|/|#|\.)[^()\s]*(?:\s+\"[^\"]*\")?\)", re.I)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_BROKEN = re.compile(r"(?<=[^\W_])[-‐‑][ \t]*\r?\n[ \t>|#*]*(?=[^\W_])")


def _tag(m: re.Match) -> str:
    return "" if m[2] and m[2].lower() in _INLINE else " "


def plain(text: str) -> str:
    """Lower-cased text without markup, entities, invisible characters, and breaks inside words after a hyphen."""
    if "<" in text:
        text = _TAG.sub(_tag, text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
        if "&" in text:
            text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "](" in text:
        text = _LINK.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    if "-\n" in text or "-\r" in text or "- \n" in text or "‐" in text or "‑" in text:
        text = _BROKEN.sub("", text)
    return text.lower()


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))
