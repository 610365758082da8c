"""The variants of a raw token as ``text.token_variants`` makes them, for code that meets tokens in Arrow batches."""

from __future__ import annotations

import re
import sys
import unicodedata


def _class(category: str) -> str:
    """The characters of a category, as ranges of a character class."""
    out, first, last = [], -1, -2
    for c in [*(c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == category), -1]:
        if c != last + 1:
            if first >= 0:
                out.append(f"{chr(first)}-{chr(last)}")
            first = c
        last = c
    return "".join(out)


LOWER, UPPER = _class("Ll"), _class("Lu")
CAMEL = (re.compile(f"([{LOWER}0-9])([{UPPER}])"), re.compile(f"([{UPPER}]+)([{UPPER}][{LOWER}])"))
SEPARATORS = [re.compile(x) for x in (r"[/\\]", r"[/\\.]", r"[/\\_\-]", r"[/\\._\-]")]
WORDS = re.compile(r"[/\\._\- ]")
PLAIN = re.compile(r"[^/\\._\-A-Z]+")


def variants(token: str) -> tuple[str, ...]:
    """Distinct lower-case forms of a raw token: whole, path, dotted, underscored and camel-case parts."""
    if token.isascii() and PLAIN.fullmatch(token):
        return (token,)
    parts = {token}
    for s in SEPARATORS:
        parts.update(s.split(token))
    words = CAMEL[1].sub(r"\1 \2", CAMEL[0].sub(r"\1 \2", token))
    parts.update(WORDS.split(words))
    return tuple({p.lower() for p in parts if p})
