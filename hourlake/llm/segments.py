"""Cutting texts where the byte-level pre-tokenizers certainly cut them."""

from __future__ import annotations

import re

#: White space other than blank and newline; what counts as such differs between regex libraries.
ODD_SPACE = re.compile(r"[^\S \n]")
PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
CAREFUL = re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")


def segments(text: str) -> list[str]:
    """Pieces of ``text`` between which no pre-token lies; joined they are the text.

    A pre-token is a white-space run or holds none but its first blank, so a cut before a blank or
    newline that follows another character is safe. Texts with other white space are cut only
    between ASCII letters or digits around a blank.
    """
    return CAREFUL.split(text) if ODD_SPACE.search(text) else PLAIN.findall(text)
