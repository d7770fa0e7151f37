"""The ranking tokens of ``text.tokens`` as a plain function, for workers that cut and count in one go. Tokens are UTF-8."""

from __future__ import annotations

import re
import unicodedata

_ASCII = re.compile(rb"[a-z]+|[0-9]+(?:[.,][0-9]+)?")
_MIXED = re.compile("[฀-๿]+|[a-z]+|\\d+(?:[.,]\\d+)?")
_DIGIT = re.compile(rb"[0-9]")
#: Letters A-Z in lower case, all other bytes but a-z as spaces; and the same but for digits and what may stand between them.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Latin-1 bytes that normalisation or folding may change to other letters than their own kind: signs, and multiplication and division.
_SIGNS = bytes([*range(0x80, 0xC0), 0xD7, 0xF7])


def cut(text: str | None) -> list[bytes]:
    """NFKC, case folding, then runs of Thai (as their bigrams and trigrams), Latin letters or digits. Texts of ASCII and Latin letters with marks need neither step: the marks end a run, and a sharp s is two."""
    if not text:
        return []
    try:
        data = text.encode("latin-1")
        plain = text.isascii() or len(data.translate(None, _SIGNS)) == len(data)
    except UnicodeEncodeError:
        plain = False
    if plain:
        if b"\xdf" in data:
            data = data.replace(b"\xdf", b"ss")
        return _ASCII.findall(data.translate(_LOWER)) if _DIGIT.search(data) else data.translate(_LETTERS).split()
    out: list[bytes] = []
    for run in _MIXED.findall(unicodedata.normalize("NFKC", text).casefold()):
        if "฀" <= run[0] <= "๿" and len(run) > 1:
            out += [run[i : i + n].encode() for n in (2, 3) for i in range(len(run) - n + 1)]
        else:
            out.append(run.encode())
    return out
