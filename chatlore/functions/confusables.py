"""Characters that a loosely written letter also stands for.

A lower-case ASCII letter in a query matches itself, its upper case, every character whose Unicode
compatibility decomposition or character name says that it is a form of that letter (accented,
circled, squared, parenthesized, mathematical, small capital, turned, subscript ...), and a few
characters of other scripts that merely look like it.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

# Look-alikes from other scripts, and letters that their names don't tell, by letter.
LOOK_ALIKES = {
    "a": "ﾑคαаልДάव", "b": "乃๒въጌБ", "c": "¢ςсርɔҀↃ", "d": "∂๔ↁዕ", "e": "乇ﻉєэቿЄЁеЀ⋷⋶已∈ё", "f": "ｷिቻŦɟꟻ",
    "g": "ﻭﻮБኗƃ", "h": "んнђЂዘН", "i": "ﾉٱιเіጎϊІЇїίΪί", "j": "ﾌﻝנןјጋЈɾ", "k": "ズᛕкጕЌ", "l": "ﾚረן⅃", "m": "ﾶ๓мጠМ",
    "n": "刀กηภиክИ", "o": "ѻσ๏оዐةόбਠФēૅ", "p": "ｱρקрየРᴩꟼ", "q": "۹ợዒ", "r": "尺ягѓዪЯ", "s": "丂รѕነЅꙅꙄ", "t": "ｲՇтፕГ",
    "u": "પυยцሁЦϋύᵾ", "v": "√۷νשሀ𐌡", "w": "ฝωฬшሠЩ", "x": "ﾒซχאхሸЖ", "y": "ﾘץуЎሃӳӲЧ", "z": "乙չጊ",
}
_NAME = re.compile(
    r"(?:^|\s)LATIN (?:SMALL|CAPITAL|LETTER SMALL CAPITAL|LETTER|SUBSCRIPT SMALL) (?:LETTER )?(?:(?:TURNED|REVERSED|DOTLESS|OPEN|SCRIPT|CLOSED|SMALL CAPITAL|INSULAR) )*([A-Z])(?: WITH .*)?$"
    r"|^TAG LATIN (?:SMALL|CAPITAL) LETTER ([A-Z])$|^REGIONAL INDICATOR SYMBOL LETTER ([A-Z])$"
    r"|^(?:MODIFIER LETTER (?:SMALL|CAPITAL)|SUPERSCRIPT LATIN SMALL LETTER|LATIN SUBSCRIPT SMALL LETTER) (?:(?:TURNED|REVERSED) )?([A-Z])$"
    r"|^(?:NEGATIVE )?(?:CIRCLED|SQUARED|PARENTHESIZED) LATIN (?:SMALL|CAPITAL) LETTER ([A-Z])$")


@functools.lru_cache(maxsize=1)
def table() -> dict[str, str]:
    found: dict[str, set[str]] = {c: set(LOOK_ALIKES[c]) for c in LOOK_ALIKES}
    for n in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= n < 0xE000 or 0x30000 <= n < 0xE0000:
            continue
        c = chr(n)
        name = unicodedata.name(c, "")
        if not name:
            continue
        letter = None
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).strip("()").lower()
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            letter = plain
        elif ("LATIN" in name or "LETTER" in name) and (m := _NAME.search(name)):
            letter = next(x for x in m.groups() if x).lower()
        if letter:
            found[letter].add(c)
    return {c: "".join(sorted(s - set(map(chr, range(128))))) for c, s in found.items()}


@functools.lru_cache(maxsize=64)
def letter_class(c: str) -> str:
    """Regular-expression class (for Java and RE2) of all forms of a lower-case letter."""
    codes = sorted(map(ord, table()[c]))
    parts, k = [c, c.upper()], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(rf"\x{{{codes[k]:X}}}" + (rf"-\x{{{codes[j]:X}}}" if j > k else ""))
        k = j + 1
    return f"[{''.join(parts)}]"
