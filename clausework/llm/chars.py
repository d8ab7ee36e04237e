"""One consistent form for texts that look the same.

Canonical text: canonical composition, full-width and half-width forms at their usual width, every blank one
plain space, no characters that nobody sees, ligatures of f and l opened, look-alike letters in the script of
their word. The skeleton of a text maps every look-alike letter to one prototype, so that two texts look the same
exactly if their skeletons are equal.
"""

from __future__ import annotations

import re
import unicodedata

#: Letters of the Cyrillic and Greek scripts that are drawn like a Latin letter.
LOOK_ALIKES = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅҺԚԜаеорсухіјѕһԛԝԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
        "ABEKMHOPCTYXIJSHQWaeopcyxijshqwdABEZHIKMNOPTYXo",
        strict=True,
    )
)
#: Code point ranges of characters that take no room: soft hyphen, joiners, fillers, direction marks, variation
#: selectors, byte-order mark.
INVISIBLE_RANGES = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0)]
#: Blanks of any width that are no line ends.
BLANK_RANGES = [(0x9, 0x9), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: Ligatures of Latin letters and forms of other width; their compatibility form looks the same.
WIDE_RANGES = [(0xFB00, 0xFB06), (0xFF01, 0xFF9F), (0xFFA1, 0xFFDC), (0xFFE0, 0xFFEE)]


def _chars(ranges: list[tuple[int, int]]) -> set[str]:
    return {chr(c) for a, b in ranges for c in range(a, b + 1)}


def _not_quick() -> set[str]:
    """Characters whose quick check for canonical composition is No or Maybe, and all combining marks."""
    every = [chr(c) for c in (*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20))]
    out = {c for c in every if unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c)}
    for c in every:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return out | _chars([(0x1100, 0x11FF)])  # conjoining jamo


def _class(chars: set[str]) -> str:
    """The characters as ranges of a regular expression's class."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in out)


INVISIBLE, BLANKS, WIDE = _chars(INVISIBLE_RANGES), _chars(BLANK_RANGES), _chars(WIDE_RANGES)
_UNSTABLE_CLASS = _class(INVISIBLE | BLANKS | WIDE | _not_quick())
#: A run of unstable characters with the stable one before it, with which the first of them may compose.
_SEGMENT = re.compile(f"[^{_UNSTABLE_CLASS}]?[{_UNSTABLE_CLASS}]+", re.DOTALL)
_DROP_AND_BLANK = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in BLANKS}
_WIDE = re.compile(f"[{_class(WIDE)}]+")


def _with_marks() -> dict[str, str]:
    """Letters with marks whose bare letter has a look-alike, as the look-alike with the same marks: ё as ë, ї as ï."""
    out = {}
    for c in map(chr, range(0x370, 0x530)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in LOOK_ALIKES:
            out[c] = unicodedata.normalize("NFC", LOOK_ALIKES[base] + "".join(marks))
    return out


#: Every letter that is drawn like a Latin one, with marks too.
TO_LATIN = LOOK_ALIKES | _with_marks()
_TO_LATIN = str.maketrans(TO_LATIN)
_LATIN_TO_CYRILLIC = str.maketrans({latin: other for other, latin in TO_LATIN.items() if "Ѐ" <= other <= "ӿ" and len(latin) == 1})
_GREEK = re.compile("[Ͱ-Ͽ]")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN_ONLY = re.compile(f"[A-Za-zÀ-ɏ]")
_FOREIGN = re.compile("[Ͱ-ӿԀ-ԯ]")


def _quick_check(text: str) -> bool:
    """True if the text is certainly in the stable form: no unstable character in it."""
    return _SEGMENT.search(text) is None


def _settle(match: re.Match) -> str:
    segment = match[0].translate(_DROP_AND_BLANK)
    segment = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), segment)
    return unicodedata.normalize("NFC", segment)


def stable(text: str) -> str:
    """Composition, width, blanks and invisible characters settled; only unstable segments are touched.

    A segment starts with the stable character before it. Where a dropped character stood between a letter and
    its mark the whole segment is composed at once, so the result does not depend on what was dropped. Runs of
    blanks stay as long as they are.
    """
    if _quick_check(text):
        return text
    out = _SEGMENT.sub(_settle, text)
    # what was dropped or opened may have brought a mark next to an earlier letter
    return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


def skeleton(text: str) -> str:
    """The stable form with each look-alike letter as its Latin prototype."""
    return stable(text).translate(_TO_LATIN)


def _home_script(match: re.Match) -> str:
    """A word of several scripts in the script of its letters that have no double, else of most of its letters."""
    word = match[0]
    if not _FOREIGN.search(word):
        return word
    latin = [c for c in word if _LATIN_ONLY.match(c)]
    own_foreign = [c for c in word if _FOREIGN.match(c) and c not in LOOK_ALIKES]
    if not latin and not _GREEK.search(word):
        return word
    own_latin = [c for c in latin if ord(c) not in _LATIN_TO_CYRILLIC]
    cyrillic = len(own_foreign) > len(own_latin) or (len(own_foreign) == len(own_latin) and 2 * len(latin) < len(word))
    as_latin = word.translate(_TO_LATIN)
    return as_latin.translate(_LATIN_TO_CYRILLIC) if cyrillic else as_latin


def canonical(text: str) -> str:
    """The stable form with the look-alike letters of mixed words in the script of the word."""
    out = stable(text)
    return _WORD.sub(_home_script, out) if _FOREIGN.search(out) else out
