"""The consistent form of text: what a reader sees, in ordinary characters.

The tables are built from Unicode's own data (``unicodedata``) by rule; only the
look-alike letters, which Unicode does not define, are listed.

Rules
-----
* full-width forms, ligatures and other compatibility forms of Latin letters and
  digits become those letters and digits (superscript digits and fractions stay);
* every space separator becomes an ordinary space; format characters (zero-width
  characters, soft hyphens, joiners, marks of direction) disappear;
* typographic hyphens become ``-`` (the en dash stays);
* a base letter and the combining marks behind it become one composed letter;
* look-alike Greek and Cyrillic letters become Latin ones.  Greek letters of the
  kept set and whole words of genuine Cyrillic stay (see :func:`keep_cyrillic`).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# The Greek letters that are ordinary in this domain.
KEPT_GREEK = "αβγδκμΔ"
# Look-alike letters. Greek on the left, Latin on the right.
GREEK_LOOKALIKES = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
#: Greek letters that look Latin only inside a word that has Latin letters.
GREEK_IN_LATIN_WORDS = dict(zip("νρτυχιω", "vptuxiw"))
# Cyrillic on the left, Latin on the right.
CYRILLIC_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХЬаеѕіјорсухһԁԛԝЁёЇї",
        "ABESIJKMHOPCTYXbaesijopcyxhdqwËëÏï",
    )
)
#: Cyrillic letters that look Latin only inside a word that has Latin letters.
CYRILLIC_IN_LATIN_WORDS = dict(zip("кмтвнгпЗз", "kmtbhrn33"))
# Hyphens and other signs with an ordinary equivalent.
SIGNS = {
    "‐": "-", "‑": "-", "−": "-", "﹣": "-", "µ": "μ", "∆": "Δ",
    " ": "\n", " ": "\n", "\u0085": "\n", "ʼ": "'", "∕": "/", "⁄": "/", "∶": ":",
}
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
#: Invisible without being format characters: fillers and variation selectors.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x180F)}


class MappingConflict(ValueError):
    """Two rules give one source different targets, or a target is itself a source."""


def _single_rules() -> dict[str, str]:
    """Source character -> target, for everything that doesn't depend on its word."""
    rules: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if rules.setdefault(source, target) != target:
            raise MappingConflict(f"{source!r}: {rules[source]!r} and {target!r}")

    for source, target in SIGNS.items():
        add(source, target)
    for source, target in GREEK_LOOKALIKES.items():
        add(source, target)
    plain = re.compile(r"[!-~ ]+")
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if ch in rules or ch in SUPERSCRIPTS:
            continue
        kind = unicodedata.category(ch)
        if kind == "Zs":
            add(ch, " ")
        elif kind == "Cf" or code in _INVISIBLE:
            add(ch, "")
        elif 0xFB00 <= code <= 0xFB06 or 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF or 0x2100 <= code <= 0x2188:
            folded = unicodedata.normalize("NFKC", ch)
            if plain.fullmatch(folded) and unicodedata.category(ch)[0] in "LNPSZ" and kind != "No" and ch not in "™℠№℃℉":
                add(ch, folded)
    for code in range(0x20000):  # single letters that compose to something else (Å, K)
        ch = chr(code)
        if ch not in rules and (nfc := unicodedata.normalize("NFC", ch)) != ch and len(nfc) == 1:
            add(ch, nfc)
    for target in rules.values():
        if any(c in rules for c in target):
            raise MappingConflict(f"a target that is itself a source: {target!r}")
    return rules


@lru_cache(maxsize=1)
def rules() -> dict[str, str]:
    return _single_rules()


#: Ranges of the characters that are in the consistent form wherever they stand. Few, and
#: Latin-1 first: a regex tests them one after the other.
PLAIN_RANGES = [
    (0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0xB4), (0xB6, 0xFF), (0x100, 0x24F), (0x3B1, 0x3B4),
    (0x3BA, 0x3BA), (0x3BC, 0x3BC), (0x394, 0x394), (0x2013, 0x2014), (0x2018, 0x201F), (0x2026, 0x2026), (0x2070, 0x2079),
    (0x2080, 0x2089), (0x2264, 0x2265),
]
#: Regex, for Java and Python alike, of a character that may not be in the consistent
#: form. A text without a match is in that form as it is.
SUSPICIOUS = "[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in PLAIN_RANGES) + "]"


def keep_cyrillic(word: str, before: str, after: str) -> bool:
    """Whether a word with Cyrillic letters is genuine and kept.

    Genuine is a word of Cyrillic letters alone of which one has no Latin look-alike;
    one of look-alikes only is genuine beside a genuine word, and a disguise elsewhere.
    """
    def genuine(w: str) -> bool:
        return bool(w) and all("Ѐ" <= c <= "ԯ" or unicodedata.combining(c) for c in w) and any(
            c not in CYRILLIC_LOOKALIKES and not unicodedata.combining(c) for c in w
        )

    if genuine(word):
        return True
    pure = all("Ѐ" <= c <= "ԯ" for c in word)
    return pure and len(word) > 1 and (genuine(before) or genuine(after))


@lru_cache(maxsize=2)
def _tables(entity: bool) -> tuple[dict[int, str], dict[int, str]]:
    always = {ord(k): v for k, v in rules().items()}
    in_word = {ord(k): v for m in (CYRILLIC_LOOKALIKES, CYRILLIC_IN_LATIN_WORDS, GREEK_IN_LATIN_WORDS) for k, v in m.items()}
    return (always | in_word if entity else always), in_word


_CLUSTER = re.compile(r"[^\W\d_][̀-ͯ]+")


@lru_cache(maxsize=4096)
def _compose(cluster: str) -> str:
    return unicodedata.normalize("NFC", cluster)


def consistent_entity(s: str) -> str:
    """The consistent form of an entity name: no Cyrillic word is genuine in one."""
    t = s.translate(_tables(True)[0])
    if not t.isascii():
        t = _CLUSTER.sub(lambda m: _compose(m[0]), t)
    return t


_SUSPECT = re.compile(SUSPICIOUS)


def suspicious(s: str) -> bool:
    """Whether :data:`SUSPICIOUS` matches, for Python callers."""
    return _SUSPECT.search(s) is not None
