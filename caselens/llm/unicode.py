"""Look-alike characters: one plain form of a value, word by word in the word's own script."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԚԜҮӀаеорсухѕіјԁԛԝһӏ", "ABESIJKMHOPCTYXQWYIaeopcyxsijdqwhl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυκχ", "ABEZHIKMNOPTYXovaipukx"))
OTHER = dict(zip("ɑɡոօս", "agnou"))
# Arabic code points and what an Urdu keyboard gives instead.
URDU = dict(zip("كيىهةۀ", "کییہۃۂ"))
# Characters that show nothing although their category is not Cf.
SILENT = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ⠀"

_BACK = {
    "CYRILLIC": {v: k for k, v in reversed(CYRILLIC.items())},
    "GREEK": {v: k for k, v in reversed(GREEK.items())},
}
_TO_LATIN = CYRILLIC | GREEK | OTHER
_URDU = str.maketrans(URDU)
_ODD = re.compile(r"[^\x21-\x7e ]|  |^ | $")


def silent(ch: str) -> bool:
    """Whether a character shows nothing and takes no room."""
    return (
        ch in SILENT
        or "︀" <= ch <= "️"
        or "\U000e0100" <= ch <= "\U000e01ef"
        or (unicodedata.category(ch) in ("Cf", "Cc", "Cs", "Cn", "Co") and not ch.isspace())
    )


def _script(ch: str) -> str:
    return unicodedata.name(ch, "").partition(" ")[0]


def _counts(word: str) -> dict[str, int]:
    """Letters of ``word`` that no other of the three scripts has, by script."""
    out: dict[str, int] = {}
    for ch in unicodedata.normalize("NFD", word):
        if not ch.isalpha():
            continue
        s = _script(ch)
        if s == "LATIN" and (ch in _BACK["CYRILLIC"] or ch in _BACK["GREEK"]):
            continue
        if s in ("LATIN", "CYRILLIC", "GREEK") and ch not in _TO_LATIN:
            out[s] = out.get(s, 0) + 1
    return out


def _own_script(word: str, around: str) -> str:
    """Latin, Cyrillic or Greek: the script of the letters that only it has, else that of the value, else Latin."""
    have = _counts(word)
    if not have:
        letters = {_script(c) for c in word if c.isalpha()}
        # all letters are ambiguous: the value around decides, and a word with Latin letters stays Latin
        return around if around in letters and "LATIN" not in letters else "LATIN"
    return max(sorted(have), key=lambda s: (have[s], s == "LATIN"))


def plain_form(value: str | None, composed: bool = True) -> str | None:
    """The one plain form of ``value``; null stays null, and a plain value comes back as it is.

    Compatibility forms (full width, mathematical, ligatures, presentation forms) become ordinary letters, accents
    are composed, silent characters go, digits, hyphens and spaces become the ASCII ones, Arabic code points become
    those of an Urdu keyboard, and every word gets the letters of its own script. Without ``composed`` only letters
    are mapped: accents and silent characters stay as they were typed.
    """
    if value is None or not _ODD.search(value):
        return value
    if composed:
        s = "".join(c for c in unicodedata.normalize("NFKC", value) if not silent(c))
        s = unicodedata.normalize("NFC", s)
    else:
        s = "".join(c if unicodedata.combining(c) or silent(c) else unicodedata.normalize("NFKC", c) for c in value)
    if any("؀" <= c <= "ۿ" for c in s):
        s = s.translate(_URDU).replace("یٔ", "ئ").replace("ـ", "")
        s = unicodedata.normalize("NFC", s) if composed else s
    out = []
    for c in s:
        kind = unicodedata.category(c)
        if kind == "Nd":
            c = str(unicodedata.digit(c))
        elif kind == "Pd" or c == "−":
            c = "-"
        elif c.isspace():
            c = " "
        out.append(c)
    words = "".join(out).split()
    if any(c in _TO_LATIN for w in words for c in unicodedata.normalize("NFD", w)):
        have = _counts(" ".join(words))
        around = max(sorted(have), key=lambda k: (have[k], k == "LATIN")) if have else "LATIN"
        fixed = []
        for w in words:
            if w.isascii():
                if around != "LATIN" and len(words) > 1 and _counts(w):
                    fixed.append(w)
                    continue
                if around == "LATIN":
                    fixed.append(w)
                    continue
            own = _own_script(w, around)
            table = _TO_LATIN if own == "LATIN" else _BACK.get(own, {})
            w = "".join(table.get(c, c) for c in unicodedata.normalize("NFD", w))
            fixed.append(unicodedata.normalize("NFC", w) if composed else w)
        words = fixed
    return " ".join(words)
