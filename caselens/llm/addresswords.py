"""Postal addresses as people type them: typed tokens and their affine-gap alignment."""

from __future__ import annotations

import re
from functools import lru_cache

from caselens.functions.script import skeleton
from caselens.llm.namewords import _near
from caselens.llm.unicode import plain_form

# Words for the kinds of premises.
KINDS = {
    "house": "house", "h": "house", "hno": "house", "makan": "house", "ghar": "house", "مکان": "house", "گھر": "house", "م": "house",
    "shop": "shop", "sh": "shop", "dukan": "shop", "دکان": "shop", "plot": "plot", "p": "plot", "پلاٹ": "plot", "flat": "flat", "فلیٹ": "flat",
}
# Abbreviations and variants of the words of an address.
ABBREVIATIONS = {
    "bazaar": "bazar", "bzr": "bazar", "bzar": "bazar", "bazr": "bazar", "col": "colony", "colny": "colony", "cly": "colony", "ngr": "nagar", "nagr": "nagar",
    "moh": "mohalla", "mohala": "mohalla", "muhalla": "mohalla", "mohallah": "mohalla", "mahalla": "mohalla", "hsg": "housing", "soc": "society", "scty": "society",
    "twn": "town", "tn": "town", "pk": "park", "prk": "park", "rd": "road", "chk": "chowk", "no": "", "number": "", "نمبر": "", "pakistan": "", "permanent": "",
    "temporary": "", "present": "", "current": "", "پاکستان": "", "near": "near", "محلہ": "mohalla", "بازار": "bazar", "کالونی": "colony", "نگر": "nagar",
    "ٹاؤن": "town", "پارک": "park", "ہاؤسنگ": "housing", "سوسائٹی": "society",
}
#: Words that only say what sort of place it is.
PLACE_WORDS = frozenset("bazar colony nagar mohalla housing society town park road chowk".split())

_KIND = "|".join(sorted((re.escape(k) for k in KINDS), key=len, reverse=True))
_NUM = r"(?<!\d)(\d{1,4})(?!\d)"
_SUFFIX = r"(?:\s*[-/]\s*([a-z])(?![a-z])|([a-z])(?![a-z])|\s+([a-z])(?![a-z]|\s*-?\s*bl(?:oc)?k))?"
_PREMISES = re.compile(rf"(?<![^\W\d_])({_KIND})\s*\.?\s*/?\s*(?:no|number|نمبر)?\s*[.#:]*\s*{_NUM}{_SUFFIX}")
_STREET = re.compile(r"(?<![^\W\d_])(?:street|str|st|gali|galli|گلی|اسٹریٹ|سٹریٹ)\s*\.?\s*(?:no|number|نمبر)?\s*[.#:]*\s*(\d{1,4})(?!\d)")
_BLOCK = re.compile(r"(?<![^\W\d_])(?:block|blk|بلاک)\s*\.?\s*-?\s*([a-z])(?![^\W\d_])|(?<![^\W\d_])([a-z])\s*-?\s*(?:block|blk|بلاک)(?![^\W\d_])\.?")
_BARE = re.compile(rf"^\s*{_NUM}{_SUFFIX}|(?:^|[,;]|\s-)\s*{_NUM}{_SUFFIX}\s*(?=$|[,;]|\s-)")

Address = tuple[str, str, str, str, tuple[str, ...]]


@lru_cache(maxsize=20_000)
def parse_address(value: str | None) -> Address:
    """``(kind, number, street, block, words)``; parts not given are empty. ``number`` holds its letter, as ``117d``."""
    if not value:
        return "", "", "", "", ()
    s = plain_form(value).lower()
    s = s.replace("h/s", "housing society")
    s = re.sub(r"\bh\s*/\s*no", "h no", s)
    s = re.sub(r"\(.*?\)", " ", s)
    street = block = kind = number = ""
    m = _BLOCK.search(s)
    if m:
        block = m[1] or m[2]
        s = s[: m.start()] + " , " + s[m.end() :]
    m = _STREET.search(s)
    if m:
        street = str(int(m[1]))
        s = s[: m.start()] + " , " + s[m.end() :]
    s = re.sub(r"(?<!\d)\d{5}(?!\d)", " ", s)
    m = _PREMISES.search(s)
    if m:
        kind, number = KINDS[m[1]], str(int(m[2])) + (m[3] or m[4] or m[5] or "")
    else:
        m = _BARE.search(s)
        if m:
            g = [x for x in m.groups() if x]
            number = str(int(g[0])) + (g[1] if len(g) > 1 else "")
    if m:
        s = s[: m.start()] + " , " + s[m.end() :]
    words = [w for w in re.findall(r"[^\W\d_]+", s) if len(w) > 1 and ABBREVIATIONS.get(w, w)]
    return kind, number, street, block, tuple(words)


def full(word: str) -> str:
    """A word written out: what it is short for, or itself."""
    return ABBREVIATIONS.get(word, word)


@lru_cache(maxsize=100_000)
def word_cost(a: str, b: str) -> float:
    """Substitution cost of two words: 0 equal, 0.02 one word by the dictionary of abbreviations, up to 0.4 for near
    spellings, else 1."""
    if a == b:
        return 0.0
    a, b = full(a), full(b)
    if a == b:
        return 0.02
    if a in PLACE_WORDS and b in PLACE_WORDS:
        return 1.0
    ua, ub = bool(re.search("[؀-ۿ]", a)), bool(re.search("[؀-ۿ]", b))
    if ua != ub:
        x, y = skeleton(a), skeleton(b)
        return 0.2 if x == y and len(x) > 1 else 0.4 if len(x) > 2 and _near(x, y, 1) <= 1 else 1.0
    x, y = re.sub(r"(.)\1+", r"\1", a.replace("ee", "i").replace("oo", "u")), re.sub(r"(.)\1+", r"\1", b.replace("ee", "i").replace("oo", "u"))
    if x == y:
        return 0.05
    d = _near(x, y, 2)
    n = min(len(x), len(y))
    if d == 1 and n >= 3:
        return 0.2
    if d == 2 and n >= 5:
        return 0.35
    if len(b) >= 3 and a.startswith(b) or len(a) >= 3 and b.startswith(a):
        return 0.3
    return 1.0


GAP_OPEN, GAP_MORE = 0.5, 0.1


def align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, int, int, int]:
    """Affine-gap alignment of two word sequences: cost, matched words, words left over in ``a`` and in ``b``."""
    inf = (9e9, 0, 0, 0)
    n, m = len(a), len(b)
    # per cell: best ending in a match, in a gap of b, in a gap of a
    prev = [(inf, inf, inf)] * (m + 1)
    for i in range(n + 1):
        cur = []
        for j in range(m + 1):
            if i == 0 and j == 0:
                cur.append(((0.0, 0, 0, 0), inf, inf))
                continue
            match = up = left = inf
            if i and j:
                c = word_cost(a[i - 1], b[j - 1])
                if c < 0.5:
                    p = min(prev[j - 1])
                    match = (p[0] + c, p[1] + 1, p[2], p[3])
            if i:
                p, q = min(prev[j][0], prev[j][2]), prev[j][1]
                up = min((p[0] + GAP_OPEN, p[1], p[2] + 1, p[3]), (q[0] + GAP_MORE, q[1], q[2] + 1, q[3]))
            if j:
                p, q = min(cur[j - 1][0], cur[j - 1][1]), cur[j - 1][2]
                left = min((p[0] + GAP_OPEN, p[1], p[2], p[3] + 1), (q[0] + GAP_MORE, q[1], q[2], q[3] + 1))
            cur.append((match, up, left))
        prev = cur
    return min(prev[m])


class AddressMatcher:
    """Similarity of parsed addresses; ``common`` are words that say nothing within a block, as its city."""

    def __init__(self, common: frozenset[str] = frozenset()):
        self.common = common
        self._memo: dict = {}

    def informative(self, words: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Names and place words of an address in an order that does not depend on how it was written."""
        names = tuple(w for w in words if full(w) not in PLACE_WORDS and w not in self.common and not self._common_spelling(w))
        return names, tuple(sorted({full(w) for w in words if full(w) in PLACE_WORDS}))

    def _common_spelling(self, w: str) -> bool:
        got = self._memo.get(w)
        if got is None:
            if len(self._memo) > 50_000:
                self._memo.clear()
            got = self._memo[w] = any(word_cost(w, c) < 0.4 for c in self.common)
        return got

    def similarity(self, a: Address, b: Address) -> float:
        """1 for the same premises in full; less for parts that are missing; 0 where parts contradict or say too little."""
        (ka, na, sa, ba, wa), (kb, nb, sb, bb, wb) = a, b
        if not na or na != nb or (ka and kb and ka != kb) or (sa and sb and sa != sb) or (ba and bb and ba != bb):
            return 0.0
        (la, ta), (lb, tb) = self.informative(wa), self.informative(wb)
        if la and lb:
            cost, matched, left_a, left_b = align(la, lb)
            if not matched or (left_a and left_b):
                joined = word_cost("".join(la), "".join(lb))
                if joined >= 0.5:
                    return 0.0
                cost = joined
            if ta and tb and not set(ta) & set(tb):
                return 0.0
            place = 1.0 - min(cost, 1.0) / 4
        elif sa and sb:
            place = 0.8
        else:
            return 0.0
        s = place
        if not (sa and sb):
            s -= 0.15
        if bool(ba) != bool(bb):
            s -= 0.03
        if not (ka and kb):
            s -= 0.02
        return s
