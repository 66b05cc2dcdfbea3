"""Names as people type them: parts, spelling keys, n-gram features and a token-wise similarity."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

from caselens.llm.unicode import plain_form

# Titles before or after a name.
TITLES = frozenset(
    "mr mrs ms mst miss dr doctor haji hafiz ch chaudhry syed malik sheikh prof engr adv capt maj col"
    " the messrs ms mss bibijan janab mohtarma"
    " مسمی مسمات جناب محترمہ محترم حاجی حافظ سید ڈاکٹر بیگم چوہدری".split()
)
# What stands before the name of a relative, who is not the person named.
KIN = re.compile(
    r"(?:^|\s)(?:s\s*/\s*o|d\s*/\s*o|w\s*/\s*o|c\s*/\s*o|son\s+of|daughter\s+of|wife\s+of|widow\s+of|bin|binte|ولد|دختر|بنت|زوجہ|بن|بیوہ)\s.*$",
    re.I,
)
# Legal forms of firms, and trade words as they are shortened.
LEGAL = frozenset("pvt private p ltd limited regd registered co inc llc and".split())
TRADE = {
    "soc": "society", "sch": "school", "tex": "textile", "engg": "engineering", "stn": "station", "hsg": "housing", "h/s": "housing society",
    "agcy": "agency", "ctr": "centre", "center": "centre", "med": "medical", "trnsp": "transport", "dev": "developers", "bldrs": "builders",
    "mfg": "manufacturing", "intl": "international", "bros": "brothers", "ind": "industries",
}
TRADE_WORDS = frozenset(
    "jewellers traders trader textile mills motors housing society public school medical centre filling station cold storage travel agency"
    " mobile engineering works cash carry builders developers transport company traders".split()
)
# Short forms of given names.
NICKNAMES = {
    "deemi": "nadeem", "brahu": "ibrahim", "fati": "fatima", "sallu": "saleem", "mani": "usman", "junni": "junaid", "vicky": "waqas",
    "nasru": "nasir", "naso": "nasreen", "billu": "bilal", "khalo": "khalid", "immi": "imran", "wassu": "waseem", "shaka": "shakeel",
    "gogi": "ghazala", "zebi": "zainab", "sajju": "sajjad", "jedi": "javed", "haru": "haroon", "shani": "zeeshan", "kami": "kamran",
    "mari": "mariam", "shidu": "rashid", "kashi": "kashif", "soori": "mansoor", "kalso": "kulsoom", "dija": "khadija", "zubi": "zubair",
    "rizzu": "rizwan", "addi": "adnan", "soni": "sohail", "achhu": "aslam", "rukho": "rukhsana", "muzzi": "muzaffar", "akku": "akram",
    "ashi": "ayesha", "acho": "arshad", "shazo": "shazia", "veedi": "naveed", "bushi": "bushra", "tari": "tariq tahira", "jimmy": "jameel",
    "sumi": "sumaira", "mino": "yasmeen", "saffi": "sarfraz", "pino": "parveen", "faisi": "faisal", "shadu": "shahzad", "joji": "yousaf",
    "humi": "humaira", "sammi": "samina", "md": "muhammad", "mohd": "muhammad", "mohammad": "muhammad", "mohammed": "muhammad",
}

_SPELL = [("sch", "sh"), ("ph", "f"), ("q", "k"), ("w", "v"), ("y", "i"), ("z", "s"), ("ee", "i"), ("oo", "u"), ("aei", "ai"), ("ae", "ai"), ("ou", "u")]


@lru_cache(maxsize=50_000)
def spelling_key(token: str) -> str:
    """A token with interchangeable spellings made equal and doubled letters single."""
    for a, b in _SPELL:
        token = token.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", token)


_NICK = {k: tuple(spelling_key(x) for x in v.split()) for k, v in NICKNAMES.items()}


def parse_name(value: str | None) -> tuple[str, tuple[str, ...]]:
    """``(kind, tokens)``: kind is ``org``, ``person`` or ``none``; tokens are lower case, without titles and relatives.

    A nickname given beside the name (``alias``, brackets) is left out; an acronym of a firm is one token.
    """
    if not value:
        return "none", ()
    s = plain_form(value).lower()
    s = s.replace("m/s", " ").replace("h/s", "housing society")
    s = re.sub(r"\(\s*(?:pvt|private)\.?\s*\)|\b(?:pvt|private|p)\b\.?\s*(?=l)|\b(?:ltd|limited|regd|registered)\b\.?", " ", s)
    s = KIN.sub(" ", s)
    nick = re.search(r"\balias\b[\s-]*\S+|عرف\s+\S+", s)
    if nick:
        s = s[: nick.start()] + " " + s[nick.end() :]
    else:
        m = re.match(r"^\s*(?:\S+\s+)?(\S+)\s+\(([^)]+)\)", s)
        if m and (m[1] in _NICK or m[2] not in _NICK):
            s = s[: m.start(1)] + s[m.end(1) :]
    dotted = re.match(r"^\W*((?:[a-z]\.){2,}[a-z]?\.?)\W*$", s)
    if dotted:
        return "org", (re.sub(r"\W", "", dotted[1]),)
    raw = re.findall(r"[^\W_]+", s)
    tokens = [t for t in raw if t not in TITLES] or raw
    tokens = [TRADE.get(t, t) for t in tokens]
    trade = [t for t in tokens if t in TRADE_WORDS or spelling_key(t) in _TRADE_KEYS]
    if trade and len(tokens) > 1:
        return "org", tuple(t for t in tokens if t not in LEGAL)
    if len(tokens) == 1 and 2 <= len(tokens[0]) <= 5 and re.match(r"\W*[A-Z]{2,5}\b", plain_form(value)):
        return "org", (tokens[0],)
    return "person", tuple(tokens)


_TRADE_KEYS = frozenset(spelling_key(t) for t in TRADE_WORDS)


def _near(a: str, b: str, most: int) -> int:
    """Edit distance with neighbouring swaps, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        least = i
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            cur[j] = v
            least = min(least, v)
        if least > most:
            return most + 1
        prev2, prev = prev, cur
    return min(prev[-1], most + 1)


class NameMatcher:
    """Token-wise similarity of names.

    ``known`` holds the spelling keys of parts that are established names: two different established names are never
    spellings of each other, however near they are.
    """

    def __init__(self, known: frozenset[str] | set[str] = frozenset()):
        self.known = known
        self._tokens: dict[tuple[str, str], float] = {}

    def token(self, a: str, b: str) -> float:
        """1 for one spelling, 0.7 to 0.97 for near ones and nicknames, 0.6 for an initial, else 0."""
        if a == b:
            return 1.0
        key = (a, b) if a < b else (b, a)
        known = self._tokens.get(key)
        if known is None:
            if len(self._tokens) > 100_000:
                self._tokens.clear()
            known = self._tokens[key] = self._token(*key)
        return known

    def _token(self, a: str, b: str) -> float:
        x, y = spelling_key(a), spelling_key(b)
        if len(a) == 1 or len(b) == 1:
            one, other = (x, y) if len(a) == 1 else (y, x)
            firsts = {k[0] for k in _NICK.get(b if len(a) == 1 else a, (other,))} | {other[0]}
            return 0.6 if one[0] in firsts else 0.0
        if x == y:
            return 0.97
        for p, q in ((a, y), (b, x)):
            for real in _NICK.get(p, ()):
                d = _near(real, q, 1)
                if d <= 1 and (d == 0 or q not in self.known):
                    return 0.9 if d == 0 else 0.8
        if x in self.known and y in self.known:
            return 0.0
        n = min(len(x), len(y))
        d = min(_near(x, y, 2), _near(a, b, 2))
        if d == 1 and n >= 3:
            return 0.9 if n >= 5 else 0.8
        if d == 2 and n >= 4:
            return 0.78 if n >= 6 else 0.7
        return 0.0

    def name(self, a: tuple[str, tuple[str, ...]], b: tuple[str, tuple[str, ...]]) -> float:
        """Similarity in [0, 1] of two parsed names: every part of the shorter one must have its counterpart.

        Order does not count. Parts missing on one side and initials lower the similarity; a part that contradicts
        makes it 0. An acronym is compared with the initials of a firm.
        """
        (ka, ta), (kb, tb) = a, b
        if not ta or not tb:
            return 0.0
        if ta == tb:
            return 1.0
        org = "org" in (ka, kb)
        if org:
            for x, y in ((ta, tb), (tb, ta)):
                if len(x) == 1 and len(y) > 1:
                    full = "".join(t[0] for t in y if t not in LEGAL)
                    return 0.85 if x[0] in (full, "".join(t[0] for t in y)) else 0.0
            if ka != kb:
                return 0.0
            ta, tb = tuple(t for t in ta if t not in LEGAL), tuple(t for t in tb if t not in LEGAL)
        if len(ta) > len(tb):
            ta, tb = tb, ta
        extra = len(tb) - len(ta)
        if not ta or extra > 1 or (extra and (org or len(ta) == 1)):
            return 0.0
        best = self._assign(ta, tb, 0, 0) if len(tb) <= 5 else self._match(ta, tb)
        if best is None or not best[1]:
            return 0.0
        mean = best[0] / len(ta)
        if best[1] == 1 and len(ta) == 2:  # an initial and one part
            mean = min(mean, 0.78)
        return mean - (0.08 if extra else 0)

    def _assign(self, ta: tuple[str, ...], tb: tuple[str, ...], i: int, used: int) -> tuple[float, int] | None:
        """The best assignment of all parts ``ta[i:]`` to unused parts of ``tb``: sum of similarities, strong ones."""
        if i == len(ta):
            return 0.0, 0
        best = None
        for j, t in enumerate(tb):
            if used >> j & 1:
                continue
            s = self.token(ta[i], t)
            if s <= 0:
                continue
            rest = self._assign(ta, tb, i + 1, used | 1 << j)
            if rest is not None and (best is None or rest[0] + s > best[0]):
                best = rest[0] + s, rest[1] + (s > 0.6)
        return best


    def _match(self, ta: tuple[str, ...], tb: tuple[str, ...]) -> tuple[float, int] | None:
        """``_assign`` for any number of parts: equal parts are paired first, the rest by a best matching (shortest
        augmenting paths). Of more than 60 unequal parts those alike in spelling order are paired."""
        left, right = list(ta), list(tb)
        for t in ta:
            if t in right:
                left.remove(t)
                right.remove(t)
        total, strong = float(len(ta) - len(left)), len(ta) - len(left)
        if len(right) > 60:
            left.sort(key=spelling_key)
            right.sort(key=spelling_key)
            pairs = list(zip(left, right))
        else:
            # potentials u, v; row i of ``left`` is given a column of ``right``
            n, m = len(left), len(right)
            cost = [[1.0 - (self.token(x, y) or -9.0) for y in right] for x in left]
            u, v, of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
            for i in range(1, n + 1):
                of[0], j0 = i, 0
                dist, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
                while of[j0]:
                    used[j0], i0, delta, j1 = True, of[j0], float("inf"), 0
                    for j in range(1, m + 1):
                        if not used[j]:
                            d = cost[i0 - 1][j - 1] - u[i0] - v[j]
                            if d < dist[j]:
                                dist[j], way[j] = d, j0
                            if dist[j] < delta:
                                delta, j1 = dist[j], j
                    for j in range(m + 1):
                        if used[j]:
                            u[of[j]] += delta
                            v[j] -= delta
                        else:
                            dist[j] -= delta
                    j0 = j1
                while j0:
                    of[j0], j0 = of[way[j0]], way[j0]
            pairs = [(left[of[j] - 1], right[j - 1]) for j in range(1, m + 1) if of[j]]
        for x, y in pairs:
            s = self.token(x, y)
            if s <= 0:
                return None
            total, strong = total + s, strong + (s > 0.6)
        return total, strong


BUCKETS = 1 << 20


@lru_cache(maxsize=50_000)
def _part(token: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """First letters and n-grams of a part, for every name that it may be short for."""
    firsts, grams = [], []
    for k in _NICK.get(token, (spelling_key(token),)):
        firsts.append(k[:1])
        if len(k) > 1:
            s = f"^{k}$"
            grams += [s[x : x + 3] for x in range(len(s) - 2)]
            if len(k) > 3:
                grams.append("~" + "".join(sorted(set(re.sub("[aeiou]", "", k)))))
    return tuple(firsts), tuple(grams)


@lru_cache(maxsize=200_000)
def _buckets(first: str, token: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(f"{first}|{g}".encode()) & BUCKETS - 1 for g in _part(token)[1])


def name_features(parsed: tuple[str, tuple[str, ...]]) -> list[int]:
    """Character 3-grams of each part, each with the first letter of another part; acronyms of firms; hashed, sorted.

    A 3-gram alone is shared by all who bear a common surname; with the first letter of another part it is shared by
    few, while order, typing errors in one part, initials and missing middle names leave most of them in common.
    """
    kind, tokens = parsed
    out: set[int] = set()
    if kind == "org":
        word = tokens[0] if len(tokens) == 1 else "".join(t[0] for t in tokens)
        out |= {zlib.crc32(f"@{k}{word}".encode()) & BUCKETS - 1 for k in range(2)}
    # a name of a thousand parts has few distinct parts and first letters
    parts = Counter(tokens)
    letters: Counter[str] = Counter()
    for t, n in parts.items():
        for f in set(_part(t)[0]):
            letters[f] += n
    for t in parts:
        own = set(_part(t)[0])
        others = [f for f in letters if letters[f] > (f in own)] or [""]
        for f in others:
            out.update(_buckets(f, t))
    return sorted(out) or [zlib.crc32(("." + "".join(sorted(tokens))).encode()) & BUCKETS - 1]
