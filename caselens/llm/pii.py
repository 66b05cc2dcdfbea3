"""Problem 7: personal information in free text, by a linear-chain conditional random field.

Tokens carry word, shape, affix and format attributes of themselves and their neighbours; weights are trained by
maximum likelihood on a small labelled table (``pii_table``), whose slots are filled with a bounded sample of names
and addresses; Viterbi decodes whole batches in numpy. Spans of numbers and mail addresses are then checked exactly
against the length their kind has. Spans become typed placeholders, the rest of the text stays as it is.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm import pii_table
from caselens.llm.models import model_key, stored
from caselens.llm.namewords import KIN
from caselens.llm.pii_table import TITLES, labelled_texts

KINDS = ["email", "phone", "identity_number", "address", "name"]
#: Label 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
N_LABELS = 1 + 2 * len(KINDS)
_BITS = 17
#: Labelled texts and rounds of training.
TRAINING = (2000, 4)
_OFFSETS = (-3, -2, -1, 0, 1, 2)

# words, numbers, codes of Latin letters and digits, single signs
_TOKEN = re.compile(r"(?:[A-Za-z]++\d|\d++[A-Za-z])[A-Za-z0-9]*|[^\W\d_]+|\d+|[^\s\w]|_")
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９", "0123456789" * 3)
_SEP = r"[\s.\-–—‐‑]"
_FORMATS = [
    ("e", re.compile(r"(?<![\w.+\-])[\w.+\-]+\s?(?:@|\[at\]|\(at\))\s?[\w\-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[\w\-]+)+", re.I)),
    ("i", re.compile(rf"(?<![\d\w])\d{{5}}{_SEP}?\d{{7}}{_SEP}?\d(?!\d)")),
    ("p", re.compile(rf"(?<![\d\w])(?:(?:\+92|0092){_SEP}?\d{{3}}|\(0\d{{3}}\)|0\d{{3}}){_SEP}?\d{{3}}{_SEP}?\d{{4}}(?!\d)")),
    ("m", re.compile(r"(?<!\d)\d{14,}(?!\d)")),
]
# what every match of a format holds
_MAIL, _NUMBER = re.compile(r"@|[\[(]at[\])]", re.I), re.compile(r"\d{3}")


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def _attributes(token: str) -> list[str]:
    """Attributes of a token; its first character says whether it is glued to the one before, its second its format."""
    glued, form, w = token[0], token[1], token[2:]
    low = w.lower()
    # long numbers are told by their length and format only: each would else be learnt by heart
    out = ["f" + form, "g" + glued] if w.isdigit() and len(w) > 4 else ["w" + low, "f" + form, "g" + glued]
    if w.isascii() and w.isalnum() and not w.isalpha() and not w.isdigit():
        out += ["s" + re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d+", "0", w)))[:6], "n" + str(min(len(w), 10))]
    elif w.isdigit():
        # a number has few attributes, so its length and format are said in several ways
        n = min(len(w), 15)
        out += [f"d{n}", f"d{n}{form}", f"d{n}{form}{glued}", f"f{form}{glued}", *(f"D{form}{k}{n}" for k in range(4 * (n > 9)))]
    elif w[0].isalpha():
        if w.isascii():
            shape = "X" if len(w) == 1 and w.isupper() else "A" if w.isupper() else "C" if w[0].isupper() else "a"
        else:
            shape = "u"
        out += ["s" + shape, "3" + low[-3:], "4" + low[-4:], "p" + low[:3], "n" + str(min(len(w), 8)), "c" + shape + low[-2:]]
    else:
        out.append("q")
    return out


def tokenize(text: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens with their glue and format marks, and their places in the text."""
    flat = text if text.isascii() else text.translate(_DIGITS)
    form: dict[int, str] = {}
    mail, number = _MAIL.search(flat), _NUMBER.search(flat)
    for mark, pattern in _FORMATS:
        if mail if mark == "e" else number:
            for m in pattern.finditer(flat):
                for at in range(m.start(), m.end()):
                    form.setdefault(at, mark.upper() if at == m.start() else mark)
    spans = [m.span() for m in _TOKEN.finditer(flat)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    if form:
        tokens = [("+" if a == last else "-") + form.get(a, "o") + flat[a:b] for (a, b), last in zip(spans, [-1, *ends])]
    else:
        tokens = [("+o" if a == last else "-o") + flat[a:b] for (a, b), last in zip(spans, [-1, *ends])]
    return tokens, starts, ends


def _slots(token: str) -> np.ndarray:
    """Weight rows of a token's attributes for each offset: (offsets, attributes)."""
    a = np.array([_h(x) for x in _attributes(token)], dtype=np.uint64)
    k = np.arange(1, len(_OFFSETS) + 1, dtype=np.uint64)[:, None]
    x = (a[None, :] + k * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - _BITS)).astype(np.int64)


class Crf:
    """Weights of attributes and label transitions."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start
        self._rows: dict[str, int] = {}
        self._table = np.zeros((1024, len(_OFFSETS), N_LABELS), dtype=np.float32)

    def __getstate__(self):
        return {"emit": self.emit.astype(np.float32), "move": self.move, "start": self.start}

    def __setstate__(self, state):
        self.__init__(state["emit"], state["move"], state["start"])

    def _row(self, token: str) -> int:
        k = self._rows.get(token)
        if k is None:
            if len(self._rows) >= 200_000:
                self._rows.clear()
            k = self._rows[token] = len(self._rows)
            if k >= len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._table[k] = self.emit[_slots(token)].sum(axis=1)
        return k

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Emission scores (tokens, labels)."""
        if len(self._rows) + len(set(tokens)) >= 200_000:
            self._rows.clear()
        t = self._table_of(tokens)
        n = len(tokens)
        out = np.zeros((n, N_LABELS), dtype=np.float32)
        for j, o in enumerate(_OFFSETS):
            lo, hi = max(0, -o), n - max(0, o)
            if lo < hi:
                out[lo:hi] += t[lo + o : hi + o, j]
        return out

    def _table_of(self, tokens: list[str]) -> np.ndarray:
        rows = [self._row(x) for x in tokens]
        return self._table[rows]

    def decode(self, batch: list[list[str]]) -> list[np.ndarray]:
        """The most likely label sequences of a batch of token sequences."""
        order = sorted(range(len(batch)), key=lambda k: -len(batch[k]))
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(batch)
        for a in range(0, len(order), 256):
            part = [k for k in order[a : a + 256] if batch[k]]
            if not part:
                continue
            sizes = np.array([len(batch[k]) for k in part])
            width = int(sizes[0])
            e = np.zeros((len(part), width, N_LABELS), dtype=np.float32)
            for r, k in enumerate(part):
                e[r, : sizes[r]] = self.scores(batch[k])
            best = self.start + e[:, 0]
            back = np.zeros((len(part), width, N_LABELS), dtype=np.int8)
            for t in range(1, width):
                live = int(np.searchsorted(-sizes, -t, side="left"))  # rows longer than t
                cand = best[:live, :, None] + self.move[None]
                back[:live, t] = cand.argmax(axis=1)
                best[:live] = cand.max(axis=1) + e[:live, t]
            label = best.argmax(axis=1)
            y = np.zeros((len(part), width), dtype=np.int64)
            y[np.arange(len(part)), sizes - 1] = label
            for t in range(width - 1, 0, -1):
                live = int(np.searchsorted(-sizes, -t, side="left"))
                y[:live, t - 1] = back[np.arange(live), t, y[:live, t]]
            for r, k in enumerate(part):
                out[k] = y[r, : sizes[r]]
        return out


def _labels(starts: list[int], ends: list[int], spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(starts), dtype=np.int64)
    for a, b, kind in spans:
        inside = [k for k in range(len(starts)) if starts[k] >= a and ends[k] <= b]
        for n, k in enumerate(inside):
            y[k] = (1 if n == 0 else 2) + 2 * KINDS.index(kind)
    return y


def train(names: list[str], addresses: list[str], others: dict[str, list[str]] | None = None, plain: list[str] | None = None, texts: int = TRAINING[0], epochs: int = TRAINING[1], seed: int = 1) -> Crf:
    """A model from ``texts`` labelled texts; with ``plain`` texts, a second one from those and the first one's labels.

    A name that the first model finds in a plain text counts only if half of its words are parts of known names, and
    a run of two or more such parts counts as one; an address counts only if it begins as known addresses do. So the
    words around, which the table cannot know, are learnt.
    """
    data = []
    for text, spans in labelled_texts(names, addresses, texts, seed, others):
        tokens, starts, ends = tokenize(text)
        if tokens:
            data.append((tokens, _labels(starts, ends, spans)))
    model = _ascend(data, epochs, seed)
    if not plain:
        return model
    known = {w for v in names for w in re.findall(r"[^\W\d_]{2,}", v.lower())} - {w.strip(". ").lower() for w in TITLES}
    # how addresses begin: words that open at least one in 200 of the known ones
    opens: dict[str, int] = {}
    for v in addresses:
        w = re.match(r"\w*?(?=[\W\d_]|$)", v.lower())[0]
        opens[w] = opens.get(w, 0) + 1
    begin = {w for w, n in opens.items() if n * 200 >= len(addresses)}
    for text, spans in zip(plain, find_spans(model, plain)):
        spans = [x for x in spans if x[2] != "address" or re.match(r"\w*?(?=[\W\d_]|$)", text[x[0] :].lower())[0] in begin]
        tokens, starts, ends = tokenize(text)
        y = _labels(starts, ends, spans)
        # a number of the right format that was passed over leaves the text undecided
        if tokens and not any(t[1] in "PIE" and v == 0 for t, v in zip(tokens, y)):
            data.append((tokens, _checked(tokens, y, known)))
    return _ascend(data, epochs, seed)


def _checked(tokens: list[str], y: np.ndarray, known: set[str]) -> np.ndarray:
    """Labels whose names agree with the known parts of names."""
    name = 1 + 2 * KINDS.index("name")
    part = [t[2:].lower() in known for t in tokens]
    word = [len(t) > 3 and t[2].isalpha() for t in tokens]
    y, k = y.copy(), 0
    while k < len(y):
        if y[k] == name:
            e = k + 1
            while e < len(y) and y[e] == name + 1:
                e += 1
            if sum(part[k:e]) * 2 < sum(word[k:e]):
                y[k:e] = 0
            k = e
        elif y[k] == 0 and part[k]:
            e = k + 1
            while e < len(y) and y[e] == 0 and part[e]:
                e += 1
            if e - k > 1:
                y[k], y[k + 1 : e] = name, name + 1
            k = e
        else:
            k += 1
    return y


def _ascend(data: list[tuple[list[str], np.ndarray]], epochs: int, seed: int) -> Crf:
    """Stochastic gradient ascent on the log-likelihood (Adagrad)."""
    r = np.random.default_rng(seed)
    emit = np.zeros((1 << _BITS, N_LABELS))
    seen = np.full((1 << _BITS, N_LABELS), 1e-2)
    move, start = np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS)
    for k in range(len(KINDS)):  # a span goes on only after it began
        for a in range(N_LABELS):
            if a not in (1 + 2 * k, 2 + 2 * k):
                move[a, 2 + 2 * k] = -50.0
        start[2 + 2 * k] = -50.0
    fixed_move, fixed_start = move < -1, start < -1
    seen_move = np.full_like(move, 1e-2)
    slots: dict[str, np.ndarray] = {}
    order = np.argsort([len(x[0]) for x in data], kind="stable")
    batches = [order[a : a + 32] for a in range(0, len(order), 32)]
    for _ in range(epochs):
        for b in r.permutation(len(batches)):
            part = [data[k] for k in batches[b]]
            sizes = np.array([len(x[0]) for x in part])
            width, n = int(sizes.max()), len(part)
            rows, owner = [], []
            for i, (tokens, _) in enumerate(part):
                for t in range(len(tokens)):
                    for j, o in enumerate(_OFFSETS):
                        if 0 <= t + o < len(tokens):
                            w = tokens[t + o]
                            if w not in slots:
                                slots[w] = _slots(w)
                            s = slots[w][j]
                            rows.append(s)
                            owner.append(np.full(len(s), i * width + t))
            row, own = np.concatenate(rows), np.concatenate(owner)
            e = np.zeros((n * width, N_LABELS))
            picked = emit[row]
            cut = np.flatnonzero(np.diff(own)) + 1
            first = np.concatenate([[0], cut])
            e[own[first]] = np.add.reduceat(picked, first, axis=0)
            e = e.reshape(n, width, N_LABELS)
            live = np.arange(width)[None, :] < sizes[:, None]
            alpha = np.zeros((n, width, N_LABELS))
            alpha[:, 0] = start + e[:, 0]
            for t in range(1, width):
                x = alpha[:, t - 1, :, None] + move[None]
                m = x.max(axis=1)
                nxt = m + np.log(np.exp(x - m[:, None]).sum(axis=1)) + e[:, t]
                alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
            beta = np.zeros((n, width, N_LABELS))
            for t in range(width - 2, -1, -1):
                x = move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
                m = x.max(axis=2)
                nxt = m + np.log(np.exp(x - m[..., None]).sum(axis=2))
                beta[:, t] = np.where(live[:, t + 1, None], nxt, 0.0)
            m = alpha[:, -1].max(axis=1)
            logz = m + np.log(np.exp(alpha[:, -1] - m[:, None]).sum(axis=1))
            p = np.exp(alpha + beta - logz[:, None, None]) * live[..., None]
            g = -p
            gm = np.zeros_like(move)
            for i, (_, y) in enumerate(part):
                g[i, np.arange(len(y)), y] += 1
                np.add.at(gm, (y[:-1], y[1:]), 1)
            for t in range(1, width):
                q = np.exp(alpha[:, t - 1, :, None] + move[None] + (e[:, t] + beta[:, t])[:, None, :] - logz[:, None, None])
                gm -= (q * live[:, t, None, None]).sum(axis=0)
            flat = g.reshape(n * width, N_LABELS)
            srt = np.argsort(row, kind="stable")
            uniq, at = np.unique(row[srt], return_index=True)
            step = np.add.reduceat(flat[own[srt]], at, axis=0) - 1e-3 * emit[uniq]
            seen[uniq] += step**2
            emit[uniq] += 0.3 * step / np.sqrt(seen[uniq])
            gm[fixed_move] = 0
            seen_move += gm**2
            move += 0.1 * gm / np.sqrt(seen_move)
            gs = g[:, 0].sum(axis=0)
            gs[fixed_start] = 0
            start += 0.02 * gs / n
    return Crf(emit, move.astype(np.float32), start.astype(np.float32))


def _exact(kind: str, span: str) -> bool:
    """Whether a span has the length its kind demands."""
    digits = len(re.findall(r"\d", span.translate(_DIGITS)))
    if kind == "identity_number":
        return digits == 13
    if kind == "phone":
        return 10 <= digits <= 14
    if kind == "email":
        return bool(re.search(r"@|\bat\b", span, re.I)) and len(span) > 5
    if kind == "address":
        return digits > 0
    # a name has a word, not only initials or marks
    return bool(re.search(r"[^\W\d_]{2,}", span))


def find_spans(model: Crf, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Spans ``(start, end, kind)`` of each text, in order; null and empty texts have none."""
    parts = [tokenize(t) if t else ([], [], []) for t in texts]
    out = []
    for text, (_, starts, ends), y in zip(texts, parts, model.decode([p[0] for p in parts])):
        spans: list[list] = []
        for k, v in enumerate(y.tolist()):
            if v == 0:
                continue
            kind = KINDS[(v - 1) // 2]
            if v % 2 == 0 and spans and spans[-1][3] == k - 1 and spans[-1][2] == kind:
                spans[-1][1], spans[-1][3] = ends[k], k
            else:
                spans.append([starts[k], ends[k], kind, k])
        out.append([(a, b, kind) for a, b, kind, _ in spans if _exact(kind, text[a:b])])
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def sample_slots(names: DataFrame, addresses: DataFrame, firms: DataFrame | None = None, stations: DataFrame | None = None, most: int = 2000) -> tuple[list[str], list[str], dict[str, list[str]]]:
    """At most ``most`` names, addresses, firms and stations to fill the labelled table, those with the least hashes.

    The inputs have one text column each; titles stay, relatives are cut off, values with other signs are left out.
    The parts of an address that hold no number are places.
    """
    def pick(df: DataFrame | None) -> list[str]:
        if df is None:
            return []
        c = F.trim(F.col(df.columns[0]))
        df = df.select(c.alias("v")).where(F.col("v").isNotNull() & (F.length("v").between(5, 120))).distinct()
        return [r.v for r in df.orderBy(F.xxhash64("v"), "v").limit(most).collect()]

    words = r"(?:[A-Za-z]+\.? )+[A-Za-z]+|(?:[؀-ۿ]+ )+[؀-ۿ]+"
    people = [v for v in (KIN.sub("", v).strip() for v in pick(names)) if re.fullmatch(words, v)]
    homes = [v for v in pick(addresses) if re.search(r"\d", v) and len(v) > 15 and v[0].isalpha()]
    places = sorted({p for v in homes for p in (x.strip() for x in re.split(r"[,،;]", v)) if re.fullmatch(words, p)})
    others = {
        "O": [v for v in pick(firms) if v.isascii() and re.fullmatch(r"[\w .&()/-]+", v)],
        "S": [v for v in pick(stations) if v.isascii()],
        "L": [p for p in places if p.isascii()],
        "Z": [p for p in places if not p.isascii()],
    }
    return people, homes, others


_MODELS: dict[str, Crf] = {}


def fitted(names: DataFrame, addresses: DataFrame, firms: DataFrame | None = None, stations: DataFrame | None = None, plain: DataFrame | None = None, most: int = 2000) -> Crf:
    """The model for slots sampled from columns of ``names``, ``addresses``, ``firms`` and ``stations``, adapted to at
    most half as many texts of ``plain``, which have no labels (those with the least hashes).

    It is trained once per sample and kept in the shared folder, from where later sessions take it.
    """
    slots = sample_slots(names, addresses, firms, stations, most)
    texts: list[str] = []
    if plain is not None:
        rows = plain.select(F.col(plain.columns[0]).alias("v")).where("v is not null and length(v) between 1 and 2000").distinct()
        texts = [r.v for r in rows.orderBy(F.xxhash64("v"), "v").limit(most // 2).collect()]
    key = model_key([sys.modules[__name__], pii_table], slots, texts)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = stored(names.sparkSession, f"pii-{key}", lambda: train(*slots, texts))
    return _MODELS[key]


def detect(rows: DataFrame, key: str, text: str, model: Crf) -> DataFrame:
    """``(row_key, text, redacted, spans)``: spans are structs ``(start, end, kind, span_no)``.

    ``start`` and ``end`` count code points, ``span_no`` counts the spans of a kind in a text from 1. Null keys and
    texts are left out; repeated rows count once; other columns are not read. No shuffle beyond removing repeats.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = "row_key string, text string, redacted string, spans array<struct<start:int,end:int,kind:string,span_no:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                found = find_spans(m, part["text"].tolist())
                numbered = []
                for spans in found:
                    seen: dict[str, int] = {}
                    row = []
                    for s, e, kind in spans:
                        seen[kind] = seen.get(kind, 0) + 1
                        row.append({"start": s, "end": e, "kind": kind, "span_no": seen[kind]})
                    numbered.append(row)
                yield pd.DataFrame(
                    {"row_key": part["row_key"], "text": part["text"], "redacted": [redact(t, s) for t, s in zip(part["text"], found)], "spans": numbered}
                )

    picked = rows.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text")).where("row_key is not null and text is not null")
    return picked.distinct().mapInPandas(run, schema)
