"""Problem 4: question-answer pairs that are useless, with their defect.

A multi-label linear classifier on hashed word n-grams and pair features. It is trained on a bounded sample of the
pairs themselves: each is taken as it is, cut in the middle of a sentence, answered with its own question, given the
answer of a question in another language, or refused. What refuses in the sample itself is found first, by telling
made-up refusals from the unlabelled pairs. Pairs of the sample that the first model finds defective are left out when
the second is trained. Thresholds are calibrated on held-out synthetic pairs. An answer without words
is empty by definition.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm.models import model_key, stored

LABELS = ["truncated", "refusal", "copy", "other_language"]
_BITS = 18

# How refusals sound, by language; a bar in square brackets separates wordings of which one is taken.
# They are written from general knowledge of assistants; a test checks that none of their longer parts stands in the
# test tables.
REFUSALS = {
    "en": [
        "I [can't|cannot|can not|won't|must not|may not] [help you|assist|do that|give advice|say more|discuss it|reveal that|provide it|share it][ here| on that| now| with it|].",
        "I'm [unable|not able|not allowed|not authorised|not in a position] to [answer|respond|comment|disclose it|look into it|give this out][ here| at all|].",
        "[We|I] [decline|refuse|prefer not] to [comment|answer|take part][ here|].",
        "[That|This|It|Your request] is [outside|beyond|not within] [my scope|my remit|what I may do|my role|our policy].",
        "[Privacy|Company|Safety|Legal] [rules|policy|reasons|law] [forbid it|do not let me answer|stop me here].",
        "[For|Because of|Owing to] [legal|safety|confidentiality|data protection] reasons [I stay silent|it stays closed|nothing can be disclosed].",
        "I have no [access|data|knowledge|information|idea][ of that| about it| here|].",
        "I [do not|don't] [have the data|hold such files|see any record|possess details|find anything].",
        "[The|My|These] [files|sources|texts|records|context] [say nothing|are silent|give no answer|do not mention it|lack this].",
        "[There is|I see|I found] no [mention|trace|record|information|answer][ of it| there| on this|].",
        "[Nothing|No text|No source] [was found|is known|answers it|is on file].",
        "[It|That] would [not be right|be wrong|be improper|not be proper] [to say|for me to answer|to go further].",
        "I [do not know|am not sure|really can't tell|have no answer].",
    ],
    "ur-latn": [
        "[Main|Hum] [ye|is ka|aisa] [nahi bata sakta|jawab dene se qasir hoon|kaam nahi kar sakta|mashwara nahi de sakte].",
        "[Mujhe|Hamein] [ijazat nahi|ilm nahi|rasai hasil nahi|maloom nahi|ikhtiyar nahi][ hai|].",
        "[Is|Us] [bare mein|silsile mein] [kuch nahi mila|koi record nahi|maloomat dastiyab nahi].",
        "[Qanooni|Policy ki|Hifazati] [wajoohat|pabandi] [ki bina par|se] [inkar hai|jawab mumkin nahi|kuch nahi keh sakta].",
        "[Ye|Aap ki darkhwast] [mere|hamare] [dairay|ikhtiyar] [se bahar|mein nahi] hai.",
    ],
    "ur": [
        "[میں|ہم] [یہ|اس کا|ایسا] [نہیں بتا سکتا|جواب دینے سے قاصر ہوں|کام نہیں کر سکتا|مشورہ نہیں دے سکتے]۔",
        "[مجھے|ہمیں] [اجازت نہیں|علم نہیں|رسائی نہیں|معلوم نہیں|اختیار نہیں][ ہے|]۔",
        "[اس|اُس] [بارے میں|سلسلے میں] [کچھ نہیں ملا|کوئی ریکارڈ نہیں|معلومات دستیاب نہیں]۔",
        "[قانونی|پالیسی کی|حفاظتی] [وجوہات|پابندی] [کی بنا پر|سے] [انکار ہے|جواب ممکن نہیں|کچھ نہیں کہہ سکتا]۔",
        "[یہ|آپ کی درخواست] [میرے|ہمارے] [دائرے|اختیار] [سے باہر|میں نہیں] ہے۔",
    ],
    "fr": [
        "[Je|Nous] [ne peux pas|ne suis pas autorisé à|refuse de] [vous aider|répondre|le dire|donner ces détails].",
        "[Cela|Votre demande] [dépasse|sort de] [mon rôle|mon domaine].",
        "[Aucun|Pas un] [texte|dossier|document] n'en parle.",
    ],
}
BEFORE = {
    "en": ["", "", "Sorry - ", "My apologies, ", "Alas, ", "I regret that ", "Hi. ", "Thanks for asking. ", "As an AI, ", "Being a program, "],
    "ur-latn": ["", "Sorry, ", "Mazrat chahta hoon. ", "Bad qismati se ", "Poochne ka shukria. "],
    "ur": ["", "معذرت خواہ ہوں۔ ", "بدقسمتی سے ", "پوچھنے کا شکریہ۔ "],
    "fr": ["", "Désolé, ", "Merci de votre question. "],
}
AFTER = {
    "en": ["", "", " [See|Ask|Contact] [a lawyer|the desk|an expert|someone else].", " [Try again later|Reword it|Ask otherwise], please.", " Anything else?", " [Sorry|Apologies] again."],
    "ur-latn": ["", " [Wakeel|Afsar|Daftar] se [poochein|milein].", " Dobara koshish karein."],
    "ur": ["", " [وکیل|افسر|دفتر] سے [پوچھیں|ملیں]۔", " دوبارہ کوشش کریں۔"],
    "fr": ["", " [Voyez|Consultez] un expert."],
}
_CHOICE = re.compile(r"\[([^\[\]]*\|[^\[\]]*)\]")


def _worded(pattern: str, r: np.random.Generator) -> str:
    """One wording of a pattern."""
    while m := _CHOICE.search(pattern):
        options = m[1].split("|")
        pattern = pattern[: m.start()] + options[int(r.integers(0, len(options)))] + pattern[m.end() :]
    return pattern


def literal_parts() -> list[str]:
    """What refusals and the phrases around them say, every wording of a choice by itself."""
    out = []
    for lines in [*REFUSALS.values(), *BEFORE.values(), *AFTER.values()]:
        for x in lines:
            out += _CHOICE.sub("\n", x).split("\n") + [w for m in _CHOICE.finditer(x) for w in m[1].split("|")]
    return [x.strip() for x in out if x.strip()]


# Function words that tell languages apart.
_FUNCTION = {
    "en": "the of and to in is was by for on with that which at it be or an were from what how who has been this i you not are under any all give find did when where why please me my your about".split(),
    "ur-latn": "ka ki ke hai mein ko aur se ne par hua gaya kya keh tha jab kaha apna baad hain kis ye nahi ho".split(),
    "fr": "le la les des une du et est dans pour sur avec au aux été puis doit qui selon pièces figure sa".split(),
    "es": "el los las una del y en para con por que se al su fue".split(),
    "de": "der die das und ist nicht mit für von dem den ein eine wurde auf".split(),
    "ps": [], "ar": [],
}
_BY_WORD: dict[str, list[str]] = {}
for _lang, _words in _FUNCTION.items():
    for _w in _words:
        _BY_WORD.setdefault(_w, []).append(_lang)
_ASKED = [
    ("en", re.compile(r"\bin english\b|\benglish (?:mein|main|me)\b|انگریزی|انگلش", re.I)),
    ("fr", re.compile(r"\bin french\b|\bfrench (?:mein|main|me)\b|فرانسیسی|فرنچ|en français", re.I)),
    ("ur", re.compile(r"\bin urdu\b|\burdu (?:mein|main|me)\b|اردو", re.I)),
    ("ur-latn", re.compile(r"\broman urdu\b|رومن", re.I)),
]
_CITE = re.compile(r"[\[(]Document \d+[\])]")
_TAG = re.compile(r"<[^<>]{0,40}>")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_END = re.compile(r"(?<=[.!?۔؟])\s+(?=\S)|\n+")


def _clean(text: str | None) -> str:
    s = _CITE.sub(" ", _TAG.sub(" ", unicodedata.normalize("NFKC", text or "")))
    return "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t")


def has_words(text: str | None) -> bool:
    """Whether an answer has words: letters or digits that are no mark for nothing."""
    s = _clean(text)
    if re.fullmatch(r"\W*(?:n\s*/\s*a|none|null|nil|nan|undefined)\W*", s, re.I):
        return False
    return any(c.isalnum() for c in s)


def language(text: str) -> str:
    """Urdu by its script, others by their function words; empty if nothing tells."""
    letters = sum(c.isalpha() for c in text)
    arabic = sum("؀" <= c <= "ۿ" for c in text if c.isalpha())
    if letters and arabic / letters > 0.3:
        return "ur"
    hits: dict[str, float] = {}
    for w in _WORD.findall(text.lower()):
        langs = _BY_WORD.get(w, ())
        for lang in langs:
            hits[lang] = hits.get(lang, 0) + 1 / len(langs)
    if not hits:
        return ""
    top = max(hits, key=lambda k: (hits[k], k))
    return top if hits[top] >= 1 else ""


def _norm(w: str) -> str:
    return re.sub(r"\d", "0", w) if any(c.isdigit() for c in w) else w


def _shape(w: str) -> str:
    return "0" if w.isdigit() else "x0" if any(c.isdigit() for c in w) else w


def features(question: str | None, answer: str | None, words: frozenset[str] = frozenset()) -> list[np.ndarray]:
    """Hashed features of a pair, one array per label: how it ends, what it says, what it adds, in which language.

    ``words`` are the words that sentences of the training sample end with or hold.
    """
    q, raw = _clean(question), _clean(answer)
    a = re.sub(r"^\s*(?:[-•*]|\d+\.)\s+", "", raw, flags=re.M).strip()
    sentences = [s for s in _END.split(a) if s.strip()]
    last = sentences[-1] if sentences else ""
    qw, aw, lw = ([_norm(w) for w in _WORD.findall(x.lower())] for x in (q, a, last))

    # how the answer ends: without an end mark, whether these words can end this sentence
    trimmed = (answer or "").rstrip()
    ended = bool(re.search(r"(?:[.!?۔؟]|[\[(]Document \d+[\])])$", trimmed)) and not trimmed.endswith(("..", "…"))
    # a bracket still open or a list mark with nothing behind it; said twelve times, so that it outweighs the words before it
    open_end = bool(re.search(r"[\[(][^\])]{0,12}$|\n\s*(?:[-*•]|\d+\.)$", trimmed))
    opened = [f"o{k}{open_end}" for k in range(12)]
    tail = [_shape(w) for w in lw[-5:]]
    head = " ".join(lw[:2])
    end = ["1", f"d{ended}", f"m{trimmed[-1:] if trimmed[-1:] and not trimmed[-1:].isalnum() else 'w'}", *opened]
    if tail and not ended:
        end += ["e" + tail[-1], "f" + " ".join(tail[-2:]), "g" + " ".join(tail[-3:]), "G" + " ".join(tail[-4:]), "H" + " ".join(tail), f"h{head}|{' '.join(tail[-2:])}", f"i{head}|{tail[-1]}", f"k{len(lw[-1])}"]
        shown = _WORD.findall(last)[-1]
        end += [f"v{k}{tail[-1] in words}{shown[:1].isupper()}{shown.isascii()}" for k in range(4)]
        if len(lw) < 10:
            end += ["s" + " ".join(_shape(w) for w in lw), f"n{len(aw) == len(lw)}{len(lw)}", "r" + re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d+", "0", last)))[:60]]

    # what it says: words and pairs of words; the start of its first sentence
    first = [_norm(w) for w in _WORD.findall(sentences[0].lower())][:12] if sentences else []
    say = ["1", f"n{min(len(sentences), 4)}", f"w{min(len(aw) // 8, 6)}"]
    say += ["u" + w for w in set(aw)] + ["b" + x + " " + y for x, y in set(zip(aw, aw[1:]))]
    say += ["F" + " ".join(first[i : i + 3]) for i in range(max(0, len(first) - 2))]

    # what it adds to the question
    known = set(qw)
    new = [w for w in aw if w not in known]
    share = len(new) / len(aw) if aw else 0.0
    add = ["1", f"s{int(share * 10)}", f"k{min(len(new), 8)}", f"b{int(share * 5)}{min(len(new), 4)}", f"l{min(len(aw) * 2 // max(len(qw), 1), 6)}"]
    joined_q, joined_a = " ".join(qw), " ".join(aw)
    if joined_q and joined_q in joined_a:
        rest = joined_a.replace(joined_q, " ").split()
        add += ["Q", f"q{min(len(rest), 6)}", *(["r" + " ".join(rest[:3])] if len(rest) < 4 else [])]
    if aw and joined_a == joined_q:
        add.append("same")

    # in which language
    lq, la = language(q), language(a)
    per = [x for x in (language(s) for s in sentences if len(_WORD.findall(s)) >= 4) if x]
    asked = next((lang for lang, p in _ASKED if p.search(q)), "")
    fits = not la or not lq or la in (lq, asked)
    foreign = sum(x not in (lq, asked) for x in per) if lq else 0
    lan = ["1", f"f{fits}", f"n{min(foreign, 3)}", f"a{bool(per) and foreign == len(per)}", f"c{fits}{bool(asked)}{foreign == len(per)}"]
    return [_hash(x) for x in (end, say, add, lan)]


def _hash(names: list[str]) -> np.ndarray:
    h = (zlib.crc32(x.encode("utf-8", "surrogatepass")) >> (32 - _BITS) for x in names)
    return np.unique(np.fromiter(h, dtype=np.int64, count=len(names)))


class Classifier:
    """Weights (labels, features) and a threshold per label."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, words: frozenset[str] = frozenset()):
        self.weights, self.thresholds, self.words = weights, thresholds, words

    def scores(self, pairs: list[list[np.ndarray]]) -> np.ndarray:
        if not pairs:
            return np.zeros((0, len(LABELS)))
        return np.stack([_dot(self.weights[k], [p[k] for p in pairs])[0] for k in range(len(LABELS))], axis=1)

    def predict(self, questions: list[str | None], answers: list[str | None]) -> list[str | None]:
        """The defect of each pair, null for none: of the labels over their thresholds the one furthest over."""
        over = self.scores([features(q, a, self.words) for q, a in zip(questions, answers)]) - self.thresholds
        best = over.argmax(axis=1)
        return ["empty" if not has_words(a) else LABELS[b] if o[b] > 0 else None for a, o, b in zip(answers, over, best)]


def _dot(w: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each row of features, and all features with their rows' scales."""
    flat = np.concatenate(rows)
    sizes = np.array([len(x) for x in rows])
    scale = 1 / np.sqrt(sizes)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(w[flat], at) * scale, flat, np.repeat(scale, sizes)


def _fit(pairs: list[list[np.ndarray]], y: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Logistic regression per label by stochastic gradient ascent (Adagrad)."""
    r = np.random.default_rng(seed)
    w = np.zeros((len(LABELS), 1 << _BITS))
    g2 = np.full_like(w, 1e-4)
    for _ in range(epochs):
        for part in np.array_split(r.permutation(len(pairs)), max(1, len(pairs) // 256)):
            for k in range(len(LABELS)):
                rows = [pairs[i][k] for i in part]
                z, flat, scale = _dot(w[k], rows)
                err = np.repeat(y[part, k] - 1 / (1 + np.exp(-np.clip(z, -30, 30))), [len(x) for x in rows]) * scale
                uniq, where = np.unique(flat, return_inverse=True)
                step = np.bincount(where, weights=err) - 1e-4 * w[k, uniq]
                g2[k, uniq] += step**2
                w[k, uniq] += 0.25 * step / np.sqrt(g2[k, uniq])
    return w


def _cut(answer: str, r: np.random.Generator) -> str | None:
    """The answer up to a place inside one of its sentences, the last more often than others."""
    text = answer.rstrip()
    cites = list(_CITE.finditer(text))
    if cites and r.random() < 0.12:
        m = cites[int(r.integers(0, len(cites)))]
        return text[: int(r.integers(m.start() + 1, m.end()))].rstrip()
    if r.random() < 0.05:
        return text + str(r.choice(["\n-", "\n*", "\n2."]))
    ends = [0, *[m.end() for m in _END.finditer(text)], len(text)]
    k = len(ends) - 2 if r.random() < 0.5 else int(r.integers(0, len(ends) - 1))
    a, b = ends[k], ends[k + 1]
    words = [m.end() for m in re.finditer(r"\S+", text[a:b])]
    if len(words) < 4:
        return None
    # not so late that only the end mark, a citation or the last word is missing
    stop = len(_WORD.findall(_clean(text[a:b])))
    w = int(r.integers(1, max(2, min(len(words), stop) - 2)))
    at = a + words[w - 1]
    if r.random() < 0.3:
        at -= int(r.integers(1, 3))
    return text[:at].rstrip(" ,;:(-") + ("" if r.random() < 0.8 else r.choice(["...", "…", " -", ","]))


def _synthetic(base: list[tuple[str, str]], r: np.random.Generator) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Pairs and labels made of good pairs."""
    lang = [language(a) for _, a in base]
    by = {k: [i for i, x in enumerate(lang) if x == k] for k in sorted(set(lang)) if k}
    pairs, y = [], []

    def add(q: str, a: str, label: str | None) -> None:
        pairs.append((q, a))
        y.append([float(x == label) for x in LABELS])

    for i, (q, a) in enumerate(base):
        add(q, a, None)
        x = r.random()
        if x < 0.3:
            add(q, a.rstrip().rstrip(".۔"), None)  # without its full stop an answer is still complete
        elif x < 0.45:
            add(q, f"{r.choice(['', 'You asked: ', 'Question: '])}{q}{r.choice([' ', chr(10), chr(10) * 2])}{a}", None)
        elif x < 0.6:
            short = re.search(r"\b(?:FIR-\S+?\d{4}|Rs\. [\d,]+\d|\d{3}(?:-[A-Z])? [A-Z]{3,4}|[A-Z]{3}-[A-Z]-\d{4}|\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2})", a)
            if short:
                add(q, short[0], None)
        cut = _cut(a, r)
        if cut:
            add(q, cut, "truncated")
        if i % 2 == 0:
            copy = r.choice(["{q}", "{q}", "{q} {q}", "{q}\n{q}", "You asked: {q}", "Question: {q}", "\"{q}\"", "{u}", "{l}", "{p}", "Your question was: {q}", *(["Aap ka sawal: {q}", "آپ کا سوال: {q}"] if language(q) in ("ur", "ur-latn") else [])])
            add(q, copy.format(q=q, u=q.upper(), l=q.lower(), p=q.rstrip("?؟.") + r.choice([".", "", "...", "?"])), "copy")
        k = language(q)
        mine = k if k in REFUSALS else "en"
        if i % 3 == 0 or mine != "en":
            mine = mine if r.random() < 0.8 else str(r.choice(list(REFUSALS)))
            if mine == k:
                add(q, _refusal(mine, r), "refusal")
        if i % 4 == 2 and k:
            # an answer in another language is right where the question asks for it
            want = str(r.choice(["en", "fr"]))
            if want != k and len(by.get(want, ())) >= 5 and not any(p.search(q) for _, p in _ASKED):
                named = {"en": "English", "fr": "French"}[want]
                ask = {"ur": f"جواب {'انگریزی' if want == 'en' else 'فرانسیسی'} میں دیں۔", "ur-latn": f"Jawab {named} mein dein."}.get(k, f"Reply in {named} please.")
                add(f"{q} {ask}", base[int(r.choice(by[want]))][1], None)
        if i % 2 == 1 and k:
            asked = next((g for g, p in _ASKED if p.search(q)), "")
            other = [g for g in by if g not in (k, asked) and len(by[g]) >= 5]
            if other:
                add(q, base[int(r.choice(by[str(r.choice(other))]))][1], "other_language")
    return pairs, np.array(y)


def _refusal(k: str, r: np.random.Generator) -> str:
    """A made-up refusal in a language of ``REFUSALS``."""
    said = " ".join(_worded(str(r.choice(REFUSALS[k])), r) for _ in range(1 + int(r.random() < 0.3)))
    before = str(r.choice(BEFORE[k]))
    if before and before.rstrip()[-1] not in ".-۔" and not re.match(r"I\b|I'", said):
        said = said[:1].lower() + said[1:]
    return before + said + _worded(str(r.choice(AFTER[k])), r)


def _words_of(question: str, answer: str) -> np.ndarray:
    """Hashed words that an answer adds to its question; one that adds a figure, or three words at most, has none."""
    w = {_norm(x) for x in _WORD.findall(_clean(answer).lower())} - {_norm(x) for x in _WORD.findall(_clean(question).lower())}
    return _hash(["1", *("u" + x for x in w)]) if len(w) > 3 and not any("0" in x for x in w) else _hash(["short"])


def likely_refusals(base: list[tuple[str, str]], r: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Which pairs of a sample refuse: made-up refusals are told from the sample, which counts as unlabelled; what
    looks more like them than like the rest joins them, and the next round learns its wording too."""
    x = [_words_of(q, a) for q, a in base]
    lang = [language(q) for q, _ in base]
    made = [_words_of(q, _refusal(k if k in REFUSALS else "en", r)) for (q, _), k in zip(base, lang)]
    rows = x + made
    found = np.zeros(len(base), dtype=bool)
    for _ in range(rounds):
        y = np.concatenate([found, np.ones(len(made))])
        # an unlabelled pair counts less than one that is known to refuse
        weight = np.where(y > 0, 1.0, 0.3)
        w, g2 = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-4)
        for _ in range(2):
            for part in np.array_split(r.permutation(len(rows)), max(1, len(rows) // 256)):
                mine = [rows[i] for i in part]
                z, flat, scale = _dot(w, mine)
                err = np.repeat(weight[part] * (y[part] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))), [len(m) for m in mine]) * scale
                uniq, where = np.unique(flat, return_inverse=True)
                step = np.bincount(where, weights=err) - 1e-3 * w[uniq]
                g2[uniq] += step**2
                w[uniq] += 0.25 * step / np.sqrt(g2[uniq])
        now = found | ((_dot(w, x)[0] > 0) & (np.array([len(v) for v in x]) > 1))
        if (now == found).all():
            break
        found = now
    return found


def _thresholds(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per label the score that gives the best F1 on held-out pairs, in the middle of the best stretch."""
    out = np.zeros(y.shape[1])
    for k in range(y.shape[1]):
        order = np.argsort(-scores[:, k])
        s, hit = scores[order, k], y[order, k]
        tp = np.cumsum(hit)
        f1 = 2 * tp / (np.arange(1, len(s) + 1) + max(hit.sum(), 1))
        best = np.flatnonzero(f1 >= f1.max() - 1e-9)
        i = int(best[len(best) // 2])
        out[k] = (s[i] + (s[i + 1] if i + 1 < len(s) else s[i] - 1)) / 2
    return out


def train(sample: list[tuple[str, str]], seed: int = 1, epochs: int = 4) -> Classifier:
    """A classifier from a sample of pairs whose defects are unknown."""
    r = np.random.default_rng(seed)
    base = [(q, a) for q, a in sample if has_words(a) and q and q.strip()]
    # exact beginnings: pairs that only repeat their question or don't speak its language are no good pairs
    base = [(q, a) for q, a in base if " ".join(_WORD.findall(a.lower())) != " ".join(_WORD.findall(q.lower()))]
    refuse = likely_refusals(base, r) if base else np.zeros(0, dtype=bool)
    refused = [p for p, x in zip(base, refuse) if x]
    base = [p for p, x in zip(base, refuse) if not x]
    model = None
    for turn in range(2):
        if not base:
            return Classifier(np.zeros((len(LABELS), 1 << _BITS)), np.full(len(LABELS), np.inf))
        if model is not None:
            kept = [p for p, d in zip(base, model.predict([q for q, _ in base], [a for _, a in base])) if d is None]
            base = kept or base
        pairs, y = _synthetic(base, r)
        pairs += refused
        y = np.concatenate([y, np.tile([float(x == "refusal") for x in LABELS], (len(refused), 1))])
        seen: dict[str, int] = {}
        for _, a in base:
            for v in {_shape(_norm(v)) for v in _WORD.findall(_clean(a).lower())}:
                seen[v] = seen.get(v, 0) + 1
        words = frozenset(v for v, n in seen.items() if n >= 3)
        x = [features(q, a, words) for q, a in pairs]
        held = r.random(len(x)) < 0.2
        w = _fit([f for f, h in zip(x, held) if not h], y[~held], epochs, seed + turn)
        model = Classifier(w, np.zeros(len(LABELS)), words)
        if held.any():
            model.thresholds = _thresholds(model.scores([f for f, h in zip(x, held) if h]), y[held])
    model.weights = model.weights.astype(np.float32)
    return model


_MODELS: dict[str, Classifier] = {}


def fitted(pairs: DataFrame, question: str, answer: str, most: int = 3000) -> Classifier:
    """The model for the ``most`` pairs of least hash (a bounded sample).

    It is trained once per sample and kept in the shared folder, from where later sessions take it.
    """
    rows = pairs.select(F.col(question).alias("q"), F.col(answer).alias("a")).where("q is not null and a is not null").distinct()
    rows = rows.orderBy(F.xxhash64("q", "a"), "q", "a").limit(most).collect()
    sample = [(x.q, x.a) for x in rows]
    key = model_key([sys.modules[__name__]], sample)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = stored(pairs.sparkSession, f"pairs-{key}", lambda: train(sample))
    return _MODELS[key]


def defects(pairs: DataFrame, key: str, question: str, answer: str, model: Classifier) -> DataFrame:
    """``(pair_key, defect)`` for the pairs that are defective.

    A null answer is empty; a null question counts as an empty text. Rows without key are left out, repeated rows
    count once, other columns are not read.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            found = m.predict(pdf["q"].tolist(), pdf["a"].tolist())
            yield pd.DataFrame({"pair_key": pdf["pair_key"], "defect": found}).dropna()

    rows = pairs.select(F.col(key).cast("long").alias("pair_key"), F.col(question).alias("q"), F.col(answer).alias("a")).where("pair_key is not null")
    return rows.distinct().mapInPandas(run, "pair_key bigint, defect string")
