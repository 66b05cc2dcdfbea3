import random

import numpy as np
import pytest

from caselens.llm import spans
from caselens.llm.spans import MARGIN, segments, shared_chars, shared_spans

SPAN = 400


def brute(texts, span=SPAN):
    where = {}
    for d, t in texts.items():
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in texts.items():
        hit = [i for i in range(len(t or "") - span + 1) if len(where[t[i : i + span]]) > 1]
        cover = {p for i in hit for p in range(i, i + span)}
        if cover:
            out[d] = len(cover)
    return out


def run(spark, texts):
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in texts.items()], "doc_id long, text string, core string, p int")
    rows = shared_chars(df).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: r.shared_chars for r in rows}


def test_against_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh ی") for _ in range(r.randint(2, 7)))
    noise = lambda n: " ".join(word() for _ in range(n))
    passages = [noise(150)[:n] for n in (399, 400, 401, 430, 520, 900)] + ["=" * 700, "ab" * 400, ("| x | y |\n" * 80), "z" * 3000]
    texts = {}
    for i in range(45):
        parts = [noise(r.randint(0, 60))]
        for p in r.sample(passages, r.randint(0, 3)):
            a = r.choice([0, 0, r.randint(0, 60)])
            parts += [p[a : len(p) - r.choice([0, 0, r.randint(0, 60)])], noise(r.randint(0, 40))]
        texts[i] = "".join(parts)
    texts |= {100: None, 101: "", 102: " " * 50, 103: texts[3] + "", 104: texts[5], 105: "q" * 399, 106: "q" * 399, 107: noise(9000)}
    assert run(spark, texts) == brute(texts)


def test_exact_edges(spark):
    r = random.Random(9)
    base = "".join(r.choice("abcdefghijklmnop ") for _ in range(400))
    assert run(spark, {1: "X" + base, 2: base + "Y"}) == {1: 400, 2: 400}
    assert run(spark, {1: "X" + base[:399], 2: base[:399] + "Y"}) == {}
    spots = {(x.doc_id, x.start, x.end) for x in shared_spans(spark.createDataFrame([(1, "X" + base), (2, base + "Y")], "doc_id long, text string")).collect()}
    assert spots == {(1, 1, 401), (2, 0, 400)}


def test_equal_windows_get_the_same_symbol():
    r = random.Random(11)
    shared = "".join(r.choice("abcde \n-") for _ in range(1200))
    a, b = "".join(r.choice("abcde") for _ in range(333)) + shared, shared + "".join(r.choice("abcde") for _ in range(77))
    def offsets(t):
        _, _, _, p, _, i0, i1 = segments([t], SPAN)
        return {i: int(s) - i for s, x, y in zip(p, i0, i1) for i in range(x, y + 1)}
    oa, ob = offsets(a), offsets(b)
    assert len(oa) == len(a) - SPAN + 1
    assert all(oa[333 + i] == ob[i] for i in range(1200 - SPAN + 1))
    assert all(MARGIN <= v <= SPAN - MARGIN for v in oa.values())


def test_least_takes_the_first_of_equals():
    name = np.array([5, 3, 3, 9, 1], dtype=np.uint64)
    assert spans._least(name, np.array([0, 1, 3, 0]), np.array([4, 3, 4, 5])).tolist() == [1, 1, 3, 4]


def test_empty_and_short_span(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shared_chars(df).count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, span=50)
