import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselens.llm.bpe import Automaton, Encoder, decode, default_tokenizer, encode, token_counts


@pytest.fixture(scope="module")
def automaton():
    with open(default_tokenizer(), encoding="utf-8") as f:
        return Automaton(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_the_library(automaton, library, text):
    enc = Encoder(automaton)
    assert enc.ids(text) == library.encode(text, add_special_tokens=False).ids
    assert automaton.decode(enc.ids(text)) == text


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "-" * 3000, "\n \t\r\n", "²Ⅷ½", "I'll've", "<|endoftext|>", "\x1c\x1d x", "کیا ١٢۳", "👩‍👩‍👧", "ab" * 4000, "á", "  x"])
def test_hard_texts(automaton, library, text):
    assert Encoder(automaton, limit=3).ids(text) == library.encode(text, add_special_tokens=False).ids


def _toy(merges):
    letters = {c: i for i, c in enumerate("abc")}
    for m in merges:
        letters.setdefault(m[0] + m[1], len(letters))
    return json.dumps({"model": {"vocab": letters, "merges": [list(m) for m in merges]}})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12), st.text(alphabet="abc", max_size=14))
def test_gadgets_against_merging_by_rank(picks, word):
    merges, tokens = [], ["a", "b", "c"]
    for p in picks:
        x, y = tokens[p % len(tokens)], tokens[(p // 7) % len(tokens)]
        if x + y not in tokens:
            merges.append((x, y))
            tokens.append(x + y)
    if not merges:
        return
    a = Automaton(_toy(merges))
    parts = list(word)
    rank = {m: r for r, m in enumerate(merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            break
        pair, out, i = merges[best[0]], [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    if word:
        assert [a.bytes_of[i].decode() for i in a.word(word.encode())] == parts


def test_two_merges_for_one_token_are_refused():
    with pytest.raises(ValueError):
        Automaton(_toy([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")]))


def test_in_spark(spark, library):
    rows = [(1, "hello world", "i", 1), (2, None, "i", 1), (3, "", "i", 1), (4, "x y " * 20_000, "i", 1), (1, "hello world", "i", 1), (None, "z", "i", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, tokens int")
    out = encode(df)
    got = [(r.doc_id, list(r.ids)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((d, library.encode(t or "", add_special_tokens=False).ids) for d, t, _, _ in rows), key=str)
    assert {r.doc_id: r.back for r in out.select("doc_id", decode(out).alias("back")).collect()}[1] == "hello world"
    assert sorted(r.tokens for r in token_counts(df).collect()) == sorted(len(x) for _, x in got)
    assert encode(spark.createDataFrame([], df.schema)).count() == 0
