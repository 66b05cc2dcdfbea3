"""Problem 8: the corpus as token ids of a byte-level BPE vocabulary, by a tokenization automaton.

The automaton has one state per token read last and accepts exactly the token sequences BPE produces. It starts with
the byte states, each with an arc for every byte, and takes the merges in order. The gadget of a merge ``a b -> c``

* makes the state of ``c`` as a copy of the state of ``b`` as it is then,
* gives an arc ``c`` to every state that has an arc ``a``, and
* takes the arc ``b`` from the state of ``a`` (before the arc ``c`` is given, which settles runs as ``a a a``).

Written out, 50,000 states with their arcs are billions of entries, so an arc is compiled when it is first asked for:
``Automaton.arc`` takes the gadgets back in reverse order until two byte states are left, and the answer is kept.

Encoding pre-splits the text, then runs each distinct word once through two tables: a table of reversed tokens gives
the tokens that end at each byte, the automaton says which of them may follow; exactly one does. Words are kept in
a table of bounded size per worker. Decoding joins the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same split for texts without the characters of _RARE, on which the classes of the two engines differ.
_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _rare_class() -> str:
    rare = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No")] + list("\x1c\x1d\x1e\x1f")
    return "[" + "".join(map(re.escape, rare)) + "]"


def _byte_letters() -> dict[str, int]:
    """The printable letters byte-level vocabularies write bytes with."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            out[chr(256 + n)] = b
            n += 1
    return out


class Automaton:
    """A tokenization automaton from a byte-level BPE file in the ``tokenizers`` JSON format."""

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        letters = _byte_letters()
        vocab = model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in vocab.items():
            if all(ch in letters for ch in token):
                self.bytes_of[i] = bytes(letters[ch] for ch in token)
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            c = vocab[a + b]
            if c in self.rank:
                raise ValueError("a token is made by two merges: the automaton needs one gadget per token")
            self.left[c], self.right[c], self.rank[c] = vocab[a], vocab[b], r
            self.merged[vocab[a], vocab[b]] = r
        # a token that merging its own bytes does not give is never a label
        reachable = {i for i, x in self.bytes_of.items() if len(x) == 1}
        for c in sorted(self.rank, key=self.rank.get):
            a, b = self.left[c], self.right[c]
            if a in reachable and b in reachable and self._compile(a, b, self.rank[c]):
                reachable.add(c)
        self.id_of = {self.bytes_of[i]: i for i in sorted(reachable)}
        # reversed tokens: (node << 8 | byte) -> node, and the token that ends a path
        self.goto: dict[int, int] = {}
        self.token_at = [-1]
        for word, i in self.id_of.items():
            node = 0
            for byte in reversed(word):
                key = node << 8 | byte
                if key not in self.goto:
                    self.goto[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.goto[key]
            self.token_at[node] = i
        self.arcs: dict[int, bool] = {}
        self.max_arcs = 4_000_000

    def arc(self, state: int, token: int) -> bool:
        """Whether the state of ``state`` has an arc ``token`` after all merges."""
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= self.max_arcs:
                self.arcs.clear()
            known = self.arcs[key] = self._compile(state, token)
        return known

    def _compile(self, q: int, x: int, before: int | None = None) -> bool:
        """The arc after the gadgets of ranks under ``before`` (all of them by default)."""
        rank, before = self.rank, len(self.merged) if before is None else before
        while True:
            if self.merged.get((q, x), before) < before:
                return False  # a gadget took the arc away
            rq, rx = rank.get(q, -1), rank.get(x, -1)
            if rq < 0 and rx < 0:
                return True
            if rq > rx:  # q was copied from the state of its right part just before its own gadget took an arc
                before, q = rq, self.right[q]
            else:  # x was given where its left part was an arc, after its gadget took one
                before, x = rx + 1, self.left[x]

    def word(self, w: bytes) -> tuple[int, ...]:
        """The token ids of one pre-split word."""
        whole = self.id_of.get(w)
        if whole is not None:
            return (whole,)
        goto, token_at, arc = self.goto, self.token_at, self.arc
        last = [0] * (len(w) + 1)  # the token that ends at each place
        start = [0] * (len(w) + 1)
        for end in range(1, len(w) + 1):
            node, at = 0, end
            while True:
                at -= 1
                node = goto.get(node << 8 | w[at])
                if node is None:
                    raise ValueError("no path in the automaton")  # cannot happen: every byte is a token
                t = token_at[node]
                if t >= 0 and (at == 0 or arc(last[at], t)):
                    last[end], start[end] = t, at
                    break
                if at == 0:
                    raise ValueError("no path in the automaton")
        out, at = [], len(w)
        while at:
            out.append(last[at])
            at = start[at]
        return tuple(reversed(out))

    def decode(self, ids) -> str:
        """The text of a sequence of ids: the labels of its arcs."""
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", errors="replace")


class _Rare(Exception):
    """A word holds a character on which the fast split may be wrong."""


class Encoder(dict):
    """Words already encoded; a missing word runs through the automaton. Emptied at ``limit`` words.

    Words with a character of the rare classes never enter the table, so a text whose words are all known was split
    rightly; the first rare word sends its text through the exact pattern.
    """

    def __init__(self, automaton: Automaton, limit: int = 300_000):
        self.automaton, self.limit = automaton, limit
        self.rare = re.compile(_rare_class())
        self.exact = None

    def __missing__(self, word: str) -> tuple[int, ...]:
        if not word.isascii() or len(word.strip("\x1c\x1d\x1e\x1f")) < len(word):
            if self.rare.search(word):
                raise _Rare
        if len(self) >= self.limit:
            self.clear()
        ids = self[word] = self.automaton.word(word.encode("utf-8"))
        return ids

    def _rare_words(self, text: str) -> list[tuple[int, ...]]:
        if self.exact is None:
            import regex

            self.exact = regex.compile(PATTERN)
        return [self.automaton.word(w.encode("utf-8")) for w in self.exact.findall(text)]

    def words(self, text: str | None) -> list[tuple[int, ...]]:
        """Token ids by word; null and empty texts have none."""
        if not text:
            return []
        try:
            return list(map(self.__getitem__, _WORDS.findall(text)))
        except _Rare:
            return self._rare_words(text)

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.words(text)))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.words(text)))


_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    """The file of byte_bpe_50k."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _shared_encoder(spark: SparkSession, path: str | None):
    """A function that gives the worker's encoder. The file (its size is that of a vocabulary) is read on the driver and broadcast."""
    path = path or default_tokenizer()
    with open(path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    key = path

    def get() -> Encoder:
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(Automaton(sent.value))
        return _ENCODERS[key]

    return get


def _id_batches(get, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = get()
    for b in batches:
        lists = [enc.ids(t) for t in b.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
        if ends[-1] > 2**31 - 1:
            raise ValueError("lower spark.sql.execution.arrow.maxRecordsPerBatch: one batch has over 2**31 tokens")
        flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every row's text, no special tokens.

    Null and empty texts have an empty list. One row per input row, repeated rows included; special tokens' strings
    in a text are ordinary text; other columns are not read. No shuffle: texts are encoded where they are scanned.
    """
    get = _shared_encoder(documents.sparkSession, tokenizer)
    picked = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(lambda it: _id_batches(get, it), "doc_id bigint, ids array<int>")


def _count_batches(get, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = get()
    for b in batches:
        n = pa.array(np.fromiter((enc.count(t) for t in b.column(1).to_pylist()), dtype=np.int64, count=b.num_rows))
        yield pa.RecordBatch.from_arrays([b.column(0), n], names=["doc_id", "tokens"])


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, tokens)``: the number of token ids of every row's text; null and empty texts have 0."""
    get = _shared_encoder(documents.sparkSession, tokenizer)
    picked = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(lambda it: _count_batches(get, it), "doc_id bigint, tokens bigint")


def decode(encoded: DataFrame, ids: str = "ids", tokenizer: str | None = None) -> Column:
    """A column with the texts of a column of ids; null ids give null."""
    get = _shared_encoder(encoded.sparkSession, tokenizer)

    @F.pandas_udf("string")
    def text(lists):  # noqa: ANN001, ANN202
        a = get().automaton
        return lists.map(lambda x: None if x is None else a.decode(x))

    return text(F.col(ids))
