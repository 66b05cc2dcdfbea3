"""Problem 10: long spans that occur verbatim in more than one document, by recompression.

Every text is rewritten in rounds: maximal runs of one symbol get a name, then adjacent pairs of a left and a right
symbol get a name; which symbols are left is a fixed function of name and round. Names are hashes of what they stand
for, so all workers name alike and equal substrings get equal symbols except near their ends. A round names only
what stays within its length (``CAPS``): how far the ends' surroundings reach in is bounded by ``MARGIN`` characters.

A window of ``span`` characters is represented by one symbol of its interior, the one with the least name; equal
windows have the same one at the same place. Runs of windows with the same symbol are one row (*segment*), some
2 / (symbols per window) of the text. Spark then finds symbols whose surroundings (``core``) stand in several texts,
the first and last window of each segment that several texts share, and, only for cores with a segment that is shared
in part, all windows of its segments. What is shared is decided by hashes of the characters themselves, 128 bits
with the core's. No pair of documents is ever formed; a passage in a third of all documents costs its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caselens.session import Scratch

#: Longest symbol, in characters, that each round may make.
CAPS = (2, 3, 4, 6, 8, 10)
#: Characters next to an end of a shared span in which symbols may differ: in each round a symbol depends on a run
#: and a neighbour, both no longer than the round's cap.
MARGIN = 2 * sum(CAPS) + len(CAPS)
#: Characters worked on at once; arrays of this size stay in the processor cache.
_CHUNK = 60_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _recompress(codes: np.ndarray, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and start places of the symbols of a text after all rounds; symbols never cross a ``wall`` character."""
    name = _mix(codes.astype(np.uint64) + _U(1))
    start = np.arange(len(codes), dtype=np.int64)
    total = len(codes)
    barrier = wall
    for r, cap in enumerate(CAPS):
        # runs
        new = np.empty(len(name), bool)
        new[:1] = True
        np.not_equal(name[1:], name[:-1], out=new[1:])
        new |= barrier
        new[1:] |= barrier[:-1]
        first = np.flatnonzero(new)
        if len(first) < len(name):
            size = np.diff(np.append(first, len(name)))
            ends = np.append(start[first[1:]], total)
            many = (size > 1) & (ends - start[first] <= cap)
            keep = np.ones(len(name), bool)
            inside = np.repeat(many, size)
            keep[inside] = False
            at = first[many]
            keep[at] = True
            name[at] = _mix(name[at] + _mix(size[many].astype(np.uint64) + _U(1 << 40)))
            name, start, barrier = name[keep], start[keep], barrier[keep]
        # pairs
        right = (_mix(name + _U(r + 1 << 50)) & _U(1)).astype(bool)
        end2 = np.append(start[2:], [total, total])[: len(start)]
        pair = ~right[:-1] & right[1:] & ~barrier[:-1] & ~barrier[1:] & (end2[:-1] - start[:-1] <= cap)
        at = np.flatnonzero(pair)
        name[at] = _mix(name[at] * _U(3) + _mix(name[at + 1] + _U(1 << 41)))
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, start, barrier = name[keep], start[keep], barrier[keep]
    return name, start


def _least(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least name in each [lo, hi), the first of equal ones."""
    out = lo.copy()
    width = hi - lo
    level, table = 0, np.arange(len(name))
    while True:
        own = (width >> level) == 1  # the largest power of two that fits
        if own.any():
            a = table[lo[own]]
            b = table[hi[own] - (1 << level)]
            out[own] = np.where(name[b] < name[a], b, a)
        if not (width >> (level + 1)).any():
            return out
        x, y = table[: -(1 << level)], table[1 << level :]
        table = np.where(name[y] < name[x], y, x)
        level += 1


def segments(texts: list[str], span: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts of at least ``span`` characters.

    Gives the joined text, the offset of each text in it, and for each segment: its text's number, place and end of
    its symbol, and the first and last window start (places in the joined text).
    """
    joined = "\x00".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    wall = np.zeros(len(codes), bool)
    wall[begin[1:] - 1] = True
    name, start = _recompress(codes, wall)
    n = len(codes)
    is_start = np.zeros(n + 1, bool)
    is_start[start] = True
    is_start[n] = True
    before = np.concatenate([[0], np.cumsum(is_start)])  # symbol starts at places < x
    # window starts at which the symbols in the interior change
    mark = np.zeros(n + 1, bool)
    s = start - MARGIN + 1
    mark[s[s >= 0]] = True
    e = np.append(start[1:], n) - span + MARGIN
    mark[e[e >= 0]] = True
    mark[begin] = True
    mark[begin + sizes - span + 1] = True
    at = np.flatnonzero(mark[:n])
    doc = np.searchsorted(begin, at, side="right") - 1
    ok = at <= begin[doc] + sizes[doc] - span
    nxt = np.append(at[1:], n)[ok]
    at, doc = at[ok], doc[ok]
    lo, hi = before[at + MARGIN], before[at + span - MARGIN + 1] - 1
    k = _least(name, lo, hi)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1
    k = k[first]
    end = np.append(start[1:], n)[k]
    return joined, begin, doc[first], start[k], end, at[first], nxt[last] - 1


_SEGMENT = "doc_id bigint, n int, class bigint, core bigint, p int, i0 int, i1 int, w0 bigint, w1 bigint"


def _segment_batches(span: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    h64 = xxhash.xxh3_64_intdigest

    def rows(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        joined, begin, doc, p, end, i0, i1 = segments(texts, span)
        kinds = np.array([h64(t) for t in texts], dtype=np.uint64).view(np.int64)
        m = MARGIN
        cores = [h64(joined[a:b]) for a, b in zip((p - m).tolist(), (end + m).tolist())]
        w0 = [h64(joined[a : a + span]) for a in i0.tolist()]
        w1 = [h64(joined[a : a + span]) for a in i1.tolist()]
        size = np.array([len(t) for t in texts], dtype=np.int32)
        shift = begin[doc]
        as64 = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        as32 = lambda x: pa.array((x - shift).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(ids, dtype=np.int64)[doc]), pa.array(size[doc]), pa.array(kinds[doc]), as64(cores), as32(p), as32(i0), as32(i1), as64(w0), as64(w1)],
            names=["doc_id", "n", "class", "core", "p", "i0", "i1", "w0", "w1"],
        )

    for b in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= _CHUNK:
                yield rows(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield rows(ids, texts)


def _window_batches(span: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the asked segments of each text."""
    import xxhash

    h64 = xxhash.xxh3_64_intdigest
    for b in batches:
        for doc, kind, text, asked in zip(*(c.to_pylist() for c in b.columns)):
            core, p, at, w = [], [], [], []
            for s in asked:
                places = range(s["i0"], s["i1"] + 1)
                core += [s["core"]] * len(places)
                p += [s["p"]] * len(places)
                at += places
                w += [h64(text[i : i + span]) for i in places]
            k = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc] * k, pa.int64()),
                    pa.array([kind] * k, pa.int64()),
                    pa.array(core, pa.int64()),
                    pa.array(p, pa.int32()),
                    pa.array(at, pa.int32()),
                    pa.array(np.array(w, dtype=np.uint64).view(np.int64)),
                ],
                names=["doc_id", "class", "core", "p", "i", "w"],
            )


def _several(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in texts of more than one class; aggregated before the shuffle."""
    return rows.groupBy(*keys).agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select(*keys)


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = 400) -> DataFrame:
    """``(doc_id, start, end)``: the maximal stretches of each text that lie in spans of ``span`` or more characters
    which occur verbatim in another row's text.

    Characters are code points, ``end`` is exclusive, stretches of one text neither touch nor overlap. Texts that are
    null, empty or shorter than ``span`` have none; rows without key are left out; keys are taken to be unique (a row
    delivered twice would be another document). Exact copies come out whole and are compared with others once.
    """
    if span < 2 * MARGIN + 2 * max(CAPS):
        raise ValueError(f"span must be at least {2 * MARGIN + 2 * max(CAPS)} characters")
    scratch = Scratch(documents.sparkSession, "spans")
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= span))
    every = scratch.save(docs.mapInArrow(lambda it: _segment_batches(span, it), _SEGMENT), "segments")

    # copies: whole texts are shared; one row per class goes on
    copies = every.groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).where("rep <> other")
    copies = scratch.save(copies.select("class", "rep"), "copies")
    full = scratch.save(every.select("doc_id", "class", "n").distinct().join(copies, "class", "left_semi").select("doc_id", "n"), "full")
    shared_cores = _several(every, "core")
    some = every.join(shared_cores, "core", "left_semi").join(copies, "class", "left").where("rep is null or rep = doc_id").drop("rep")
    some = scratch.save(some, "candidates")
    scratch.drop(every)

    # first and last window of each segment
    edge = some.select("core", "class", F.explode(F.array("w0", "w1")).alias("w"))
    found = _several(edge, "core", "w")
    f0 = found.select("core", F.col("w").alias("w0"), F.lit(True).alias("f0"))
    f1 = found.select("core", F.col("w").alias("w1"), F.lit(True).alias("f1"))
    tried = some.join(f0, ["core", "w0"], "left").join(f1, ["core", "w1"], "left").fillna(False, ["f0", "f1"])
    tried = scratch.save(tried.select("doc_id", "class", "core", "p", "i0", "i1", "f0", "f1"), "tried")
    scratch.drop(some)
    whole = tried.where("f0 and f1").select("doc_id", F.col("i0").alias("start"), (F.col("i1") + span).alias("end"))

    # segments shared in part: all windows of every segment with their core
    open_cores = tried.where("not (f0 and f1)").select("core").distinct()
    asked = tried.join(open_cores, "core", "left_semi").groupBy("doc_id", "class").agg(F.collect_list(F.struct("core", "p", "i0", "i1")).alias("asked"))
    windows = asked.join(docs, "doc_id").select("doc_id", "class", "text", "asked").mapInArrow(
        lambda it: _window_batches(span, it), "doc_id bigint, class bigint, core bigint, p int, i int, w bigint"
    )
    windows = scratch.save(windows, "windows")
    part = windows.join(_several(windows, "core", "w"), ["core", "w"], "left_semi")
    # the windows of a segment all hold its core, so the shared ones of a segment cover one stretch
    part = part.groupBy("doc_id", "p").agg(F.min("i").alias("start"), (F.max("i") + span).alias("end")).drop("p")
    part = scratch.save(part, "part")
    scratch.drop(windows)

    pieces = whole.unionByName(part)
    alone = pieces.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    over = W.partitionBy("doc_id").orderBy("start", "end")
    until = F.max("end").over(over.rowsBetween(W.unboundedPreceding, -1))
    alone = alone.withColumn("new", F.coalesce(F.col("start") > until, F.lit(True)).cast("int")).withColumn("g", F.sum("new").over(over))
    alone = alone.groupBy("doc_id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")
    return alone.unionByName(full.select("doc_id", F.lit(0).alias("start"), F.col("n").alias("end")))


def shared_chars(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = 400) -> DataFrame:
    """``(doc_id, shared_chars)``: how much of each text stands elsewhere; see ``shared_spans``. No row for 0."""
    spans = shared_spans(documents, key, text, span)
    return spans.groupBy("doc_id").agg(F.sum((F.col("end") - F.col("start")).cast("long")).alias("shared_chars"))
