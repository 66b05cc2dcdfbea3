import contextlib
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from caselens import scope
from caselens.functions import extract as ex
from caselens.functions import text as tx
from caselens.operators import aggregates as agg
from caselens.operators import graph as gr
from caselens.operators import relational as rel
from caselens.operators import resolution as er
from caselens.operators import retrieval as rt
from caselens.operators import verification as vf
from caselens.operators import windows as win


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_scope_never_leaks(spark):
    rows = spark.createDataFrame([("p", False, "c1", "s"), ("q", True, "c1", "s"), ("q", False, "c2", "t"), (None, None, None, None)], "project_id string, is_global boolean, case_id string, source string")
    assert rows.where(scope.Scope(project_id="p").predicate()).count() == 2
    assert rows.where(scope.Scope(project_id="p", case_id="c2").predicate()).count() == 0
    assert rows.where(scope.Scope().predicate()).count() == 4
    assert rows.where(scope.row_policy(True, False, "c2")).count() == 1
    assert rows.where(scope.row_policy(True, False, "")).count() == 1
    audit = []
    with pytest.raises(scope.AccessDenied):
        scope.require_cross_case("investigator", audit)
    scope.require_cross_case("supervisor", audit)
    assert [a["event"] for a in audit] == ["authorization_violation", "cross_case_query"]
    with pytest.raises(ValueError):
        scope.require_case("")


def test_percentiles_both_ways(spark):
    r = random.Random(1)
    for n in (1, 2, 29, 30, 31, 100):
        values = sorted(r.randint(0, 60) for _ in range(n))
        df = spark.createDataFrame([("k", v) for v in values] + [("k", -5), ("k", None)], "k string, v int")
        want = values[max(0, min(n - 1, round(0.95 * n) - 1))]
        a = df.agg(*agg.percentiles(F.col("v"))).first()
        b = agg.percentiles_distributed(df, ["k"], "v").first()
        assert a["p95"] == b["p95"] == want
        assert (a["count"], a["avg"], a["p50"], a["max"]) == (b["count"], b["avg"], b["p50"], b["max"])
    empty = spark.createDataFrame([], "k string, v int").agg(*agg.percentiles(F.col("v"))).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_status_and_reference_lookup(spark):
    c = spark.createDataFrame([("1", "Closed", "THEFT"), ("2", None, "THEFT"), ("3", "Open", None)], "case_id string, investigation_status string, crime_category string")
    assert {r[0] for r in rel.filter_cases(c, "open cases").collect()} == {"2", "3"}
    assert {r[0] for r in rel.filter_cases(c, "closed and open").collect()} == {"1"}
    assert rel.reference_lookup(c).count() == 0 and rel.reference_lookup(c, empty_means_all=True).count() == 3
    assert rel.reference_lookup(c, crime_category="the_t").count() == 0


def test_nested_report_fields(spark):
    schema = (
        "fir struct<case_id:string,id:string,incident_at:string,sections:array<struct<act:string>>,statuses:array<struct<position:string,status_date:string>>,"
        "officers:array<struct<name:string,assigned_to:string>>>"
    )
    full = ({"case_id": None, "id": "7", "incident_at": "2025-01-02T03:04", "sections": [{"act": "PPC"}, {"act": "PPC"}, {"act": "CNSA"}], "statuses": [{"position": "open", "status_date": "2025-01-03"}, {"position": None, "status_date": "2025-02-01"}], "officers": [{"name": "A", "assigned_to": "2025"}, {"name": "B", "assigned_to": None}]},)
    bare = ({"case_id": "c", "id": None, "incident_at": "bad", "sections": None, "statuses": None, "officers": None},)
    a, b = spark.createDataFrame([full, bare], schema).select(*rel.case_fields()).collect()
    assert tuple(a) == ("7", "PPC, CNSA", "open", "B", dt.date(2025, 1, 2))
    assert tuple(b) == ("c", "", None, None, None)


def test_text_functions(spark):
    assert one(spark, tx.tokens, "FIR-2025-3 seen, Twice.") == ["fir-2025-3", "fir", "2025", "3", "seen", "twice"]
    assert one(spark, tx.normalize, "كي ١٢​") == "کی 12"
    assert one(spark, tx.normalize, None) is None and one(spark, tx.squeeze, "a    b  c") == "a b  c"
    assert one(spark, tx.sentences, "Dr. Khan came. He left at 3.15 pm.\n1. Next point") == ["Dr. Khan came.", "He left at 3.15 pm.", "1. Next point"]
    long = "word " * 30_000
    chunks = one(spark, tx.chunks, long)
    assert all(len(c) <= 512 for c in chunks) and one(spark, tx.chunks, "") == [] and one(spark, tx.chunks, None) is None
    assert one(spark, tx.excerpt, "x" * 300)[-1] == "…" and one(spark, tx.name_list, "a, ،b ") == ["a", "b"]
    assert one(spark, tx.is_roman_urdu, "mulzim ne bataya keh woh ghar se nikla aur phir thane mein hai aur wapas nahi gaya tha") is True
    assert one(spark, tx.is_roman_urdu, None) is False


def test_extraction(spark):
    t = "CNIC 12345 1234567 1, call 0300-1234567, car abc-D-1234, FIR-2025-THEFT-0012 under 302 PPC on 31-02-2025 and 2025-03-04"
    assert one(spark, ex.cnics, t) == ["12345-1234567-1"] and one(spark, ex.phones, t) == ["0300-1234567"]
    assert one(spark, ex.plates, t) == ["ABC-D-1234"] and one(spark, ex.fir_numbers, t) == ["FIR-2025-THEFT-0012"]
    assert one(spark, ex.sections, t) == ["302 PPC"] and one(spark, ex.dates, t) == [dt.date(2025, 3, 4)]
    assert one(spark, ex.cnics, None) is None and one(spark, ex.cnics, "") == []
    e = one(spark, lambda c: ex.entities(c, 0.0), "Ahmed Khan s/o Bilal Khan at PS Gulnar")
    assert [(x.kind, x.value) for x in e] == [("PERSON", "Ahmed Khan"), ("PERSON", "Bilal Khan"), ("STATION", "PS Gulnar")]
    assert one(spark, ex.plausible_person, "Ali Khan") and not one(spark, ex.plausible_person, "Mall Road") and not one(spark, ex.plausible_person, None)


def test_bm25_by_hand(spark):
    import math

    docs = {1: "red car red", 2: "blue car", 3: "green tree", 4: "red tree tree house"}
    df = spark.createDataFrame(list(docs.items()) + [(5, ""), (6, None)], "key int, text string")
    post = rt.postings(df, "key", "text")
    q = spark.createDataFrame([("q", "red", 1), ("q", "house", 2)], "query string, term string, n int")
    got = {r.key: r.score for r in rt.bm25(q, post).collect()}
    n, avg = 4, sum(len(t.split()) for t in docs.values()) / 4
    vocab = {w for t in docs.values() for w in t.split()}
    idf = {w: math.log(n - sum(w in t.split() for t in docs.values()) + 0.5) - math.log(sum(w in t.split() for t in docs.values()) + 0.5) for w in vocab}
    mean = sum(idf.values()) / len(idf)
    for k, t in docs.items():
        s = 0
        for w, c in (("red", 1), ("house", 2)):
            f = t.split().count(w)
            s += c * (idf[w] if idf[w] >= 0 else 0.25 * mean) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t.split()) / avg))
        if s > 0:
            assert got[k] == pytest.approx(s, abs=1e-5)
        else:
            assert k not in got


def test_bm25_of_texts_in_many_blocks_and_of_repeated_keys(spark, monkeypatch):
    import math

    monkeypatch.setattr(rt._best, "__defaults__", (5,))  # rows a block
    texts = {i: f"car {'red ' * (i % 3)}{'tree ' * (i % 7 == 0)}x{i % 40}" for i in range(90)}
    rows = [(i, t) for i, t in texts.items()] + [(7, "red tree more"), (11, "red"), (200, None), (201, " - ")]
    texts[7], texts[11] = texts[7] + " red tree more", texts[11] + " red"  # rows of one key are one text
    q = spark.createDataFrame([("a", "red", 1), ("a", "tree", 2), ("b", "car", 1), ("b", "x3", 1), ("c", "none", 1)], "query string, term string, n int")
    got = {(r.query, r["rank"]): (r.key, r.score) for r in rt.bm25_texts(q, spark.createDataFrame(rows, "key long, text string").repartition(6), "key", "text", 4).collect()}
    words = {i: t.split() for i, t in texts.items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = {w: sum(w in t for t in words.values()) for w in {w for t in words.values() for w in t}}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    for query, terms in (("a", {"red": 1, "tree": 2}), ("b", {"car": 1, "x3": 1})):
        score = {}
        for i, t in words.items():
            for w, c in terms.items():
                f = t.count(w)
                score[i] = score.get(i, 0) + c * (0.25 * mean if idf[w] < 0 else idf[w]) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        best = sorted((-round(s, 6), i) for i, s in score.items())[:4]
        assert [got[query, k] for k in range(1, 5)] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in best]
    assert len(got) == 8


def test_bm25_never_shuffles_texts_or_copies_queries(spark):
    import re

    rows = spark.createDataFrame([(i, f"car red x{i}") for i in range(50)], "key long, text string").repartition(20)
    q = spark.createDataFrame([("a", "red", 1), ("b", "x3", 1)], "query string, term string, n int")
    plan = rt.bm25_texts(q, rows, "key", "text", 3)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in re.findall(r"Exchange ([^\n]*)", plan) if not x.startswith("hashpartitioning(query")] == []  # only the best of each query move
    assert re.search(r"Coalesce 4\b", plan)  # each task sends its own best: no more tasks than cores


def test_topk_bm25_moves_only_the_best_of_each_query(spark, sf):
    import re

    import __spark_entry__ as entry

    plan = entry.queries()["topk_bm25"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange ([^\n]*)", plan)
    assert moved and all(x.startswith("hashpartitioning(query") for x in moved)


def test_topk_bm25_needs_less_disk_than_its_input(spark, tmp_path):
    """Shuffle files and scratch tables of the whole query, those of the steps before its last plan too."""
    import __spark_entry__ as entry
    from caselens.session import shared_dir

    r = random.Random(3)
    draw = lambda n: " ".join(f"word{int(r.paretovariate(0.5)) % 1500}" for _ in range(n))
    spark.createDataFrame([(i, draw(200)) for i in range(4000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, draw(8)) for i in range(2000)], "query_id long, user_message string").write.parquet(f"{tmp_path}/queries.parquet")

    def size(*roots):
        found = {}
        for path in (f"{at}/{name}" for root in roots for at, _, names in os.walk(root) for name in names):
            with contextlib.suppress(FileNotFoundError):  # of an earlier test, removed just now
                found[path] = os.path.getsize(path)
        return found

    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    before = size(*local, shared_dir(spark))
    assert entry.queries()["topk_bm25"](spark, str(tmp_path)).count() == 300  # the best three of each of 100 questions
    left = sum(n for path, n in size(*local, shared_dir(spark)).items() if path not in before)
    assert 0 < left < sum(size(tmp_path).values())


@pytest.mark.parametrize("few", [0, 2, 64])
def test_bm25_of_common_and_rare_terms_against_brute_force(spark, monkeypatch, few):
    import math
    from collections import Counter

    monkeypatch.setattr(rt, "FEW", few)
    monkeypatch.setattr(rt, "QUERIES_PER_TASK", 9)  # queries come in blocks too
    monkeypatch.setattr(rt._best, "__defaults__", (20,))  # rows a block
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        r = random.Random(few)
        draw = lambda n: [f"w{int(r.paretovariate(0.5)) % 90}" for _ in range(n)]
        texts = {i: draw(r.randint(1, 12)) for i in range(400)}
        texts |= {i: ["w1", "w2", "w3"] for i in range(400, 460)}  # ties
        asked = {i: Counter(draw(r.randint(1, 6))) for i in range(30)} | {90: Counter(["w1"]), 91: Counter(["w1", "w2", "w80"]), 92: Counter(["none"])}
        rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "key long, text string").repartition(7)
        q = spark.createDataFrame([(i, w, c) for i, t in asked.items() for w, c in t.items()], "query int, term string, n int")
        got = {(x.query, x["rank"]): x.key for x in rt.bm25_texts(q, rows, "key", "text", 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean, want = sum(idf.values()) / len(idf), {}
    for query, terms in asked.items():
        score = {i: round(sum(c * (0.25 * mean if idf[w] < 0 else idf[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w, c in terms.items() if w in t), 6) for i, t in texts.items()}
        want |= {(query, k): i for k, i in enumerate(sorted((i for i, x in score.items() if x > 0), key=lambda i: (-score[i], i))[:5], 1)}
    assert got == want


def test_bm25_ties_at_the_cut_of_three_go_to_the_least_keys(spark, monkeypatch):
    monkeypatch.setattr(rt._best, "__defaults__", (4,))  # rows a block
    rows = [(i, "red car") for i in range(40)] + [(i, f"blue x{i} red") for i in range(40, 50)] + [(i, "tree house") for i in range(50, 180)]
    q = spark.createDataFrame([("q", "car", 1)], "query string, term string, n int")
    got = rt.bm25_texts(q, spark.createDataFrame(rows, "key long, text string").repartition(5), "key", "text", 3)
    assert [(r.key, r["rank"]) for r in got.orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]


def _asked_of_whole_table(spark, at):
    """Questions of any id, some without an id, some asked alike: ids and the document that each names."""
    spark.createDataFrame([(i, f"parcel x{i} of the register") for i in range(40)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    asked = [(i, f"where is x{i % 30}?") for i in range(1, 62)] + [(None, "where is x7?")]
    spark.createDataFrame(asked, "query_id long, user_message string").write.parquet(f"{at}/queries.parquet")
    return {(i, int(m[10:-1])) for i, m in asked}


def test_rt_bm25_answers_every_question(spark, tmp_path):
    import __spark_entry__ as entry

    want = _asked_of_whole_table(spark, tmp_path)
    assert {(r.query, r.key) for r in entry.queries()["rt_bm25"](spark, str(tmp_path)).collect()} == want


def test_topk_bm25_answers_every_question(spark, tmp_path):
    import __spark_entry__ as entry

    want = _asked_of_whole_table(spark, tmp_path)
    assert {(r.query, r.key) for r in entry.queries()["topk_bm25"](spark, str(tmp_path)).collect()} == want


def test_bags_hold_the_tokens(spark):
    from caselens.functions.text import tokens

    texts = ["a--b c-d-.e f_g/h.i. -j k- \u0663\u0664-\u06f5 \U00010400-\U00010401x", "", "...", "\u00e9-\u00e8_\u00fc \u0130stanbul-x A.B.C a a", "FIR-2025-3/4 x.y@z-w", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("a"), rt._bag(F.col("t")).alias("b"))
    assert all((r.a and sorted(r.a)) == (r.b and sorted(r.b)) for r in df.collect())


def test_rt_hybrid_answers_every_question(spark, tmp_path):
    import __spark_entry__ as entry

    want = _asked_of_whole_table(spark, tmp_path)
    got = entry.queries()["rt_hybrid"](spark, str(tmp_path)).collect()
    assert {r.query for r in got} == {i for i, _ in want} and len(got) == 10 * len(want)
    both = {(r.query, r.key): r.rrf for r in got}
    assert all(both[x] >= 1 / 61 - 1e-6 for x in want)  # the named document leads by its words


def test_equal_query_vectors_are_compared_once(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(50)], "id long, e array<double>")
    same = [[r.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    q = spark.createDataFrame([(i, same[i % 3]) for i in range(12)] + [(None, same[0]), (99, None)], "id long, e array<double>")
    read = lambda once: sorted((x.query or -1, x["rank"], x.key, round(x.score, 6)) for x in rt.vector_top_k(q, rows, "id", "e", 5, once=once).collect())
    assert read(True) == read(False) and len(read(True)) == 65


def test_vector_ties_are_broken_by_key_after_rounding(spark):
    # cosines that differ by less than six digits show tie, so the least keys come first although their cosines are less
    rows = [(k, [1.0, 1e-4 * (5 - k)]) for k in range(5)] + [(k, [0.0, 1.0]) for k in range(5, 60)]
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(3)
    got = rt.vector_top_k(spark.createDataFrame([(9, [1.0, 0.0])], "id long, e array<double>"), df, "id", "e", 2, row_block=7)
    assert [(r.key, r.rank) for r in got.orderBy("rank").collect()] == [(0, 1), (1, 2)]


def test_vector_top_k_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(2)
    v = r.normal(size=(120, 8)).astype(np.float32)
    rows = [(i, v[i].tolist()) for i in range(120)] + [(500, None), (501, [])]
    df = spark.createDataFrame(rows, "id long, e array<float>").repartition(5)
    got = {}
    for x in rt.vector_top_k(df.where("id % 20 = 0"), df, "id", "e", 5, query_block=2).collect():
        got.setdefault(x.query, {})[x["rank"]] = x.key
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 120, 20):
        best = sorted(range(120), key=lambda i: (-round(float(max(0, u[q] @ u[i])), 6), i))[:5]
        assert [got[q][k] for k in range(1, 6)] == best


def test_fusion_counts_repeats(spark):
    lists = spark.createDataFrame([("q", "a", 1), ("q", "a", 4), ("q", "b", 1)], "query string, key string, rank int")
    got = {r.key: r.rrf for r in rt.fuse(lists).collect()}
    assert got == {"a": round(1 / 61 + 1 / 64, 6), "b": round(1 / 61, 6)}


def test_resolution(spark):
    assert er.token_sort_ratio("Ali Khan", "khan ali") == 1 and er.token_sort_ratio(None, "x") == 0
    assert er.indel_ratio("kitten", "sitting") == pytest.approx(2 * 4 / 13)
    m = spark.createDataFrame([("m1", "B", "Ali Khan", None), ("m2", "B", "Ali Khan", "1"), ("m3", None, "Ali Khan", None)], "mention_id string, beat string, name string, cnic string")
    e = spark.createDataFrame([("e1", "B", "Aly Khan", "2"), ("e2", "B", "Zed Foo", None)], "entity_id string, beat string, name string, cnic string")
    assert [(r.m_id, r.e_id) for r in er.candidates(m, e, "beat", "name", "cnic").collect()] == [("m1", "e1")]


def test_graph(spark):
    edges = spark.createDataFrame([("s", "a", "associated", 0.5), ("a", "b", "associated", 0.5), ("a", "x", "same", None), ("b", "c", "associated", 1.0), ("s", "p", "pending", 0.9), ("q", "q", "same", 1.0), (None, "z", "same", 1.0)], "a string, b string, kind string, confidence double")
    seeds = spark.createDataFrame([("s",)], "node string")
    got = {r.node: (r.hop, r.confidence) for r in gr.traverse(seeds, edges, 2).collect()}
    assert got == {"s": (0, 1.0), "p": (0, 0.8), "a": (1, 0.5), "x": (1, 0.5), "b": (2, 0.25)}
    only = spark.createDataFrame([("s",), ("a",)], "node string")
    assert {r.node for r in gr.traverse(seeds, edges, 2, allowed=only).collect()} == {"s", "a"}
    v = spark.createDataFrame([(1, 2), (2, 3), (3, None), (9, None)], "edge_id long, superseded_by long")
    assert {r.edge_id: (r.newest, r.versions) for r in gr.history(v).collect()} == {1: (3, 3), 2: (3, 2), 3: (3, 1), 9: (9, 1)}
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(4) for j in range(i)]
    w = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0", 0.1)], "a string, b string, weight double")
    com = {r.id: r.community for r in gr.communities(w).collect()}
    assert com == {f"{p}{i}": f"{p}0" for p in "ab" for i in range(4)}
    spread = {r.id: r.community for r in gr.communities(w, largest=1).collect()}
    assert set(spread) == set(com)


def test_append_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    old = spark.createDataFrame([(1, None, False), (2, 1, False), (3, None, True)], "edge_id long, superseded_by long, locked boolean")
    new = spark.createDataFrame([(10, "a", "b", 1), (11, "a", "b", 1), (12, "a", "z", None), (13, "a", "b", 2), (14, "a", "b", 3), (15, "a", "b", 99), (16, "a", "b", None)], "edge_id long, src string, dst string, supersedes long")
    got = {r.edge_id: r.status for r in gr.append_edges(old, new, nodes).collect()}
    assert got == {10: "written", 11: "already_superseded", 12: "missing_end", 13: "already_superseded", 14: "locked", 15: "unknown_prior", 16: "written"}


def test_verification(spark):
    a = "It is so [Document 2]. And so [Document 7]."
    assert one(spark, lambda c: vf.invalid_citations(c, F.lit(5)), a) == [7]
    assert one(spark, vf.refuses, "No information.") and not one(spark, vf.refuses, "No information in [Document 1]") and not one(spark, vf.refuses, None)
    assert one(spark, vf.uncited, "x" * 200) and not one(spark, vf.uncited, "short")
    assert one(spark, lambda c: vf.verdict(c), None, "boolean") == "FAIL"
    answers = spark.createDataFrame([("q", a)], "answer_id string, text string")
    passages = spark.createDataFrame([("q", 2, "c1"), ("q", 7, "c9")], "answer_id string, number int, case_id string")
    allowed = spark.createDataFrame([("q", "c1")], "answer_id string, case_id string")
    assert [tuple(r) for r in vf.leaks(answers, passages, allowed).collect()] == [("q", 7)]


def test_windows(spark):
    m = spark.createDataFrame([("s", i, "x" * 400) for i in range(9)], "s string, i int, t string")
    kept = sorted(r.i for r in win.message_budget(m, "s", ["i"], "t", budget=350).collect())
    assert kept == [6, 7, 8]
    assert win.case_cap(m, "s", "i", "t", total=0).count() == 0
    cut = {r.i: len(r.t) for r in win.char_budget(m, "s", "i", "t", 900).collect()}
    assert cut == {0: 400, 1: 400, 2: 100}


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 4, None), ("k", 6, "c")], "k string, t int, v string")
    got = {(r.k, r.t): r.v_as_of for r in rel.as_of_join(left, right, "k", "t", "v").collect()}
    assert got == {("k", 5): None, ("k", 1): None, ("z", 9): None}


def test_shared_groups_of_any_size(spark):
    rows = [(f"e{i:03}", "crowd") for i in range(60)] + [("e000", "g"), ("e001", "g"), (None, "g"), ("e001", None)]
    df = spark.createDataFrame(rows, "e string, g string")
    got = {(r.a, r.b): r.n for r in agg.shared_groups(df, "e", "g", at_once=7).collect()}
    assert len(got) == 60 * 59 // 2 and got[("e000", "e001")] == 2 and sum(got.values()) == 60 * 59 // 2 + 1


def test_history_of_a_long_chain(spark):
    v = spark.range(1, 601).selectExpr("id edge_id", "nullif(id + 1, 601) superseded_by")
    assert {tuple(r)[1:] for r in gr.history(v).where("edge_id = 1").collect()} == {(600, 600)}
    with pytest.raises(RuntimeError):
        gr.history(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "edge_id long, superseded_by long"), max_rounds=4)


def test_candidates_are_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeiklmnrst") for _ in range(r.randint(1, 9)))
    names = lambda n: [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(n)]
    ms = [*names(40), "Taaslim Langokar", "  ", "", None, "long " * 20, "Ab"]
    es = [*names(320), "Tasleem Lngokra", " ", "", None, "long " * 19 + "lng", "Ba"]
    m = [(f"m{i}", "B" if i % 3 else None, n, str(i % 2) if i % 5 == 0 else None) for i, n in enumerate(ms)]
    e = [(f"e{i}", "B" if i % 4 else "C", n, "" if i % 7 == 0 else "1" if i % 5 == 0 else None) for i, n in enumerate(es)]
    dm = spark.createDataFrame(m, "mention_id string, beat string, name string, cnic string")
    de = spark.createDataFrame(e, "entity_id string, beat string, name string, cnic string")
    for block in (None, "beat"):
        want = {(a[0], b[0]): er.token_sort_ratio(a[2], b[2]) for a in m for b in e if (block is None or a[1] == b[1] is not None) and not (a[3] and b[3] and a[3] != b[3])}
        got = er.candidates(dm, de, block, "name", "cnic").collect()
        assert len(got) == len({(x.m_id, x.e_id) for x in got})
        assert {(x.m_id, x.e_id): x.similarity for x in got} == {k: v for k, v in want.items() if v >= 0.4}


def test_echoes_of_any_earlier_answer(spark):
    r = random.Random(6)
    long = "The case file names two witnesses and one vehicle seen near the market, and more is not on record today"
    texts = [long, long.upper(), long[:50], long[:85], long[20:70], long[:82] + " but then another end", long[:45] + " other words", "So: " + long + "!", "the market", "  two witnesses ", "nothing of it", "", None]
    m = [(f"s{s}", i, r.choice(["user", "user", "assistant", "assistant", None]), r.choice(texts)) for s in range(30) for i in range(8)]
    m += [("t", 0, "assistant", long), ("t", 1, "user", "and?"), ("t", 2, "assistant", "short"), ("t", 3, "user", long), ("u", 0, "user", long), ("u", 1, "assistant", long)]

    def echo(now, said):
        n = min(len(now), len(said), 80)
        return len(said) >= 40 and (now in said or said in now or (n >= 40 and now[:n] == said[:n]))

    want = {(s, i) for s, i, role, t in m if role == "user" and t and any(s2 == s and j < i and role2 == "assistant" and x is not None and echo(t.strip().lower(), x.lower()) for s2, j, role2, x in m)}
    df = spark.createDataFrame(m, "s string, i int, role string, t string")
    got = [(x.s, x.i) for x in win.echoes(df, "s", ["i"], "role", "t").collect()]
    assert sorted(got) == sorted(want) and ("t", 3) in want and ("u", 0) not in want


def test_distinct_people_as_counted_in_order(spark):
    from caselens.functions.misc import distinct_names

    r = random.Random(8)
    base = ["Hamza Awrisht", "Kiran Rusnwal", "Jameela Sultana Ghandokar", "Ali Khan", "Aly Khan", "Bo"]

    def variant(n):
        w = n.split()
        r.shuffle(w)
        n = ", ".join(w) if r.random() < 0.3 else " ".join(w)
        k = r.randrange(len(n))
        return n[:k] + r.choice(["", "x", n[k]]) + n[k + 1 :]

    rows = [(f"B{i % 2}", variant(r.choice(base))) for i in range(160)] + [("C", "Hamza Awrisht"), ("C", "Awrisht Hamza"), ("C", ""), ("C", " "), ("C", "  "), (None, "x"), ("C", None)]
    want = {b: distinct_names([n for c, n in rows if c == b and n is not None]) for b in ("B0", "B1", "C")}
    got = {x.b: x.people for x in er.distinct_people(spark.createDataFrame(rows, "b string, name string")).collect()}
    assert got == want and got["C"] == 3


def test_communities_keep_the_hub(spark, sf):
    from caselens.plans.graph_queries import QUERIES

    p = spark.read.parquet(f"{sf}/pending_matches.parquet").select(F.col("mention.entity_id").alias("a"), F.col("candidate.entity_id").alias("b"))
    linked = p.where("a <> b").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    got = {r.id for r in QUERIES["gc_louvain"](spark, sf).select("id").collect()}
    assert "PERSON-000000000" in got and got == {r.id for r in linked.collect()}


def test_only_mentions_with_a_candidate_pass_the_probes_or_the_whole(spark, monkeypatch):
    monkeypatch.setattr(er, "PROBES", 1)
    m = spark.createDataFrame([("m1", "ali raza", None), ("m2", "zzz qqq", None), ("m3", "ana", "1"), ("m4", None, None), ("m5", "bo", "2")], "mention_id string, name string, cnic string")
    e = spark.createDataFrame([("e1", "ali raza", ""), ("e2", "xxx qq", "3"), ("e3", "zzz qqq", "9"), ("e4", "ana", "2"), ("m5", "bo", None)], "entity_id string, name string, cnic string")
    got = sorted(r.m_id for r in er.with_candidate(m, e, "name", "cnic").collect())
    assert got == sorted({r.m_id for r in er.candidates(m, e, None, "name", "cnic").collect()})
    assert "m4" not in got and "m5" not in got and "m1" in got


def test_ratios_of_the_bound_and_of_all_pairs_are_those_one_by_one():
    r = random.Random(4)
    names = [" ".join("".join(r.choice("abcdeاب") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 3))) for _ in range(60)] + ["", " ", "aaaaaaaaaaaa", "ab" * 50, "a" * 70]
    for least in (0.05, 0.4, 0.9, 1.0):
        i, j, ratio = er._ratios(names, er._Names(names), least)
        got = {(x, y): s for x, y, s in zip(i.tolist(), j.tolist(), ratio.tolist())}
        want = {(x, y): er.token_sort_ratio(a, b) if a.strip() and b.strip() else er.indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for x, a in enumerate(names) for y, b in enumerate(names) if a and b}
        assert got == {k: s for k, s in want.items() if s >= least}
