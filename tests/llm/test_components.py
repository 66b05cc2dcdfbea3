import random

from pyspark.sql import functions as F

from caselens.llm.components import connected_components

SCHEMA = "src string, dst string, id int, group_id string, k string, x string, m string"


def brute(links):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        for v in (a, b):
            if v is not None:
                find(v)
        if a is not None and b is not None:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    return {v: find(v) for v in parent}


def run(spark, links, **kw):
    rows = [(a, b, 1, "g", "k", "x", "m") for a, b in links]
    got = connected_components(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert len(got) == len({r.id for r in got})
    return {r.id: r.group_id for r in got}


def test_chain_repeats_nulls_and_loops(spark):
    links = [("b", "a"), ("b", "c"), ("c", "b"), ("d", "d"), (None, "e"), ("f", None), (None, None), ("b", "a"), ("z", "y")]
    assert run(spark, links) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "z": "y", "y": "y"}


def test_empty(spark):
    assert run(spark, []) == {}


def test_long_path_star_and_random(spark):
    r = random.Random(3)
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    star = [(f"s{i}", "hub") for i in range(80)]
    rest = [(f"n{r.randint(0, 150)}", f"n{r.randint(0, 150)}") for _ in range(120)]
    links = path + star + rest
    r.shuffle(links)
    assert run(spark, links) == brute(links)


def test_hot_vertices_take_the_broadcast_path(spark, monkeypatch):
    import caselens.llm.components as c

    links = [(f"v{i:05}", "a-hub") for i in range(300)] + [(f"v{i:05}", f"w{i:05}") for i in range(300)]
    df = spark.createDataFrame(links, "src string, dst string")
    pairs = df.select(F.col("dst").alias("k"), F.col("src").alias("x"))
    mins = pairs.groupBy("k").agg(F.min("x").alias("m"), F.count(F.lit(1)).alias("deg"))
    monkeypatch.setattr(c, "max", lambda a, b: 50, raising=False)
    split = c._with_min(pairs, mins, 600, 10)
    assert "Broadcast" in split._jdf.queryExecution().toString()
    assert sorted(map(tuple, split.select("k", "x", "m").collect())) == sorted(map(tuple, pairs.join(mins.select("k", "m"), "k").select("k", "x", "m").collect()))


def test_integers(spark):
    df = spark.createDataFrame([(3, 2), (2, 9), (5, 5)], "src long, dst long")
    assert {r.id: r.group_id for r in connected_components(df).collect()} == {2: 2, 3: 2, 9: 2, 5: 5}
