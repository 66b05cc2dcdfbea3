import random

import numpy as np
import pytest

from caselens.llm.packing import fill, pack, vector_best_fit


def test_every_item_once_and_within_all_capacities(spark):
    r = random.Random(1)
    rows = [(i, r.choice([0, 1, 5, 60, 100, 101, 250, 1000, 3205])) for i in range(500)] + [(1000, None), (None, 7), (7, 60), (7, 60)]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, tokens long, container_id string, piece_no int")
    out = pack(df, {1: 100, 2: 1000}, max_items=20, group_items=100).toPandas()
    for w, cap in ((1, 100), (2, 1000)):
        x = out[out.window_id == w]
        assert sorted(x[x.piece_no == 1].doc_id.fillna(-1).tolist()) == sorted(-1 if d is None else d for d, _ in rows)
        assert x.tokens.sum() == sum(t or 0 for _, t in rows)
        per = x.groupby("container_id").agg(t=("tokens", "sum"), n=("tokens", "size"))
        assert per.t.max() <= cap and per.n.max() <= 20
        for d, t in rows[:500]:
            mine = x[x.doc_id == d].sort_values("piece_no") if d != 7 else None
            if mine is not None:
                assert len(mine) == max(1, -(-t // cap)) and (mine.token_start.tolist() == [k * cap for k in range(len(mine))])


def test_attention_cost_limits(spark):
    sizes = np.array([50] * 10)
    where = vector_best_fit(sizes, 500, 100, 2 * 50**2)
    assert np.bincount(where).max() == 2
    where = vector_best_fit(sizes, 500, 3, 1e9)
    assert np.bincount(where).max() == 3


def test_fill_is_near_full(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, int(r.expovariate(1 / 300)) + 20) for i in range(3000)], "doc_id long, tokens long")
    caps = {1: 512, 2: 2048, 3: 8192}
    assert min(x.fill for x in fill(pack(df, caps), caps).collect()) > 0.99


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert pack(df, {1: 10}).count() == 0
    with pytest.raises(ValueError):
        pack(df, {})
