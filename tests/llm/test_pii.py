import pytest

from caselens.llm import pii
from caselens.llm.pii_table import labelled_texts, literal_parts

NAMES = ["Ahmed Turbwal", "Zubair Latif Ghandokar", "Naheed Pindokar", "S. Raza Dravanpur", "Kiran Anjum Orakisht", "Omar Farooq Thundanpur", "کاشف پلووال", "شازیہ جبین چنواکھیل", "Bilal Awrani", "Uzma Fenzwal", "Tariq Nagrungri", "Samina Bibi Kolmekhel"]
HOMES = ["House No. 94, Street 11, Block E, Zaitoon Mohalla, Basti Kundan 93147", "H. No. 85, street no 18, Bostan H/S", "Plot 131, Street 5, Rahat Town, Sangbela", "مکان نمبر 102، گلی نمبر 13، چاندنی بازار"]


@pytest.fixture(scope="module")
def model():
    return pii.train(NAMES, HOMES, texts=1500, epochs=4)


def test_held_out_accuracy(model):
    test = labelled_texts(NAMES, HOMES, 200, seed=77)
    found = pii.find_spans(model, [t for t, _ in test])
    right = sum(len(set(f) & set(s)) for f, (_, s) in zip(found, test))
    assert right / sum(len(s) for _, s in test) > 0.93
    assert right / sum(map(len, found)) > 0.93


def test_marginals_agree_with_viterbi_by_enumeration(model):
    import itertools

    import numpy as np

    tokens, _, _ = pii.tokenize("Guarantor: Ali")
    e = model.scores(tokens)
    best = max(itertools.product(range(pii.N_LABELS), repeat=len(tokens)), key=lambda y: model.start[y[0]] + e[0, y[0]] + sum(model.move[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(y, y[1:]))))
    assert np.array_equal(model.decode([tokens])[0], np.array(best))


def test_spans_placeholders_and_decoys(model):
    text = "Buyer: Uzma Fenzwal, CNIC 97271–6573976–2, mob +92-378-377-6414\nIMEI 351675887068406, blocked"
    spans = pii.find_spans(model, [text])[0]
    assert [k for _, _, k in spans] == ["name", "identity_number", "phone"]
    out = pii.redact(text, spans)
    assert out == "Buyer: [NAME], CNIC [IDENTITY_NUMBER], mob [PHONE]\nIMEI 351675887068406, blocked"


def test_detect_in_spark(spark, model):
    rows = [("1", "Write to ahmed.turbwal@zarqam.example please"), ("1", "Write to ahmed.turbwal@zarqam.example please"), ("2", ""), ("3", None), (None, "x"), ("4", "Between Gulnar Town and Daman Park traffic stopped. " * 3000)]
    df = spark.createDataFrame([(*r, "s", "k") for r in rows], "k string, t string, spans string, row_key string").select("k", "t", "spans", "row_key")
    got = {r.row_key: r for r in pii.detect(df, "k", "t", model).collect()}
    assert set(got) == {"1", "2", "4"}
    assert [(s.kind, s.span_no) for s in got["1"].spans] == [("email", 1)] and got["1"].redacted == "Write to [EMAIL] please"
    assert got["2"].redacted == "" and got["4"].redacted == got["4"].text
    assert pii.detect(df.limit(0), "k", "t", model).count() == 0


def test_table_is_independent_of_the_test_tables(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{d}/cases.parquet").select("description")
    for c in ("user_message", "final_response"):
        texts = texts.unionAll(spark.read.parquet(f"{d}/queries.parquet").select(c))
    corpus = "\n".join(r[0].lower() for r in texts.where(F.col("description").isNotNull()).distinct().collect())
    assert not [p for p in literal_parts() if len(p) >= 15 and p.lower() in corpus]


def test_plain_texts_teach_words_around(model):
    plain = ["Zarfaan khushk Ahmed Turbwal tohi", "Zarfaan khushk Naheed Pindokar tohi", "Zarfaan khushk lorim tohi"] * 10
    adapted = pii.train(NAMES, HOMES, plain=plain, texts=600, epochs=3)
    assert [pii.redact(t, pii.find_spans(adapted, [t])[0]) for t in plain[:3]] == ["Zarfaan khushk [NAME] tohi"] * 2 + ["Zarfaan khushk lorim tohi"]


def test_model_is_stored(spark):
    from caselens.llm.models import model_key, stored

    key = "t-" + model_key([pii], NAMES)
    assert stored(spark, key, lambda: {"a": 1}) == {"a": 1}
    assert stored(spark, key, lambda: 1 / 0) == {"a": 1}
