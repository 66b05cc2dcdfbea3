import random

import pytest

from caselens.llm import pairs

QUESTIONS = {
    "en": ["What documents are needed to get a copy of FIR-2025-THEFT-{n}?", "Where was the black vehicle ABC-D-{n} found?", "How long can a suspect be held at the station?"],
    "ur-latn": ["FIR-2025-THEFT-{n} mein kya kya baramad hua?", "chori ki report darj karwane ka tareeqa kya hai", "ye number 0300-{n}567 kis ka hai batao"],
    "ur": ["گاڑی نمبر ABC-D-{n} کس مقدمہ میں آئی ہے؟", "چوری کی رپورٹ درج کرانے کا طریقہ کیا ہے؟"],
}
ANSWERS = {
    "en": ["An applicant must bring the reference number and a fee of Rs. {n} to the front desk [Document 3].", "The vehicle was found near the canal with the engine number {n} filed off.", "A suspect has to be produced before the magistrate within the time fixed by the procedure code."],
    "ur-latn": ["Adalat ne agli peshi rakhi hai aur tafteesh abhi jari hai [Document 2].", "Darkhwast dene wale ko card ki copy aur Rs. {n} fees ke sath thane jana hoga.", "Baramdagi mein {n} cheezen shamil hain jin par mohar lagai gayi."],
    "ur": ["عدالت نے اگلی پیشی مقرر کی اور تفتیش جاری ہے۔", "برآمدگی میں لیپ ٹاپ اور موبائل فون شامل ہیں جن پر مہر لگائی گئی۔"],
}


def good(r):
    lang = r.choice(list(QUESTIONS))
    n = r.randint(1000, 9999)
    return r.choice(QUESTIONS[lang]).format(n=n), " ".join(r.choice(ANSWERS[lang]).format(n=r.randint(1000, 9999)) for _ in range(r.randint(1, 3)))


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    return pairs.train([good(r) for _ in range(900)], epochs=4)


def test_held_out_accuracy(model):
    import numpy as np

    r = random.Random(99)
    made, y = pairs._synthetic([good(r) for _ in range(300)], np.random.default_rng(8))
    want = [pairs.LABELS[int(row.argmax())] if row.any() else None for row in y]
    got = model.predict([q for q, _ in made], [a for _, a in made])
    assert sum(a == b for a, b in zip(got, want)) / len(want) > 0.93


def test_words():
    assert not any(map(pairs.has_words, [None, "", " ", "​", "N/A", "[]", "<p></p>", "...", "[Document 3]", "—"]))
    assert all(map(pairs.has_words, ["Yes.", "490-A PPC", "5", "نہیں"]))


def test_language():
    assert [pairs.language(x) for x in ("where was it found", "ye number kis ka hai", "مقدمہ کیا ہے", "le dossier est dans la salle", "1234", "")] == ["en", "ur-latn", "ur", "fr", "", ""]


def test_clear_cases(spark, model):
    q = QUESTIONS["en"][0].format(n=1234)
    rows = [(1, q, q), (2, q, None), (3, q, "I'm sorry, but I cannot help you with it."), (4, q, ANSWERS["ur"][0]), (5, q, ANSWERS["en"][0].format(n=5)), (6, q, f"{q}\n\n{ANSWERS['en'][1].format(n=7)}"), (7, q + " Jawab English mein dein.", ANSWERS["en"][2]), (5, q, ANSWERS["en"][0].format(n=5)), (None, q, ""), (8, None, ANSWERS["en"][1].format(n=3)), (9, q, "The vehicle was found near the canal with the")]
    df = spark.createDataFrame([(*r, "d") for r in rows], "id long, q string, a string, defect string")
    got = {r.pair_key: r.defect for r in pairs.defects(df, "id", "q", "a", model).collect()}
    assert got == {1: "copy", 2: "empty", 3: "refusal", 4: "other_language", 9: "truncated"}
    assert pairs.defects(df.limit(0), "id", "q", "a", model).count() == 0
    assert pairs.train([]).predict(["q"], ["an answer"]) == [None]


def test_refusals_are_independent_of_the_test_tables(spark):
    from pyspark.sql import functions as F

    rows = spark.read.parquet("/root/testdata/sf0.01/queries.parquet")
    corpus = "\n".join(r[0].lower() for r in rows.select("user_message").unionAll(rows.select("final_response")).where(F.col("user_message").isNotNull()).distinct().collect())
    assert not [p for p in pairs.literal_parts() if len(p) >= 15 and p.lower() in corpus]


def found_refusals(strange, times):
    import numpy as np

    r = random.Random(5)
    base = [good(r) for _ in range(600)] + [(good(r)[0], x) for x in strange for _ in range(times)]
    found = pairs.likely_refusals(base, np.random.default_rng(1))
    assert found[:600].mean() < 0.02
    return found[600:].mean()


def test_refusals_of_the_sample_are_found_without_labels():
    cores = ["I cannot go into that matter.", "I am not able to say anything on it.", "there is no record of this in my files.", "I must not discuss it with you.", "I do not know the answer to this."]
    assert found_refusals([f"{o}{c}" for o in ("Regrettably, ", "Hm, ", "Well, ", "") for c in cores], 2) > 0.9


@pytest.mark.xfail(reason="a few wordings that recur alone, each with few words of made-up refusals, are learnt as answers", strict=False)
def test_lone_wordings_of_refusals():
    assert found_refusals(["I must say that I cannot go there, my hands are tied.", "Mujhe ijazat nahi ke is mauzu ko chheroon."], 15) > 0.9
