import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwright.llm.langid import Model, Scorer, detect, fit, label_code, normal_word, segments

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


@pytest.fixture(scope="module")
def samples():
    import pandas as pd

    return pd.read_parquet(SAMPLES)


@pytest.fixture(scope="module")
def model(samples):
    return Model.fit(samples.text.tolist(), samples.lang.tolist())


def test_held_out_accuracy(samples):
    right = 0
    for fold in range(4):
        test = np.arange(len(samples)) % 4 == fold
        train = samples[~test]
        rows = Scorer(Model.fit(train.text.tolist(), train.lang.tolist())).label(samples[test].text.tolist())
        right += sum(r[0] == y for r, y in zip(rows, samples[test].lang))
    assert right / len(samples) >= 0.97


def test_words_and_segments():
    assert [normal_word(w) for w in ("Stones,", "12.5", "875/3A2", "m2_451.dxf", "0x40f8", "¿Quién", "wer­e", "---", "కొలత.")] == ["stones", "", "", "", "", "quién", "were", "", "కొలత"]
    text = "One sentence. Two 3.5 here!\n# Head\n\nLast"
    assert [text[a:b].strip() for a, b in segments(text)] == ["One sentence.", "Two 3.5 here!", "# Head", "Last"]
    assert segments("") == []


def test_mixed_documents_and_names(model, samples):
    hindi, english, tamil = (samples[samples.lang == x].text.iloc[0] for x in ("hi", "en", "ta"))
    rows = Scorer(model).label([f"{english} {english} {hindi}", f"{english} [வடமிபள்ளம்]", None, "", "  \n", "|59|76|\n[13:39:52] m1_201.dxf 0xcec6e603\n12,5 13,0", tamil])
    assert [r[2] for r in rows] == [["en", "hi"], ["en"], [], [], [], [], ["ta"]]
    assert rows[0][0] == "en" and {s[2] for s in rows[0][3]} == {"en", "hi"}
    assert all(0 < s[3] <= 1 for r in rows for s in r[3]) and rows[2][:2] == (None, None)


def test_operator(spark, samples):
    fitted = fit(spark.createDataFrame(samples))
    english, german = samples[samples.lang == "en"].text.iloc[1], samples[samples.lang == "de"].text.iloc[1]
    rows = [(1, english, "EN-in", "x"), (1, english, "EN-in", "x"), (2, german, "en", None), (3, None, None, None), (4, "", "", None), (None, german, "de", None), (5, (english + "\n") * 3000 + german, "en", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, segments string")
    got = detect(frame.select("*", label_code(frame.lang).alias("label")), fitted, keep="label").collect()
    assert sorted((r.doc_id or 0, r.label, tuple(r.languages)) for r in got) == sorted([(1, "en", ("en",)), (1, "en", ("en",)), (2, "en", ("de",)), (3, "", ()), (4, "", ()), (0, "de", ("de",)), (5, "en", ("de", "en"))])
    long = next(r for r in got if r.doc_id == 5)
    assert long.lang == "en" and long.confidence > 0.95 and len(long.segments) >= 3001
    assert detect(frame.limit(0), fitted).collect() == []


def test_label_code(spark):
    labels = [" en", "EN_in", "en-IN", "English", None, "??", "", "ta -x"]
    rows = spark.createDataFrame([(x,) for x in labels], "lang string").select(label_code(F.col("lang")).alias("c")).collect()
    assert [r.c for r in rows] == ["en", "en", "en", "english", "", "??", "", "ta"]
