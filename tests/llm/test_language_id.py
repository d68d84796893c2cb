from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientela.llm.folds import held_out
from clientela.llm.language_id import fit_languages, identify_languages, language_sets, ngram_counts

SENTENCES = {
    "en": "the quick thinking of the other people was there with this and that thing which they had",
    "de": "der schnelle fuchs und die anderen leute waren nicht hier weil sie schon gegangen sind",
    "fr": "les autres personnes étaient là avec cette chose que nous avons vue dans la rue",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(lang, text) for lang, text in SENTENCES.items() for _ in range(3)]
    rows += [(None, "no label"), ("en", None)]
    return fit_languages(spark.createDataFrame(rows, "lang string, text string"))


def test_counts_are_of_the_whole_corpus(model):
    assert model.names == ("de", "en", "fr")
    places, counts = ngram_counts(SENTENCES["de"].encode())
    expected = np.full(len(model.logs), 0.5)
    expected[places] += 3 * counts
    assert np.allclose(model.logs[:, 0], np.log(expected / expected.sum()), atol=1e-5)


def test_one_language_and_two(model):
    both = SENTENCES["en"] + " " + SENTENCES["fr"]
    share, fits = language_sets([SENTENCES["fr"].encode(), both.encode()], model)
    assert fits.all()
    assert share[0].tolist() == [0, 0, 1]
    assert share[1][0] == 0 and 0.35 < share[1][1] < 0.65 and np.isclose(share[1].sum(), 1, atol=1e-6)


def test_em_finds_the_shares_of_a_mixture(model):
    text = (SENTENCES["de"] + " ") * 3 + SENTENCES["en"]
    share, _ = language_sets([text.encode()], model)
    assert abs(share[0][0] - 0.75) < 0.08 and abs(share[0][1] - 0.25) < 0.08


def test_a_text_does_not_depend_on_its_neighbours(model):
    texts = [t.encode() for t in [*SENTENCES.values(), "", "12", "xyzzy qqq", SENTENCES["en"] + SENTENCES["de"]]]
    together, fits = language_sets(texts, model)
    for i, text in enumerate(texts):
        alone, fit = language_sets([text], model)
        assert np.allclose(alone[0], together[i]) and fit[0] == fits[i]


@pytest.mark.parametrize("frame", ["odd", "clashing", "empty"])
def test_odd_rows(request, model, frame):
    docs = request.getfixturevalue(frame)
    rows = identify_languages(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["score"] == 0) == (r["languages"] == {})


def test_und_and_rejected(make, model):
    docs = make([(1, None), (2, "12 34 !!"), (3, ""), (4, "zxqv wkjp " * 40), (5, SENTENCES["en"]), (6, "the")])
    rows = {r["doc_id"]: r for r in identify_languages(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert [rows[i]["accepted"] for i in range(1, 7)] == [False, False, False, False, True, True]


def test_no_labels(make, spark):
    model = fit_languages(spark.createDataFrame([], "lang string, text string"))
    assert identify_languages(make([(1, "the")]), model).first()["lang_pred"] == "und"


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = identify_languages(docs, fit_languages(docs.where(~held_out())))
    right = found.join(docs.select("doc_id", "lang"), "doc_id").where(held_out())
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99
    assert right.agg(F.avg(F.col("accepted").cast("int"))).first()[0] == 1


@pytest.mark.parametrize("text", ["½ 2", "²", "12 ③ Ⅷ", "٣ _", "!?"])
def test_numbers_are_no_letters(make, model, text):
    row = identify_languages(make([(1, text)]), model).first()
    assert (row["lang_pred"], row["score"], row["accepted"]) == ("und", 0.0, False)


def test_letters_of_every_kind(make, model):
    rows = identify_languages(make(list(enumerate(["ª", "ǅ", "ʰ", "語", "é", "x 1"]))), model).collect()
    assert all(r["lang_pred"] != "und" for r in rows)
