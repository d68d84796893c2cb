"""Both judges of quality: attention over passages, and learned rules."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientela.llm import quality_mil
from clientela.llm.folds import held_out
from clientela.llm.quality_mil import AttentionModel, fit_attention, learn_quality, passages, score_quality
from clientela.llm.quality_rules import Condition, Rule, apply_rules, base_failed, learn_rules, text_statistics


def literal_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    "a b c a b c a b c", "x " * 200, "one\ntwo\n\none\n \n \ntwo\r\ntwo\r", "#*$ %&| <> ñ😀 é", "a b a b a",
    "the end the end the", "\x0b\x0c a\tb", "\n" * 50, "w " + "q q q " * 3,
]


def test_statistics_equal_plain_python(make):
    generator = random.Random(1)
    rows = TEXTS + [" ".join(generator.choices("abcd", k=generator.randrange(40))) for _ in range(200)]
    rows += ["\n".join(generator.choices(["ab", "c d", " ", ""], k=12)) for _ in range(60)]
    docs = make(list(enumerate(rows)))
    for r in text_statistics(docs).collect():
        assert tuple(r)[1:6] == literal_statistics(rows[r["doc_id"]])


@pytest.mark.parametrize("frame", ["odd", "clashing", "empty"])
def test_statistics_of_odd_rows(request, frame):
    docs = request.getfixturevalue(frame)
    want = sorted(((r["doc_id"], *literal_statistics(r["text"])) for r in docs.collect()), key=str)
    rows = apply_rules(text_statistics(docs), []).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=str) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"]) and r["rule"] is None


def statistics_frame(spark, rows):
    names = "n_words mean_word symbol_share upper_share mark_share dup_line_share repeat_share".split()
    ddl = "doc_id long, bad boolean, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, ddl)


def test_rules_find_conjunctions_in_order(spark):
    generator = random.Random(5)
    rows = []
    for i in range(4000):
        x, y, z = generator.random(), generator.random(), generator.random()
        bad = (x > 0.7 and y <= 0.4) or z > 0.9
        if generator.random() < 0.01:
            bad = not bad
        rows.append((i, bad, x, y, z, generator.random(), 0.0, 1.0, generator.random()))
    frame = statistics_frame(spark, [*rows, (9000, None, *[0.5] * 7)])
    rules = learn_rules(frame)
    assert 2 <= len(rules) <= 5
    holds = F.lit(False)
    for rule in rules:
        holds = holds | rule.holds()
    wrong = frame.where("bad is not null").where(holds != F.col("bad")).count()
    assert wrong / len(rows) < 0.05


def test_no_rules_from_labels_of_one_kind_or_noise(spark):
    generator = random.Random(6)
    noise = [(i, generator.random() < 0.2, *(generator.random() for _ in range(7))) for i in range(1500)]
    assert learn_rules(statistics_frame(spark, noise)) == []
    assert learn_rules(statistics_frame(spark, [(i, True, *r[1:]) for i, *r in noise])) == []
    assert learn_rules(statistics_frame(spark, []).where("false")) == []


def test_rules_separate_rare_documents_in_a_long_tail(spark):
    """1 % poor documents between the good ones and a few good ones far beyond."""
    generator = random.Random(7)
    rows = []
    for i in range(6000):
        bad = i % 100 == 0
        x = generator.uniform(0.03, 0.5) if bad else generator.uniform(0, 0.01)
        rows.append((i, bad, 100.0, 5.0, x if bad or i % 1500 != 1 else 20.0 + i, 0.0, 0.0, 0.0, 0.0))
    frame = statistics_frame(spark, rows)
    holds = F.lit(False)
    for rule in learn_rules(frame):
        holds = holds | rule.holds()
    counts = frame.agg(F.count_if(holds & F.col("bad")), F.count_if(holds & ~F.col("bad"))).first()
    assert counts[0] >= 59 and counts[1] <= 6


def test_first_rule_that_holds_is_named(make):
    text = "word #a " * 30 + "$ more words to read in here " * 20
    rules = [Rule((Condition("symbol_share", True, 0.9),)), Rule((Condition("symbol_share", True, 0.0), Condition("n_words", True, 10.0)))]
    generator = random.Random(1)
    words = " ".join(str(generator.random()) for _ in range(60))
    rows = {r["doc_id"]: r for r in apply_rules(text_statistics(make([(1, words + " #"), (2, words), (3, text)])), rules).collect()}
    assert (rows[1]["kept"], rows[1]["rule"]) == (False, "symbol_share > 0 and n_words > 10")
    assert (rows[2]["kept"], rows[2]["rule"]) == (True, None)
    assert (rows[3]["base_failed"], rows[3]["kept"], rows[3]["rule"]) == (True, False, None)


def test_rules_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("bad", F.col("quality") == 0)
    found = text_statistics(docs).join(labels.select("doc_id", "bad"), "doc_id").where(~base_failed()).cache()
    judged = apply_rules(found, learn_rules(found.where(~held_out()))).where(held_out())
    counts = {(r["bad"], r["kept"]): r["count"] for r in judged.groupBy("bad", "kept").count().collect()}
    assert counts[True, False] >= 0.95 * (counts[True, False] + counts.get((True, True), 0))
    assert counts[False, True] >= 0.99 * (counts[False, True] + counts.get((False, False), 0))


def literal_passages(text):
    words = text.split()
    return [words[i : i + 64] for i in range(0, max(1, len(words)), 64)]


def test_passages_cover_whole_texts():
    texts = [b"", b"one", b" a  b\n" * 100, b"x" * 5000, "É é!! #1 ".encode() * 64, b"same same same other"]
    table, first = passages(texts)
    assert first.tolist() == np.cumsum([0, *(len(literal_passages(t)) for t in texts)])[:-1].tolist()
    for text, start in zip(texts, first):
        for n, words in enumerate(literal_passages(text)):
            row = table[start + n]
            if not words:
                assert not row.any()
                continue
            size = max(1, sum(map(len, words)))
            joined = b"".join(words)
            assert np.isclose(row[3], sum(b in b"#*$%&|<>" for b in joined) / size)
            assert np.isclose(row[8], np.log1p(len(words)))
            assert np.isclose(row[9], size / len(words))
            assert np.isclose(row[10], sum(a == b for a, b in zip(words, words[1:])) / len(words))
            assert np.isclose(row[11], len(set(words)) / len(words))


def test_gradients_equal_differences():
    generator = np.random.default_rng(2)
    model = fit_attention([generator.normal(size=(n, quality_mil.STATISTICS)) for n in (1, 3)], np.array([1.0, 1.0]))
    for name, value in model.weights.items():
        model.weights[name] = generator.normal(size=value.shape) * 0.5
    x = generator.normal(size=(11, quality_mil.STATISTICS))
    first, label = np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        score = model.forward(x, first)["score"]
        return -np.mean(label * np.log(score) + (1 - label) * np.log(1 - score))

    gradients = model.gradients(model.forward(x, first), first, label)
    for name, value in model.weights.items():
        flat = np.asarray(value, float).reshape(-1)
        at = generator.integers(0, len(flat))
        moved = []
        for change in (1e-5, -1e-5):
            copy = flat.copy()
            copy[at] += change
            model.weights[name] = copy.reshape(np.shape(value))
            moved.append(loss())
        model.weights[name] = value
        assert np.isclose((moved[0] - moved[1]) / 2e-5, np.asarray(gradients[name]).reshape(-1)[at], atol=1e-6)


def test_attention_finds_the_passage_that_matters():
    generator = np.random.default_rng(3)
    bags, labels = [], []
    for i in range(1500):
        bag = generator.normal(size=(generator.integers(1, 12), quality_mil.STATISTICS))
        if i % 3 == 0:
            bag[generator.integers(len(bag)), 3] += 6
        bags.append(bag)
        labels.append(float(i % 3 != 0))
    model = fit_attention(bags[:1000], np.array(labels[:1000]))
    together = [model.encoded(b) for b in bags[1000:]]
    first = np.concatenate([[0], np.cumsum([len(b) for b in together])[:-1]])
    seen = model.forward(np.concatenate(together), first)
    assert np.mean((seen["score"] > 0.5) == np.array(labels[1000:])) > 0.93
    assert np.allclose(np.add.reduceat(seen["weight"], first), 1)


@pytest.mark.parametrize("frame", ["odd", "clashing", "empty"])
def test_scores_of_odd_rows(request, spark, frame):
    docs = request.getfixturevalue(frame)
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (None, 0), (8, None), (99, 1)], "doc_id long, quality int")
    model = learn_quality(docs, labels)
    rows = score_quality(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["passages"] > 0 for r in rows)


def test_labels_of_one_kind_or_none():
    one = fit_attention([np.zeros((2, quality_mil.STATISTICS))] * 9, np.ones(9))
    assert one.scores([b"", b"some words"])[0].tolist() == pytest.approx([0.95, 0.95])
    assert fit_attention([], np.array([])).scores([b"x"])[0].tolist() == [0.5]
    assert isinstance(one, AttentionModel)


def test_scores_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = learn_quality(docs, labels.where(~held_out()))
    rows = score_quality(docs, model).join(labels, "doc_id").where(held_out()).select("score", "quality").toPandas()
    good = rows["quality"] == 1
    rank = rows["score"].rank()
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98
    assert ((rows["score"] >= 0.3) == good).mean() > 0.97
