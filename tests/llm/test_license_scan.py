"""Licences in texts against looking for every template at every word."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from clientela.llm import license_scan as scan
from clientela.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def literal_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def literal_base(text):
    """(start, label) of every place of a base phrase."""
    words = literal_words(text)
    return sorted(
        (i, label) for phrase, label in BASE.items() for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.split()
    )


def literal_places(text, index):
    """Places by the definition: every template and every place where it could begin."""
    words = [w.encode() for w in literal_words(text)]
    found = set()
    for entry in index.templates:
        t, size = entry.template, len(entry.words)
        if t.is_phrase:
            for i in range(len(words)):
                if words[i:i + size] == entry.words:
                    found.add((t.label, i, size, 1.0, t.base))
            continue
        rarest = sorted((w for w in set(entry.words) if w in set(words)), key=lambda w: (-index.idf[w], w))
        if index.weight(rarest) < scan.LEAST_SHARE * entry.weight:
            continue
        rarest = rarest[: scan.LOOKED_UP]
        begins = sorted(
            (i - q, w) for i, w in enumerate(words) for q, x in enumerate(entry.words) if x == w and w in rarest
        )
        groups = []
        for begin, w in begins:
            if groups and begin - groups[-1][-1][0] <= scan.DRIFT:
                groups[-1].append((begin, w))
            else:
                groups.append([(begin, w)])
        for group in groups:
            if 2 * len({w for _, w in group}) < len(rarest):
                continue
            around = words[max(0, group[0][0] - scan.DRIFT):group[-1][0] + size + scan.DRIFT]
            text_around = b" " + b" ".join(around) + b" "
            if not all(b" " + b" ".join(m) + b" " in text_around for m in entry.mandatory):
                continue
            share = index.weight(set(entry.words) & set(around)) / entry.weight
            if share >= scan.LEAST_SHARE:
                start = max(0, group[0][0])
                end = min(len(words), group[-1][0] + size)
                found.add((t.label, start, end - start, min(1.0, share), t.base))
    return sorted(found, key=lambda p: (p[1], p[0], p[2]))


def _filler(rng, n):
    return " ".join(rng.choice(["the", "of", "software", "license", "mit", "cc", "by", "and", "lorem", "ipsum", "in", "any", "gnu"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    texts = [None, "", " \n", "MIT License", "mit-license", "mit\x00license", "cc by cc by by cc", "GNU General Public\nLicense!",
             "the apache licenses", "éMIT license", "x" * 50_000]
    for t in (*scan.PHRASES, *scan.TEMPLATES):
        whole = t.text.split()
        bent = [w for w in whole if rng.random() > 0.15]
        cut = whole[: max(2, len(whole) // 3)]
        for words in (whole, bent, cut, whole[:6] + ["inserted"] * 5 + whole[6:], whole * 2):
            texts.append(f"{_filler(rng, 30)} {' '.join(words).title()} {_filler(rng, 30)}")
    texts += [_filler(rng, 400) for _ in range(10)]
    return texts


def test_places_against_every_place(texts):
    df = Counter(w.encode() for t in texts for w in set(literal_words(t)))
    index = scan.build_index(df, len(texts))
    found = set()
    for text in texts:
        places = scan.find_licenses(scan.words_of((text or "").encode()), index)
        assert [tuple(vars(p).values()) for p in places] == literal_places(text, index)
        found |= {p.label for p in places}
    assert {t.label for t in (*scan.PHRASES, *scan.TEMPLATES)} == found


def test_whole_and_bent_wordings_are_found_and_prose_is_not(texts):
    rng = random.Random(9)
    index = scan.build_index({}, 10)
    for t in scan.TEMPLATES:
        words = t.text.split()
        mandatory = {w for m in t.mandatory for w in m.split()}
        bent = [w for w in words if w in mandatory or rng.random() > 0.1]
        for body in (words, bent):
            text = f"{_filler(rng, 200)} {' '.join(body)} {_filler(rng, 50)}"
            assert t.label in {p.label for p in scan.find_licenses(scan.words_of(text.encode()), index)}
    for _ in range(50):
        text = _filler(rng, 300)
        assert {p.label for p in scan.find_licenses(scan.words_of(text.encode()), index)} <= set(BASE.values())


def test_words():
    for text in ("Ünï CODE a1b2", "a\x7fb\x80c", "x—y, Z9_k\n\t(q)", "ＡＢ İi"):
        assert [w.decode() for w in scan.words_of(text.encode())] == literal_words(text)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_license_scan"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = literal_base(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (len(literal_words(texts[r["doc_id"]])), len(base))
        starts = [i for i, _ in base]
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert any(r["labels"] != r["base_labels"] for r in rows)


def test_weights_come_from_all_documents(spark, make):
    docs = make([(i, "mit license" if i == 7 else "license software") for i in range(40)] + [(None, None)]).repartition(6)
    index = scan.learn_index(docs)
    assert index.idf[b"mit"] > index.idf[b"software"] > 0
    same = scan.build_index({b"mit": 1, b"license": 40, b"software": 39}, 41)
    assert index.idf == same.idf


def test_odd_rows(spark, odd, clashing, empty):
    index = scan.learn_index(odd)
    found = sorted(map(str, scan.scan_licenses(odd, index).collect()))
    more = clashing.withColumn("places", clashing["doc_id"]).withColumn("n_words", clashing["doc_id"])
    assert sorted(map(str, scan.scan_licenses(more, index).collect())) == found and len(found) == odd.count()
    assert scan.scan_licenses(empty, scan.learn_index(empty)).count() == 0
