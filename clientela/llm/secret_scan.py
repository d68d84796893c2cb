"""Secrets in texts: candidates by form, false positives sorted out by a forest.

A candidate is a run of at least 16 characters of credentials with a digit in
it. Most are numbers, names or addresses. A random forest learned from labelled
findings decides by length, transitions of characters, coverage by words of a
dictionary, paths and the words around.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from clientela.llm.batches import as_batch, text_chunks, texts_of
from clientela.sources.scratch import stored

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(rb"[a-z\xc3\x80-\xbf]{3,}")
_RUN = re.compile(r"[a-z]{3,}")
_BEFORE = re.compile(r"([A-Za-z_-]+)[\"']?\s*(=|:|=>)?\s*[\"']?$")
CREDENTIALS = frozenset(
    "token secret key apikey api_key api-key password passwd pwd auth credential credentials bearer".split()
)
FEATURES = (
    "length", "digit_share", "upper_share", "hex_share", "class_changes", "transition_log", "entropy",
    "dictionary_share", "path", "quoted", "assigned", "credential_before", "word_before", "word_after",
)

# Places of the table of word counts, and the share of all words from which a
# place counts as a dictionary word.
PLACES = 1 << 18
FREQUENT = 2e-6
MOST_FINDINGS = 20_000
TREES, DEPTH = 20, 6
THRESHOLD = 0.5

_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()),
        ("before", pa.string()), ("after", pa.string()), ("features", pa.list_(pa.float64())),
    ]
)


@dataclass(frozen=True)
class TextModel:
    """Frequent words, as a table of their places, and logs of byte transitions."""

    words: bytes
    transitions: np.ndarray

    def knows(self, word: str) -> bool:
        place = xxhash.xxh3_64_intdigest(word) % PLACES
        return bool(self.words[place >> 3] & (128 >> (place & 7)))


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = np.zeros(PLACES, np.int64)
    pairs = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for part in text_chunks(batch, "text"):
            whole = b"\n".join(texts_of(part, "text")).lower()
            raw = np.frombuffer(whole, np.uint8).astype(np.int32)
            pairs += np.bincount(raw[:-1] << 8 | raw[1:], minlength=1 << 16)
            for word, n in Counter(_WORD.findall(whole)).items():
                words[xxhash.xxh3_64_intdigest(word) % PLACES] += n
    for kind, table in enumerate((words, pairs)):
        places = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict(
            {"kind": pa.array([kind] * len(places), pa.int32()), "place": pa.array(places, pa.int32()), "n": table[places]}
        )


def learn_text(docs: DataFrame) -> TextModel:
    """Word frequencies and byte transitions of the whole corpus, in tables of
    fixed size; tasks send sums."""
    sums = docs.select("text").mapInArrow(_tallies, "kind int, place int, n long")
    sums = sums.groupBy("kind", "place").agg(F.sum("n").alias("n")).toPandas()
    words, pairs = np.zeros(PLACES, np.int64), np.ones(1 << 16, np.float64)
    own = sums["kind"] == 0
    words[sums["place"][own]] = sums["n"][own]
    pairs[sums["place"][~own]] += sums["n"][~own]
    pairs = pairs.reshape(256, 256)
    logs = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    frequent = (words > 0) & (words >= FREQUENT * words.sum())
    return TextModel(np.packbits(frequent).tobytes(), logs.astype(np.float32))


def _class(char: str) -> int:
    return 0 if char.isdigit() else 1 if char.islower() else 2 if char.isupper() else 3


def features_of(value: str, before: str, after: str, model: TextModel) -> list[float]:
    """The numbers of ``FEATURES`` for a candidate between two bits of text."""
    size = len(value)
    raw = np.frombuffer(value.lower().encode(), np.uint8)
    classes = [_class(c) for c in value]
    named = _BEFORE.search(before)
    covered = sum(len(run) for run in _RUN.findall(value.lower()) if model.knows(run))
    return [
        float(size),
        sum(c.isdigit() for c in value) / size,
        sum(c.isupper() for c in value) / size,
        sum(c in "0123456789abcdefABCDEF" for c in value) / size,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / size,
        float(model.transitions[raw[:-1], raw[1:]].mean()),
        -sum(n / size * log(n / size) for n in Counter(value).values()),
        covered / size,
        float(before.endswith(("/", "\\", "@", ".")) or after.startswith(("/", "\\", "@", ".")) or value.count("/") > 1),
        float(before.endswith(("\"", "'")) and after.startswith(("\"", "'"))),
        float(bool(named and named[2])),
        float(bool(named and named[1].lower().strip("_-") in CREDENTIALS)),
        float(bool(named and model.knows(named[1].lower()))),
        float(any(model.knows(run) for run in _RUN.findall(after.lower())[:1])),
    ]


def candidates(docs: DataFrame, model: TextModel) -> DataFrame:
    """One row per candidate: doc_id, start and end in code points, the value,
    the text around it on its line, and its features. Null texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                rows = []
                for doc_id, raw in zip(part["doc_id"].to_pylist(), texts_of(part, "text"), strict=True):
                    text = raw.decode(errors="replace")
                    for match in CANDIDATE.finditer(text):
                        value = match[0]
                        if not _DIGIT.search(value):
                            continue
                        start, end = match.span()
                        before = text[max(0, start - 40) : start].rpartition("\n")[2]
                        after = text[end : end + 40].partition("\n")[0]
                        features = features_of(value, before, after, shared.value)
                        rows.append((doc_id, start, end, value, before, after, features))
                if rows:
                    yield as_batch(_FOUND, zip(*rows, strict=True))

    return docs.select("doc_id", "text").mapInArrow(
        find,
        "doc_id long, start long, end long, value string, before string, after string, features array<double>",
    )


def learn_forest(labelled: DataFrame, most: int = MOST_FINDINGS) -> RandomForestClassificationModel | None:
    """Forest from rows of candidates with a boolean ``secret``; nulls are ignored.

    Learns from the ``most`` rows with the smallest hashes. None if the rows do
    not have both labels: there is then nothing to tell apart.
    """
    rows = labelled.where("secret is not null").orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(most)
    rows = rows.select(F.col("secret").cast("double").alias("label"), array_to_vector("features").alias("vector"))
    rows = stored(rows)
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7
    )
    return forest.fit(rows)


def judged(found: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """``found`` with the probability ``score`` and the verdict ``is_secret``.

    Without a forest every candidate is taken for a secret, with score 1.
    """
    if forest is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        scored = forest.transform(found.withColumn("vector", array_to_vector("features")))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
        scored = scored.drop("vector", "rawPrediction", "probability", "prediction")
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD)


def findings_by_syntax(found: DataFrame) -> DataFrame:
    """Candidates with the label ``secret`` that a strict reading of code gives.

    A quoted value of letters and digits that is assigned to the name of a
    credential is one; any other candidate is not.
    """
    names = "|".join(sorted(CREDENTIALS))
    assigned = F.col("before").rlike(rf"(?i)(^|[^a-z])({names})[\"']?\s*(=|:|=>)\s*[\"']$")
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return found.withColumn("secret", assigned & mixed & F.col("after").rlike("^[\"']"))
