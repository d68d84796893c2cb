"""Quality of documents by attention over their passages.

A document is a bag of passages of 64 words, of which only the whole has a label.
Every passage is encoded by one layer over its statistics; gated attention
weighs the encodings, and the weighted sum gives the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clientela.llm.batches import as_batch, text_chunks, texts_of

WORDS = 64
WIDTH = 16
THRESHOLD = 0.3
# Bounds of the sample that is learned from: documents, and passages of each.
MOST_LABELLED = 20_000
MOST_PASSAGES = 512
EPOCHS = 30
BATCH = 256
RATE = 0.01
DECAY = 1e-4

_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", bytes(range(128, 256)))
_IN_GROUP = np.array([[b in group for b in range(256)] for group in _GROUPS])
_BLANK = np.array([b in b"\t\n\x0b\x0c\r " for b in range(256)])
STATISTICS = len(_GROUPS) + 6

_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.int64())])
_SAMPLE = pa.schema([("quality", pa.int32()), ("passages", pa.binary())])


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of all passages of all texts, and each text's first passage.

    A text without words is one passage of zeros.
    """
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(text) + 1 for text in texts])
    blank = _BLANK[buffer]
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    owner = np.searchsorted(ends, begins, "right")
    words = np.bincount(owner, minlength=len(texts))
    first_word = np.concatenate([[0], np.cumsum(words)[:-1]])
    count = np.maximum(1, -(-words // WORDS))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    table = np.zeros((int(count.sum()), STATISTICS), np.float32)
    if not len(begins):
        return table, first

    passage = first[owner] + (np.arange(len(begins)) - first_word[owner]) // WORDS
    opens = np.flatnonzero(np.diff(passage, prepend=-1))
    rows = passage[opens]
    size = np.diff(np.append(opens, len(begins)))
    # Bytes from a passage's first word up to the next passage's first word.
    start = begins[opens]
    stop = np.minimum(np.append(start[1:], len(buffer)), ends[owner[opens]])
    edges = np.stack([start, stop], axis=1).ravel()
    edges = np.minimum(edges, len(buffer) - 1)
    chars = np.maximum(1, np.add.reduceat(~blank, edges)[::2]).astype(np.float32)
    for i, inside in enumerate(_IN_GROUP):
        table[rows, i] = np.add.reduceat(inside[buffer], edges, dtype=np.int64)[::2] / chars

    hashes = np.fromiter(
        (h for text in texts for h in map(xxhash.xxh3_64_intdigest, text.split())), np.uint64, len(begins)
    )
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    same[opens] = False
    order = np.lexsort((hashes, passage))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    at = len(_GROUPS)
    table[rows, at] = np.log1p(size)
    table[rows, at + 1] = chars / size
    table[rows, at + 2] = np.add.reduceat(same, opens, dtype=np.int64) / size
    table[rows, at + 3] = np.add.reduceat(new, opens, dtype=np.int64) / size
    table[rows, at + 4] = np.log1p(words[owner[opens]])
    table[rows, at + 5] = 1
    return table, first


@dataclass
class AttentionModel:
    """Weights of the encoder, of the two gates, of attention and of the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def encoded(self, table: np.ndarray) -> np.ndarray:
        return np.clip((table - self.mean) / self.scale, -8, 8)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["encoder"] + w["encoder_bias"])
        value, gate = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-h @ w["gate"]))
        logit = (value * gate) @ w["attention"]
        lengths = np.diff(np.append(first, len(x)))
        owner = np.repeat(np.arange(len(first)), lengths)
        raised = np.exp(logit - np.maximum.reduceat(logit, first)[owner])
        weight = raised / np.add.reduceat(raised, first)[owner]
        bag = np.add.reduceat(h * weight[:, None], first)
        score = 1 / (1 + np.exp(-np.clip(bag @ w["score"] + w["score_bias"], -30, 30)))
        return {"x": x, "h": h, "value": value, "gate": gate, "weight": weight, "bag": bag, "score": score, "owner": owner}

    def gradients(self, seen: dict[str, np.ndarray], first: np.ndarray, label: np.ndarray) -> dict:
        """Of the mean cross entropy."""
        w, owner = self.weights, seen["owner"]
        error = (seen["score"] - label) / len(label)
        to_bag = error[:, None] * w["score"]
        to_weight = (seen["h"] * to_bag[owner]).sum(axis=1)
        mean = np.add.reduceat(to_weight * seen["weight"], first)
        to_logit = seen["weight"] * (to_weight - mean[owner])
        to_product = to_logit[:, None] * w["attention"]
        to_value = to_product * seen["gate"] * (1 - seen["value"] ** 2)
        to_gate = to_product * seen["value"] * seen["gate"] * (1 - seen["gate"])
        to_h = seen["weight"][:, None] * to_bag[owner] + to_value @ w["value"].T + to_gate @ w["gate"].T
        to_h *= 1 - seen["h"] ** 2
        return {
            "encoder": seen["x"].T @ to_h, "encoder_bias": to_h.sum(axis=0),
            "value": seen["h"].T @ to_value, "gate": seen["h"].T @ to_gate,
            "attention": (seen["value"] * seen["gate"]).T @ to_logit,
            "score": seen["bag"].T @ error, "score_bias": error.sum(),
        }

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1 and number of passages of each text."""
        table, first = passages(texts)
        return self.forward(self.encoded(table), first)["score"], np.diff(np.append(first, len(table)))


def fit_attention(bags: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> AttentionModel:
    """Adam on the cross entropy, weights decayed. The score of a model without
    bags, or with bags of one label, is their mean label, 0.5 without bags."""
    random = np.random.default_rng(seed)
    together = np.concatenate(bags) if bags else np.zeros((1, STATISTICS), np.float32)
    model = AttentionModel(together.mean(axis=0), np.maximum(together.std(axis=0), 1e-3))
    shapes = {
        "encoder": (STATISTICS, WIDTH), "encoder_bias": (WIDTH,), "value": (WIDTH, WIDTH),
        "gate": (WIDTH, WIDTH), "attention": (WIDTH,), "score": (WIDTH,), "score_bias": (),
    }
    w = model.weights
    for name, shape in shapes.items():
        w[name] = random.normal(0, 1 / np.sqrt(shape[0]), shape) if shape else np.zeros(())
    mean = (labels.sum() + 0.5) / (len(labels) + 1)
    w["encoder_bias"][:], w["score_bias"] = 0, np.log(mean / (1 - mean))
    if len(set(labels.tolist())) < 2:
        w["score"] = np.zeros(WIDTH)
        return model
    bags = [model.encoded(bag) for bag in bags]
    moments = {name: [np.zeros(shape), np.zeros(shape)] for name, shape in shapes.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(bags))
        for chosen in np.array_split(order, max(1, len(order) // BATCH)):
            step += 1
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])[:-1]])
            seen = model.forward(np.concatenate([bags[i] for i in chosen]), first)
            rate = RATE * (1 - epoch / EPOCHS)
            for name, gradient in model.gradients(seen, first, labels[chosen]).items():
                m, v = moments[name]
                m[...] = 0.9 * m + 0.1 * gradient
                v[...] = 0.999 * v + 0.001 * gradient**2
                change = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                w[name] = w[name] - rate * change - rate * DECAY * w[name]
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> AttentionModel:
    """Model from texts and the rows (doc_id, quality) of ``labels``.

    Learns from the ``most`` labelled documents with the smallest hashed ids, of
    which those with more than ``MOST_PASSAGES`` passages are left out. An id with
    several labels counts with the smallest; null labels do not count.
    """
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
    ids = ids.agg(F.min("quality").cast("int").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                table, first = passages(texts_of(part, "text"))
                found = np.split(table, first[1:])
                keep = [len(bag) <= MOST_PASSAGES for bag in found]
                own = [bag.tobytes() for bag, short in zip(found, keep, strict=True) if short]
                yield as_batch(_SAMPLE, [part["quality"].filter(pa.array(keep)), own])

    # ``most`` bounds the broadcast and, with ``MOST_PASSAGES``, what is collected.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "quality")
    rows = sample.mapInArrow(bags, "quality int, passages binary").toPandas()
    found = [np.frombuffer(raw, np.float32).reshape(-1, STATISTICS) for raw in rows["passages"]]
    order = sorted(range(len(found)), key=lambda i: rows["passages"][i])
    labels_ = rows["quality"].to_numpy(float)
    return fit_attention([found[i] for i in order], labels_[order])


def score_quality(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """One row per document: doc_id, score, passages.

    ``score`` is the probability of label 1 from all passages; null and empty
    texts are one empty passage. Columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                yield as_batch(_SCORES, [part["doc_id"], *shared.value.scores(texts_of(part, "text"))])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, passages long")
