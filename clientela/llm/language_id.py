"""Languages of a document as a mixture, estimated from its letter n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from clientela.llm.batches import as_batch, text_chunks, texts_of

PLACES = 1 << 15
UNDETERMINED = "und"
# A language joins a mixture only with at least this share of the n-grams.
LEAST_SHARE = 0.02
STEPS = 8
SMOOTHING = 0.5

# ASCII letters in lower case and all bytes of other characters stay.
_KEPT = np.array([(97 <= b <= 122) or b >= 128 for b in range(256)])
_NGRAMS = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("n", pa.int64())])

LANGUAGES = "doc_id long, lang_pred string, score double, languages map<string, double>, accepted boolean"


def ngram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the 3-byte and 4-byte grams of a text's words.

    Words are runs of letters in lower case with a blank around them; grams are
    hashed to ``PLACES`` places.
    """
    raw = np.frombuffer(b" " + text.decode(errors="replace").lower().encode() + b"  ", np.uint8)
    kept = _KEPT[raw]
    code = np.where(kept, raw, 32).astype(np.uint32)
    middle = kept[1:-2]
    three = (code[:-3] << 16 | code[1:-2] << 8 | code[2:-1])[middle] * np.uint32(2654435761)
    inner = middle & kept[2:-1]
    four = (code[:-3] << 24 | code[1:-2] << 16 | code[2:-1] << 8 | code[3:])[inner] * np.uint32(2246822519)
    grams = np.concatenate([three, four ^ (four >> np.uint32(15))]) >> np.uint32(17)
    counts = np.bincount(grams, minlength=PLACES)
    places = np.flatnonzero(counts)
    return places, counts[places]


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of the places, one column per language."""

    names: tuple[str, ...]
    logs: np.ndarray


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in text_chunks(batch, "text"):
            for lang, text in zip(part["lang"].to_pylist(), texts_of(part, "text"), strict=True):
                places, counts = ngram_counts(text)
                total = totals.setdefault(lang, np.zeros(PLACES, np.int64))
                total[places] += counts
    for lang, total in totals.items():
        places = np.flatnonzero(total)
        yield as_batch(_NGRAMS, [[lang] * len(places), places, total[places]])


def fit_languages(labelled: DataFrame) -> LanguageModel:
    """Counts all n-grams of all rows (text, lang); rows without a lang are ignored.

    Tasks send sums only; the model has ``PLACES`` numbers per language.
    """
    rows = labelled.select("text", "lang").where("lang is not null and text is not null")
    sums = rows.mapInArrow(_counted, "lang string, place int, n long")
    sums = sums.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(sums["lang"]))
    counts = np.full((PLACES, len(names)), SMOOTHING)
    column = np.searchsorted(names, sums["lang"].to_numpy(str)) if names else np.array([], int)
    np.add.at(counts, (sums["place"].to_numpy(int), column), sums["n"].to_numpy())
    logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return LanguageModel(tuple(names), logs)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _mixture(logs, counts, owner, starts, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages and log likelihood of each document, by EM."""
    top = np.where(allowed[owner], logs, -np.inf).max(axis=1, keepdims=True)
    likelihood = np.exp(logs - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    size = _sums(counts, starts)[:, None]
    for step in range(STEPS + 1):
        weighted = likelihood * share[owner]
        total = weighted.sum(axis=1, keepdims=True)
        if step == STEPS:
            return share, _sums(counts * (np.log(total[:, 0]) + top[:, 0]), starts)
        share = _sums(weighted / total * counts[:, None], starts) / size


def language_sets(texts: list[bytes], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each text's languages (0 if not selected), and whether any fits.

    Languages are ordered by their share in the mixture of all. Sets of the first
    one, two and so on are fitted, and a further language has to raise the log
    likelihood by half the logarithm of the number of n-grams. A set fits unless
    places taken at random explain the text better, by the same penalty.
    """
    share = np.zeros((len(texts), len(model.names)))
    fits = np.zeros(len(texts), bool)
    grams = [ngram_counts(text) for text in texts]
    rows = np.array([i for i, (places, _) in enumerate(grams) if len(places)], int)
    if not len(rows) or not model.names:
        return share, fits
    lengths = np.array([len(grams[i][0]) for i in rows])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(rows)), lengths)
    logs = model.logs[np.concatenate([grams[i][0] for i in rows])]
    counts = np.concatenate([grams[i][1] for i in rows]).astype(np.float32)
    size = _sums(counts, starts)
    penalty = np.log(np.maximum(size, 2)) / 2

    everything = np.ones((len(rows), len(model.names)), bool)
    full, _ = _mixture(logs, counts, owner, starts, everything)
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    alone = _sums(logs * counts[:, None], starts)
    best = np.where(place == 0, 1.0, 0.0)
    score = (alone * best).sum(axis=1) - penalty
    going = np.arange(len(rows))
    for size_of_set in range(2, len(model.names) + 1):
        going = going[full[going, order[going, size_of_set - 1]] >= LEAST_SHARE]
        if not len(going):
            break
        mine = np.isin(owner, going)
        number = np.full(len(rows), -1)
        number[going] = np.arange(len(going))
        begin = np.concatenate([[0], np.cumsum(lengths[going])[:-1]])
        shares, likelihood = _mixture(
            logs[mine], counts[mine], number[owner[mine]], begin, place[going] < size_of_set
        )
        value = likelihood - size_of_set * penalty[going]
        better = value > score[going]
        best[going[better]], score[going[better]] = shares[better], value[better]
        going = going[better]
    share[rows] = best
    fits[rows] = score > -size * np.log(PLACES) - 2 * penalty
    return share, fits


def _has_letter(text: bytes) -> bool:
    """Whether a character is of the Unicode category L; fractions and powers are numbers."""
    return any(map(str.isalpha, text.decode(errors="replace")))


def accepts(model: LanguageModel) -> Callable[[Column], Column]:
    """Function from a text column to whether its documents are accepted."""

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        found = np.zeros(len(texts), bool)
        raw = [(text or "").encode() for text in texts]
        for start in range(0, len(raw), 64):
            part = raw[start : start + 64]
            letters = np.array([_has_letter(text) for text in part])
            found[start : start + 64] = language_sets(part, model)[1] & letters
        return pd.Series(found)

    return accepted


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, languages, accepted.

    ``languages`` are the selected languages and their shares, ``lang_pred`` the
    largest and ``score`` its share. Ties go to the first name. Null texts and texts without a
    letter, or any text if the model knows no language, are ``und`` with score 0.
    Rejected are those, and texts whose letters are no known language. Columns
    other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
            ("languages", pa.map_(pa.string(), pa.float64())), ("accepted", pa.bool_()),
        ]
    )

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in text_chunks(batch, "text"):
                texts = texts_of(part, "text")
                share, fits = language_sets(texts, model)
                rows = []
                for text, own, accepted in zip(texts, share, fits.tolist(), strict=True):
                    chosen = [(model.names[i], float(own[i])) for i in np.flatnonzero(own)]
                    if chosen and _has_letter(text):
                        name, part_of_it = max(chosen, key=lambda x: x[1])
                        rows.append((name, min(part_of_it, 1.0), chosen, accepted))
                    else:
                        rows.append((UNDETERMINED, 0.0, [], False))
                yield as_batch(schema, [part["doc_id"], *zip(*rows, strict=True)])

    return docs.select("doc_id", "text").mapInArrow(identify, LANGUAGES)
