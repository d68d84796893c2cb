"""Removal of personal data, and of terms that give it away.

Addresses, cards and phone numbers are found by their form. What stands near one
of them again and again, and hardly anywhere else in the corpus, tells who is
meant even when the value is gone: such terms are generalised or removed. How
strongly a term reveals a value is measured in bits, log2 P(value | term) /
P(value), from counts over the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clientela.llm.batches import as_batch, bound, free_name, text_chunks, texts_of
from clientela.sources.scratch import stored

KINDS = ("email", "ip", "card", "phone")
GENERALISED, REMOVED = "generalised", "removed"
# Terms on each side of a value that are counted as near it.
NEAR = 5
# A term reveals a value if so many different surroundings say so, if at least
# this share of its occurrences is near the value, and by so many bits.
LEAST_EVIDENCE = 2
LEAST_SHARE = 0.5
GENERALISE_BITS = 8.0
REMOVE_BITS = 12.0
# Places of the bit table that preselects words; bounds what tasks are sent.
PLACES = 1 << 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A run of digits that fails from its first digit on fails from any other.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_hash", pa.int64()),
        *((f"n_{kind}", pa.int64()) for kind in KINDS),
        ("base", pa.string()),
        ("near", pa.list_(pa.struct([("value", pa.int64()), ("around", pa.int64()), ("terms", pa.list_(pa.string()))]))),
    ]
)
_FOUND_DDL = (
    "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base string,"
    " near array<struct<value: long, around: long, terms: array<string>>>"
)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def personal_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end in code points of all personal data, by kind and start."""
    spans = [("email", *span) for span in _emails(text)]
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match[0].split(".")):
            spans.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in match[0]) <= 15:
                spans.append(("phone", *match.span()))
    return spans


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _signed(value: bytes | str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def _near(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Of each value: its hash, the hash of its surroundings, and the terms there."""
    places = sorted((start, end) for _, start, end in spans)
    opens = np.array([start for start, _ in places])
    ends = np.maximum.accumulate([end for _, end in places])

    def apart(start: int, end: int) -> bool:
        before = np.searchsorted(opens, end)
        return before == 0 or ends[before - 1] <= start

    terms = [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text)]
    starts = np.array([start for start, _, _ in terms])
    found = []
    for kind, start, end in spans:
        here, after = np.searchsorted(starts, (start, end))
        around = terms[max(0, here - NEAR) : here] + terms[after : after + NEAR]
        words = [word for a, b, word in around if apart(a, b)]
        value = re.sub(r"[ ().-]", "", text[start:end]).lower() if kind != "ip" else text[start:end]
        found.append(
            {"value": _signed(f"{kind} {value}"), "around": _signed(" ".join(words)), "terms": sorted(set(words))}
        )
    return found


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch, "text"):
            rows = []
            for raw in texts_of(part, "text"):
                text = raw.decode(errors="replace")
                spans = personal_spans(text)
                counts = Counter(kind for kind, _, _ in spans)
                near = _near(text, spans) if spans else []
                rows.append((_signed(raw), *(counts[kind] for kind in KINDS), listed(spans), near))
            yield as_batch(_FOUND, [part["doc_id"], *zip(*rows, strict=True)])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, counts by kind, ``base`` spans and
    what stands ``near`` each. Null counts as empty; other columns are not read."""
    return docs.select("doc_id", "text").mapInArrow(_find, _FOUND_DDL)


def _place(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % PLACES


def _preselected(terms: DataFrame) -> bytes:
    """Bit table of the places of all terms, of ``PLACES`` / 8 bytes at any size."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = {_place(word) for word in batch["term"].to_pylist()}
            yield pa.RecordBatch.from_pydict({"place": pa.array(sorted(places), pa.int32())})

    places = terms.select("term").mapInArrow(bits, "place int").distinct()
    table = np.zeros(PLACES, bool)
    # At most ``PLACES`` rows.
    for batch in places.toArrow().to_batches():
        table[batch["place"].to_numpy()] = True
    return np.packbits(table).tobytes()


def _counts_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences of each of ``terms`` in the whole corpus: term, occurrences."""
    table = docs.sparkSession.sparkContext.broadcast(_preselected(terms))
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for part in text_chunks(batch, "text", 8 << 20):
                counts: Counter[str] = Counter()
                for raw in texts_of(part, "text"):
                    counts.update(_TERM.findall(raw.decode(errors="replace").lower()))
                rows = []
                for word, n in counts.items():
                    place = _place(word)
                    if bits[place >> 3] & (128 >> (place & 7)):
                        rows.append((word, n))
                if rows:
                    yield as_batch(schema, zip(*rows, strict=True))

    counted = docs.select("text").mapInArrow(count, "term string, n long")
    counted = counted.groupBy("term").agg(F.sum("n").alias("occurrences"))
    return counted.join(terms.select("term").distinct(), "term")


def revealing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Terms that give values away: term, bits, share, action.

    ``found`` is the stored result of ``find_personal_data`` on ``docs``. Copies
    of one passage are one piece of evidence, but all occurrences are counted.
    """
    near = found.select(F.explode("near").alias("at")).select("at.*")
    pairs = near.select("value", "around", F.explode("terms").alias("term"))
    pairs = (
        pairs.groupBy("value", "term", "around")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value", "term")
        .agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("evidence"))
        .where(F.col("evidence") >= LEAST_EVIDENCE)
    )
    pairs = stored(pairs.select("value", "term", "together"))
    values = near.groupBy("value").agg(F.count(F.lit(1)).alias("mentions"))
    total = near.agg(F.count(F.lit(1))).scalar()
    share = F.least(F.lit(1.0), F.col("together") / F.col("occurrences"))
    bits = F.log2(F.col("share") / (F.col("mentions") / F.col("total")))
    return (
        pairs.join(_counts_of(docs, pairs), "term")
        .join(values, "value")
        .withColumn("total", total)
        .withColumn("share", share)
        .withColumn("bits", bits)
        .where((F.col("share") >= LEAST_SHARE) & (F.col("bits") >= GENERALISE_BITS))
        .groupBy("term")
        .agg(F.max("bits").alias("bits"), F.max("share").alias("share"))
        .withColumn("action", F.when(F.col("bits") >= REMOVE_BITS, REMOVED).otherwise(GENERALISED))
    )


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Where ``terms`` (term, action) stand: doc_id, text_hash, ``revealing``.

    ``revealing`` holds structs of action, start and end, sorted; documents
    without any are not listed.
    """
    table = docs.sparkSession.sparkContext.broadcast(_preselected(terms))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        if not any(bits):
            for _ in batches:
                pass
            return
        for batch in batches:
            for part in text_chunks(batch, "text"):
                rows = []
                for doc_id, raw in zip(part["doc_id"].to_pylist(), texts_of(part, "text"), strict=True):
                    text = raw.decode(errors="replace")
                    chosen = set()
                    for word in set(_TERM.findall(text.lower())):
                        place = _place(word)
                        if bits[place >> 3] & (128 >> (place & 7)):
                            chosen.add(word)
                    if chosen:
                        own = ((m[0].lower(), m.start(), m.end()) for m in _TERM.finditer(text))
                        text_hash = _signed(raw)
                        rows += [(doc_id, text_hash, *hit) for hit in own if hit[0] in chosen]
                if rows:
                    yield as_batch(schema, zip(*rows, strict=True))

    hits = docs.select("doc_id", "text").mapInArrow(
        find, "doc_id long, text_hash long, term string, start long, end long"
    )
    spans = F.array_sort(F.collect_set(F.struct("action", "start", "end")))
    return hits.join(terms.select("term", "action"), "term").groupBy("doc_id", "text_hash").agg(spans.alias("revealing"))


def disclosures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_<kind>, base, revealing, spans.

    ``base`` are the spans of personal data as ``kind:start:end`` in code points,
    comma-joined by kind and start; ``spans`` has those of revealing terms after
    them. A term that overlaps personal data is left to it. Null counts as empty;
    a corpus without personal data reveals nothing. Repeated rows are reported
    alike. Columns other than doc_id and text are not read.
    """
    found = stored(find_personal_data(docs))
    terms = stored(revealing_terms(docs, found).select("term", "action"))
    other = term_spans(docs, terms).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    joined = found.drop("near").join(
        other, found["doc_id"].eqNullSafe(other["id"]) & (found["text_hash"] == other["hash"]), "left"
    )
    base = F.filter(F.split("base", ","), lambda s: s != "")
    places = F.transform(
        base,
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("start"),
            F.split_part(s, F.lit(":"), F.lit(3)).cast("long").alias("end"),
        ),
    )
    apart = bound(
        places,
        lambda own: F.filter(
            "revealing",
            lambda r: ~F.exists(own, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])),
        ),
    )
    nothing = F.array().cast("array<struct<action:string,start:long,end:long>>")
    joined = joined.withColumn("revealing", F.when(F.col("revealing").isNotNull(), apart).otherwise(nothing))
    extra = F.transform("revealing", lambda r: F.concat_ws(":", r["action"], r["start"], r["end"]))
    all_ = F.array_join(F.concat(base, extra), ",")
    return joined.select("doc_id", *(f"n_{k}" for k in KINDS), "base", "revealing", all_.alias("spans"), "text_hash")


def sanitised(text: str | None, spans: str) -> str | None:
    """A text without its spans: values by ``[KIND]``, generalised terms by
    ``[TERM]``, removed terms by nothing. Of overlapping spans the first counts."""
    if text is None:
        return None
    parts, at = [], 0
    found = (span.split(":") for span in spans.split(",") if span)
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in found):
        if start < at:
            continue
        name = {GENERALISED: "[TERM]", REMOVED: ""}.get(kind, f"[{kind.upper()}]")
        parts += [text[at:start], name]
        at = end
    return "".join([*parts, text[at:]])


def sanitise_documents(docs: DataFrame) -> DataFrame:
    """The documents with sanitised texts, all columns; one row per row."""
    schema = docs.schema
    id_, own_hash, hashes, spans = (free_name(docs, x) for x in ("found_id", "own_hash", "found_hash", "found_spans"))

    @F.pandas_udf("long")
    def text_hash(texts):
        return texts.map(lambda text: _signed((text or "").encode()))

    @F.pandas_udf("string")
    def clean(texts, found):
        import pandas as pd

        return pd.Series([sanitised(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    found = disclosures(docs).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hashes), F.col("spans").alias(spans))
    found = found.dropDuplicates([id_, hashes])
    own = docs.withColumn(own_hash, text_hash("text"))
    joined = own.join(found, own["doc_id"].eqNullSafe(found[id_]) & (own[own_hash] == found[hashes]), "left")
    return joined.withColumn("text", clean("text", spans)).select(*(F.col(f.name) for f in schema))
