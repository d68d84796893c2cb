"""Near-duplicates: a Hamming join of MinHash signatures over several indexes.

A signature is 64 values of 16 bits, in 16 chunks of 4. Two signatures that
differ in at most 31 values have a chunk with at most one difference, since two
in each would make 32. So a document is indexed under every chunk with every one
of its values left out, 64 keys, and two such documents share one of them. Texts
whose shingle sets have a Jaccard similarity of 0.75 differ in 16 of 64 values
on average, in more than 31 once in 70,000 pairs, at 0.8 once in 12 million.

Pairs under one key are not listed. First each document meets only the smallest
of each of its keys, and verified links are merged into components. Then only
keys that still hold several components are searched, for pairs across them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clientela.llm.batches import as_batch, text_chunks, texts_of
from clientela.llm.components import components
from clientela.llm.shingles import BINS, VALUES, bins, shingle_set, signature, similar
from clientela.sources.scratch import stored

PERCENT = 75
CHUNK = 4
CHUNKS = VALUES // CHUNK
FURTHEST = 2 * CHUNKS - 1
# Members of a key that are compared at once, and rows of a task.
BLOCK = 1024
CELL = 10_000
# Places of the table of ids that may be looked up: bounds its broadcast.
PLACES = 1 << 20

SKETCH = "doc_id long, n_shingles long, set_digest binary, signature binary, bins binary"
_SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_digest", pa.binary()),
        ("signature", pa.binary()), ("bins", pa.binary()),
    ]
)
_KEYS = pa.schema([("key", pa.int64()), ("rep", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for part in text_chunks(batch, "text"):
            rows = []
            for text in texts_of(part, "text"):
                shingles = shingle_set(text)
                if len(shingles):
                    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                    rows.append((len(shingles), digest, signature(shingles).tobytes(), bins(shingles).tobytes()))
                else:
                    rows.append((0, None, None, None))
            yield as_batch(_SKETCH, [part["doc_id"], *zip(*rows, strict=True)])


def _values(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64 keys per set: chunk, the value left out, and the three others."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _values(batch["signature"], np.uint16, VALUES).astype(np.int64)
        rep = batch["rep"].to_numpy()
        for chunk in range(CHUNKS):
            for left_out in range(CHUNK):
                key = np.full(len(rep), chunk * CHUNK + left_out)
                for place in range(CHUNK):
                    if place != left_out:
                        key = key << 16 | values[:, chunk * CHUNK + place]
                yield as_batch(_KEYS, [key, rep])


def _near(a: np.ndarray, b: np.ndarray, bins_a, bins_b, size_a, size_b) -> np.ndarray:
    """Pairs within the signature distance whose sizes and bins allow a link.

    Bins are a second sketch: each holds the smallest of the union in it, which
    both have as often as their similarity says. For a pair at the threshold
    that is a draw without replacement, and fewer than the expected number less
    five standard deviations and one are drawn less than once in a million times.
    """
    near = (a != b).sum(axis=-1) <= FURTHEST
    near &= 100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)
    agree = ((bins_a == bins_b) & (bins_a > 0)).sum(axis=-1)
    filled = ((bins_a > 0) | (bins_b > 0)).sum(axis=-1)
    share = PERCENT / 100
    union = np.maximum((size_a + size_b) / (1 + share), filled)
    deviation = np.sqrt(share * (1 - share) * filled * (1 - filled / (union + 1)))
    return near & (agree >= share * filled - 5 * deviation - 1)


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(s, 2048) for s in range(0, batch.num_rows, 2048)):
            sides = [
                (
                    _values(part[f"signature_{x}"], np.uint16, VALUES),
                    _values(part[f"bins_{x}"], np.uint8, BINS),
                    part[f"n_{x}"].to_numpy(),
                )
                for x in "ab"
            ]
            keep = _near(*(side[k] for k in range(3) for side in sides))
            ids = [part[x].to_numpy()[keep] for x in "ab"]
            yield as_batch(_PAIRS, ids)


def _first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the first key that pairs of signatures share."""
    same = (a == b).reshape(len(a), CHUNKS, CHUNK)
    chunk = (same.sum(axis=2) >= CHUNK - 1).argmax(axis=1)
    return chunk * CHUNK + same[np.arange(len(a)), chunk].argmin(axis=1)


def _across(cell: pa.Table) -> pa.Table:
    """Near pairs of different components under the keys of one cell.

    A pair is found under each key it shares and returned under the first.
    """
    cell = cell.sort_by([(c, "ascending") for c in ("key", "low", "high", "rep")])
    key, low, high, block, rep, comp, size = (
        cell[c].to_numpy() for c in ("key", "low", "high", "block", "rep", "comp", "n")
    )
    values = _values(cell["signature"], np.uint16, VALUES)
    sketch = _values(cell["bins"], np.uint8, BINS)
    found = [np.empty((0, 2), np.int64)]
    change = (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
    starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(key)]])
    for start, end in zip(starts[:-1], starts[1:]):
        rows = np.arange(start, end)
        left = rows[block[rows] == low[start]]
        right = rows[block[rows] == high[start]]
        for part in np.array_split(left, max(1, len(left) * len(right) // 50_000)):
            x, y = (g.ravel() for g in np.meshgrid(part, right, indexing="ij"))
            other = comp[x] != comp[y]
            if low[start] == high[start]:
                other &= x < y
            x, y = x[other], y[other]
            for s in range(0, len(x), 5_000):
                i, j = x[s : s + 5_000], y[s : s + 5_000]
                near = _near(values[i], values[j], sketch[i], sketch[j], size[i], size[j])
                i, j = i[near], j[near]
                first = _first_key(values[i], values[j]) == key[start] >> 48
                found.append(np.stack([rep[i[first]], rep[j[first]]], axis=1))
    return pa.Table.from_arrays([pa.array(c) for c in np.concatenate(found).T], schema=_PAIRS)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, shingles_b = None, None
    for batch in batches:
        for part in text_chunks(batch, "text_a"):
            keep = []
            for b, text_a, text_b in zip(
                part["b"].to_pylist(), texts_of(part, "text_a"), texts_of(part, "text_b"), strict=True
            ):
                if b != last:
                    last, shingles_b = b, shingle_set(text_b)
                keep.append(similar(shingle_set(text_a), shingles_b, PERCENT))
            part = part.filter(pa.array(keep, pa.bool_()))
            yield as_batch(_PAIRS, [part["a"], part["b"]])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    Before texts are shuffled, those that surely are in no pair are left out by
    a table of hashed ids, of at most ``PLACES`` rows at any size of the data.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("place")
    places = (
        pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).select(place).distinct()
    )
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    texts = texts.withColumn("place", place).join(F.broadcast(places), "place", "left_semi")
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_verified, "a long, b long")


def _links_across(buckets: DataFrame, sets: DataFrame, merged: DataFrame) -> DataFrame:
    """Near pairs of different components that share a key."""
    named = merged.withColumnRenamed("node", "rep")
    members = buckets.join(named, "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp")
    )
    open_keys = (
        members.groupBy("key")
        .agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"))
        .where("x < y")
        .select("key", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    )
    rows = members.join(open_keys, "key").join(sets.select("rep", "n", "signature", "bins"), "rep")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # A large key is cut into blocks, and every pair of blocks is work of its own.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(
        "key", "rep", "comp", "n", "signature", "bins", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    rows = stored(rows)
    cells = max(1, -(-rows.count() // CELL))
    cell = F.pmod(F.xxhash64("key", "low", "high"), F.lit(cells)).alias("cell")
    return rows.groupBy(cell).applyInArrow(_across, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose sets of five-word shingles have a Jaccard similarity of at
    least 0.75 are linked; a component is named by its smallest id, and that
    document is kept. Equal sets are one node. Null, empty and blank texts are
    linked with nothing and kept. Rows with a null id are in the component of
    the equal set with an id, and kept if there is none. Rows that repeat an id
    are one node. Columns other than doc_id and text are not read.
    """
    sketches = stored(docs.select("doc_id", "text").mapInArrow(_sketches, SKETCH))
    sets = sketches.where("n_shingles > 0").groupBy("set_digest", "n_shingles", "signature", "bins")
    sets = stored(sets.agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    sets = sets.withColumnRenamed("n_shingles", "n")

    keys = sets.select("rep", "signature").mapInArrow(_keys, "key long, rep long")
    leaders = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"))
    leaders = leaders.where("leader < last").select("key", "leader")
    buckets = stored(keys.join(leaders, "key"))

    pairs = buckets.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    for x in "ab":
        side = sets.select(
            F.col("rep").alias(x), F.col("n").alias(f"n_{x}"),
            F.col("signature").alias(f"signature_{x}"), F.col("bins").alias(f"bins_{x}"),
        )
        pairs = (pairs.distinct() if x == "a" else pairs).join(side, x)
    pairs = stored(pairs.mapInArrow(_near_pairs, "a long, b long"))
    links = stored(verified(pairs, docs))
    merged = stored(components(links))

    pairs = stored(_links_across(buckets.select("key", "rep"), sets, merged).distinct())
    more = verified(pairs, docs)
    stars = merged.select(F.col("node").alias("a"), F.col("component").alias("b"))
    merged = components(stars.unionByName(more)).withColumnRenamed("node", "rep")

    named = sets.select("set_digest", "rep").join(merged, "rep", "left")
    named = named.select("set_digest", F.coalesce("component", "rep").alias("component_id"))
    return (
        sketches.select("doc_id", "n_shingles", "set_digest")
        .join(named, "set_digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
        .withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents that are the first of their component, all columns as they are."""
    dropped = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
