"""Short codes of vectors: each part of a vector by the nearest entry of a codebook.

The codebooks are fitted on all vectors by ball k-means. The parts that share an
entry are a ball around it. Twice the ball's radius bounds the distance of the
entries that can be nearer to any of its parts, its neighbours. A part nearer to
its entry than half the way to the nearest neighbour lies in the stable core and
keeps its entry unseen; the others lie in rings, each of which has to look at the
neighbours up to one distance only. Everything is in whole numbers, so results
are exact and ties are real.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clientela.llm.batches import as_batch
from clientela.sources.scratch import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Larger scaled components would overflow the sums of squares in 64 bits.
LARGEST = 1 << 27
# Up to here products of components add up exactly in doubles.
_SMALL = 1 << 20
_ROWS = 4096

VECTOR = "vec_id long, label int, vector array<int>, codes binary, error long"
_VECTORS = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.int32()), ("vector", pa.list_(pa.int32())), ("codes", pa.binary()), ("error", pa.int64())]
)
_SUMS = pa.schema([("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


class Balls:
    """Distances between the entries of one part, nearest first."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray, exact: type):
        self.entries = entries.astype(exact)
        self.moved = moved
        self.squares = (self.entries**2).sum(axis=1)
        between = self.squares[:, None] + self.squares - 2 * (self.entries @ self.entries.T)
        np.fill_diagonal(between, -1)
        self.order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.between = np.take_along_axis(between, self.order, axis=1)

    def to(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances of points to some entries."""
        near = self.entries[entries]
        return (points**2).sum(axis=1)[:, None] + self.squares[entries] - 2 * (points @ near.T)

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """By looking at every entry; the first of equal ones."""
        return self.to(points, np.arange(len(self.entries))).argmin(axis=1)

    def own(self, points: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return ((points - self.entries[codes]) ** 2).sum(axis=1)

    def reassigned(self, points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """Nearest entries of points that had ``codes`` before the entries moved,
        and how many distances to other entries that took.

        The balls here are those of the given points alone, which are smaller
        than those of all points and so have fewer neighbours.
        """
        codes = codes.copy()
        looked = 0
        distance = self.own(points, codes)
        by_ball = np.argsort(codes, kind="stable")
        first = np.searchsorted(codes[by_ball], np.arange(len(self.entries) + 1))
        before = codes.copy()
        for ball in np.unique(before):
            members = by_ball[first[ball] : first[ball + 1]]
            reach = 4 * distance[members]
            # Half the way to an entry beyond this is more than the radius.
            neighbours = int(np.searchsorted(self.between[ball], reach.max(), "right"))
            near = self.order[ball, :neighbours]
            if not neighbours or not (self.moved[ball] or self.moved[near].any()):
                continue
            rings = np.searchsorted(self.between[ball], reach, "right")
            outside = np.flatnonzero(rings)
            members, rings = members[outside], rings[outside]
            looked += int(rings.sum())
            candidates = np.sort(np.append(near, ball))
            found = self.to(points[members], candidates)
            # A ring's candidates are its neighbours up to its own reach.
            depth = np.zeros(len(self.entries), np.int64)
            depth[near] = np.arange(1, neighbours + 1)
            beyond = depth[candidates] > rings[:, None]
            found[beyond] = found.max() + 1 if len(found) else 0
            codes[members] = candidates[found.argmin(axis=1)]
        return codes, looked


@dataclass
class Codebook:
    """Entries of all parts (part, entry, component), and which the last round moved."""

    entries: np.ndarray
    moved: np.ndarray
    _balls: dict[type, list[Balls]] = field(default_factory=dict, repr=False)

    def balls(self, exact: type) -> list[Balls]:
        """Distances between the entries of each part, computed once per task."""
        if exact not in self._balls:
            self._balls[exact] = [Balls(e, m, exact) for e, m in zip(self.entries, self.moved, strict=True)]
        return self._balls[exact]

    def decimal(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.decimal().encode()).hexdigest()


def _exact(*values: np.ndarray) -> type:
    """A type in which sums of squares of these whole numbers are exact."""
    return np.float64 if max(np.abs(v).max(initial=0) for v in values) <= _SMALL else np.int64


def assigned(vectors: np.ndarray, codes: np.ndarray | None, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Codes by part of whole vectors, and the squared distances summed over parts."""
    parts, _, width = book.entries.shape
    exact = _exact(vectors, book.entries)
    result = np.zeros((len(vectors), parts), np.int64)
    error = np.zeros(len(vectors), np.int64)
    for p, balls in enumerate(book.balls(exact)):
        points = vectors[:, p * width : (p + 1) * width].astype(exact)
        result[:, p] = balls.nearest(points) if codes is None else balls.reassigned(points, codes[:, p])[0]
        error += balls.own(points, result[:, p]).astype(np.int64)
    return result, error


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch["vector"].flatten().to_numpy().reshape(batch.num_rows, width)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def _assign(book: Codebook) -> Callable:
    """A new code for every vector, from the one it has if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = book.entries.shape
        for batch in _slices(batches):
            before = None
            if batch.num_rows and batch["codes"].null_count == 0:
                before = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            codes, error = assigned(_matrix(batch, parts * width).astype(np.int64), before, book)
            packed = [row.tobytes() for row in codes.astype(np.uint8)]
            yield as_batch(_VECTORS, [batch["vec_id"], batch["label"], batch["vector"], packed, error])

    return run


def _sum(parts: int, width: int) -> Callable:
    """Number and componentwise sums of the parts of each entry, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * ENTRIES, np.int64)
        sums = np.zeros((parts * ENTRIES, width), np.int64)
        for batch in _slices(batches):
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, parts)
            vectors = _matrix(batch, parts * width).astype(np.int64)
            for p in range(parts):
                entry = p * ENTRIES + codes[:, p].astype(np.int64)
                n += np.bincount(entry, minlength=len(n))
                np.add.at(sums, entry, vectors[:, p * width : (p + 1) * width])
        used = np.flatnonzero(n)
        yield as_batch(_SUMS, [used, n[used], sums[used].tolist()])

    return run


def moved(book: Codebook, assigned_vectors: DataFrame) -> Codebook:
    """The codebook with every used entry at the floor of the mean of its parts.

    At most ``PARTS * ENTRIES`` rows reach the driver.
    """
    parts, _, width = book.entries.shape
    sums = assigned_vectors.select("vector", "codes").mapInArrow(_sum(parts, width), "entry int, n long, sums array<long>")
    totals = sums.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))
    entries = book.entries.copy()
    for row in totals.collect():
        part, entry = divmod(row["entry"], ENTRIES)
        entries[part, entry] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return Codebook(entries, (entries != book.entries).any(axis=2))


def usable(embedding: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    unusable = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & ~unusable, F.lit(False))


def _scaled(embedding: str) -> Column:
    """Whole components, floor(1024 * x); a component too large for exact sums fails.

    Null for a vector that is not usable, wherever the optimiser moves the filter.
    """
    value = F.col(embedding)
    whole = F.transform(value, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    too_large = F.exists(value, lambda x: F.abs(x.cast("double")) * SCALE > LARGEST)
    failure = F.raise_error(F.lit(f"a component times {SCALE} is beyond {LARGEST}")).cast("array<int>")
    return F.when(~usable(embedding), None).when(too_large, failure).otherwise(whole.cast("array<int>"))


def first_codebook(vectors: DataFrame) -> Codebook | None:
    """The parts of the vectors with the smallest ids, at most ``ENTRIES``; None without vectors.

    An id that comes with several vectors gives its smallest one.
    """
    whole = vectors.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    first = whole.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").limit(ENTRIES).collect()
    if not first:
        return None
    size = len(first[0]["vector"])
    rows = np.array([r["vector"] for r in first if len(r["vector"]) == size], np.int64)
    entries = rows.reshape(len(rows), PARTS, size // PARTS).swapaxes(0, 1).copy()
    return Codebook(entries, np.ones(entries.shape[:2], bool))


def compress_vectors(embeddings: DataFrame) -> DataFrame:
    """Codes of all vectors: vec_id, label, codes (one byte a part), error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out, and
    so are those that cannot be cut like the one with the smallest id: of another
    length, or of one that ``PARTS`` does not divide. Null ids are in no first
    codebook but have codes. Fewer than 256 ids make smaller codebooks. Rows that
    repeat an id count and are coded each. A component beyond 131,072 fails.

    Every round assigns all vectors in one pass, written once with their codes,
    from which a second pass sums per entry. Nothing else is shuffled.
    """
    chosen = embeddings.where(usable("embedding")).select("vec_id", F.col("label").cast("int").alias("label"), _scaled("embedding").alias("vector"))
    book = first_codebook(chosen)
    nothing = chosen.select("*", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error"))
    if book is None:
        return nothing.where(F.lit(False)).withColumn("codebooks_sha256", F.lit(""))
    coded = nothing.where(F.size("vector") == book.entries.shape[0] * book.entries.shape[2])
    for _ in range(ROUNDS):
        coded = stored(coded.mapInArrow(_assign(book), VECTOR))
        book = moved(book, coded)
    coded = stored(coded.mapInArrow(_assign(book), VECTOR))
    return coded.withColumn("codebooks_sha256", F.lit(book.sha256()))


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the error summed over its label; nulls are one label."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
