"""Best-fit packing of documents into sequences after a dominance reduction.

Only the number of pieces of each length decides how many sequences are needed,
and there are at most ``capacity`` lengths. So the plan is made from that table
alone: sets of lengths with the number of sequences that hold them. Pieces then
look up their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clientela.llm.batches import as_batch, text_chunks, texts_of
from clientela.llm.tokens import tokenizer
from clientela.sources.scratch import stored

CAPACITY = 2048
END = 0
# Pieces of one length that are ranked in one task.
RANKED = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ]
)


@dataclass(frozen=True)
class Pattern:
    """``sequences`` alike: (length, how many of it in each), in their order."""

    holds: tuple[tuple[int, int], ...]
    sequences: int


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces of at most ``capacity`` token ids, the last id ``END``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            for part in text_chunks(batch, "text"):
                rows = []
                encoded = encoder.encode(texts_of(part, "text"))
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encoded, strict=True):
                    ids = memoryview(ids + END.to_bytes(4, "little"))
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own)))
                yield as_batch(_PIECES, zip(*rows, strict=True))

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _largest_pair(lengths: list[int], left: Counter, most: int) -> int:
    """Largest sum of two pieces that is at most ``most``, 0 if there is none."""
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > most:
            high -= 1
        else:
            if low < high or left[lengths[low]] > 1:
                best = max(best, total)
            low += 1
    return best


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], Counter]:
    """Sequences that some best packing has, and the pieces that are left.

    Martello and Toth: with the longest piece, a set of others dominates all
    alternatives if each can be swapped for a part of the set. That is proved
    here for no other piece (none fits), for one that fills the sequence, and for
    the longest one that fits where no two fit, or where no three fit and it is
    at least as long as any two that do. Equal lengths are fixed together, as
    often as the proof holds. Ends with the first length that nothing is proved for.
    """
    left = Counter({length: n for length, n in counts.items() if n > 0})
    lengths = sorted(left)
    fixed = []
    while lengths:
        longest = lengths[-1]
        room = capacity - longest
        others = Counter(left)
        others[longest] -= 1
        fit = bisect_right(lengths, room)
        partner = next((x for x in reversed(lengths[:fit]) if others[x]), 0)
        if partner and partner != room:
            shortest = sorted(
                x for length in lengths[: min(fit, 3)] for x in [length] * min(others[length], 3)
            )[:3]
            two, three = sum(shortest[:2]), sum(shortest)
            two_fit = len(shortest) > 1 and two <= room
            three_fit = len(shortest) > 2 and three <= room
            if three_fit or (two_fit and partner < _largest_pair(lengths[:fit], others, room)):
                break
        if not partner:
            times, holds = left[longest], ((longest, 1),)
        elif partner == longest:
            times, holds = left[longest] // 2, ((longest, 2),)
        else:
            # While both last, what is proved for one piece is proved for the
            # next: fewer others fit, and the partner is still the longest.
            times, holds = min(left[longest], left[partner]), ((longest, 1), (partner, 1))
        fixed.append(Pattern(holds, times))
        for length, each in holds:
            left[length] -= each * times
            if not left[length]:
                del left[length]
                lengths.remove(length)
    return fixed, left


def best_fit(counts: Counter, capacity: int) -> list[Pattern]:
    """Longest first, each piece into the fullest sequence that has room.

    Equal sequences are one entry with a count, so the work depends on the
    number of lengths and not on the number of pieces.
    """
    open_: dict[int, list[tuple[tuple, int]]] = {0: []}
    rooms: list[int] = []

    def put(holds: tuple, sequences: int, room: int) -> None:
        if sequences:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((holds, sequences))

    for length in sorted(counts, reverse=True):
        waiting = counts[length]
        while waiting:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                holds, sequences = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.remove(room)
            else:
                room, holds, sequences = capacity, (), -(-waiting // (capacity // length))
            each = room // length
            full = min(sequences, waiting // each)
            put((*holds, (length, each)), full, room - each * length)
            waiting -= full * each
            some = waiting if full < sequences else 0
            if some:
                put((*holds, (length, some)), 1, room - some * length)
                waiting = 0
            put(holds, sequences - full - bool(some), room)
    return [Pattern(*entry) for entries in open_.values() for entry in entries]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduced(counts, capacity)
    return fixed + best_fit(left, capacity)


def _ranges(plan: list[Pattern]) -> np.ndarray:
    """Length, first rank, pieces in a sequence, its first sequence, offset there."""
    rows, taken, base = [], Counter(), 0
    for pattern in plan:
        offset = 0
        for length, each in pattern.holds:
            rows.append((length, taken[length], each, base, offset))
            taken[length] += each * pattern.sequences
            offset += each * length
        base += pattern.sequences
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset.

    ``pieces`` are read twice: store them. Pieces of one length are ranked by
    salts, so a length that most pieces have is spread over many tasks, and the
    salts' shares are added up from counts.
    """
    totals = {row[0]: row[1] for row in pieces.groupBy("length").count().collect()}
    ranges = _ranges(packing_plan(totals, capacity))
    salts = max(1, -(-max(totals.values(), default=0) // RANKED))

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    by_salt = Window.partitionBy("length").orderBy("salt")
    first = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("here"))
    first = first.select("length", "salt", (F.sum("here").over(by_salt) - F.col("here")).alias("before"))
    in_salt = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(in_salt) - 1)
    ranked = ranked.join(first, ["length", "salt"])
    ranked = ranked.select(*_PIECES.names, (F.col("rank") + F.col("before")).alias("rank"))

    columns = _PIECES.names
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = 1 << 48
        starts = ranges[:, 0] * high + ranges[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            _, begin, each, base, offset = ranges[np.searchsorted(starts, length * high + rank, "right") - 1].T
            sequence = base + (rank - begin) // each
            at = offset + (rank - begin) % each * length
            yield as_batch(schema, [*(batch[c] for c in columns), sequence, at])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document has at least the id ``END``, so null and empty texts are
    pieces of length 1. Rows that repeat an id, and rows with a null id, are
    packed each for itself. Columns other than doc_id and text are not read.
    """
    return packed(stored(pieces(docs, tokenizer_path, capacity)), capacity)
