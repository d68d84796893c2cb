"""Removal of passages that an earlier document has, by sorting suffixes.

Every 50-byte window of a text has an anchor: the position of the smallest hash
among its 20-byte grams, the first of equals. Equal windows have equal anchors
at the same place, so all that can be equal to a window is found under its
anchor's gram, and about one position in 16 is an anchor. Texts are dealt into
blocks of about ``BLOCK_BYTES``, grams into as many buckets, in three exchanges:

1. Blocks send the grams of their anchors, each once. Buckets answer which occur
   in more than one document.
2. Blocks send the text around those anchors, each different one once. Buckets
   sort the suffixes that begin at anchors by a mergesort whose comparisons find
   the common extension by binary search over prefix hashes. Neighbours' common
   extensions give the suffixes that agree right of the anchor for any length;
   with the hash left of it, windows that are equal. They answer which windows a
   smaller id has.
3. Blocks remove what those windows cover.

A gram or a text in many documents comes once from each block. Where a gram has
more than ``CROWDED`` anchors, as at the edge of a passage that many documents
share, its windows are sent one by one and dealt by their own content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from clientela.llm.batches import texts_of
from clientela.llm.shingles import mixed

SPAN = 50
GRAM = 20
GRAMS = SPAN - GRAM + 1
# Bytes of the longest surroundings, SPAN + GRAMS - 1.
WIDTH = 80
BLOCK_BYTES = 4 << 20
CROWDED = 5000
# Window starts that are scanned at once; texts of any length are cut for it.
SCANNED = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)
_LAST = np.iinfo(np.int64).max

_random = np.random.default_rng(50)
_BASE = np.uint64(int(_random.integers(2**62, 2**63)) | 1)
_MULTIPLIERS = (_random.integers(0, 2**63, 10, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a number."""
    return np.ndarray((len(buffer) - 7,), np.uint64, buffer, 0, (1,))


def _gram_hash(first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of grams from their words at 0, 8 and 12."""
    return mixed(mixed(first * _MULTIPLIERS[0] + middle * _MULTIPLIERS[1]) + last)


def _distinct(around: np.ndarray, left: np.ndarray, length: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal surroundings: the number of each row's, a row of each with the
    smallest id, and their digests. Rows of one digest are compared whole."""
    digest = mixed(left.astype(np.uint64) * _MULTIPLIERS[0] + length.astype(np.uint64))
    for i, column in enumerate(around.view(np.uint64).T):
        digest = mixed(digest + column * _MULTIPLIERS[i])
    order = np.lexsort((ids, digest))
    new = np.ones(len(order), bool)
    new[1:] = digest[order][1:] != digest[order][:-1]
    same = np.flatnonzero(~new)
    one, other = order[same], order[same - 1]
    new[same] = (
        (left[one] != left[other]) | (length[one] != length[other]) | (around[one] != around[other]).any(axis=1)
    )
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new], digest


def _anchors_in(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: first, last, anchor, gram hash."""
    eight = _words(buffer)
    n = len(buffer) - GRAM + 1
    grams = _gram_hash(eight[:n], eight[8 : n + 8], eight[12 : n + 12])
    least = (grams & ~_POSITION) | np.arange(n, dtype=np.uint64)
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    rest = GRAMS - 16
    least = np.minimum(least[:-rest], least[rest:])
    anchor = (least[starts] & _POSITION).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], anchor[first], grams[anchor[first]]


class _Block:
    """Texts of a block, end to end in order of ids; a null id counts as the last."""

    def __init__(self, docs: pa.Table):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = texts_of(docs, "text")
        self.doc_ids = docs["doc_id"].to_pylist()
        self.ids = docs["doc_id"].fill_null(_LAST).to_numpy()
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.buffer = np.frombuffer(b"".join(texts) + bytes(WIDTH), np.uint8)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Of all windows: row, first and last start, anchor, gram hash."""
        parts = []
        row = 0
        while row < len(self.lengths):
            # Some whole texts, or one that is scanned in slices.
            end = int(np.searchsorted(self.begins, self.begins[row] + SCANNED, "right")) - 1
            end = max(row + 1, end)
            low, high = int(self.begins[row]), int(self.begins[end])
            for at in range(low, max(low + 1, high), SCANNED if end == row + 1 else max(1, high - low)):
                stop = min(high, at + SCANNED) if end == row + 1 else high
                part = self.buffer[at : min(high, stop + SPAN - 1)]
                if len(part) < SPAN:
                    continue
                starts = np.arange(at, min(stop, high - SPAN + 1))
                owner = np.searchsorted(self.begins, starts, "right") - 1
                starts = starts[starts + SPAN <= self.begins[owner + 1]]
                if len(starts):
                    first, last, anchor, gram = _anchors_in(part, starts - at)
                    parts.append((first + at, last + at, anchor + at, gram))
            row = end
        if not parts:
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty, empty.astype(np.uint64)
        first, last, anchor, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
        return np.searchsorted(self.begins, first, "right") - 1, first, last, anchor, gram

    def shared(self, answers: pa.Table) -> dict[str, np.ndarray]:
        """What surrounds the anchors of shared grams, each different one once.

        For every occurrence: row, first and last window start, anchor and the
        number of its surroundings; for those: gram, smallest id, length left of
        the anchor, length, bytes and their digest, crowded or not.
        """
        row, first, last, anchor, gram = self.anchors()
        known, crowded = _column(answers, "grams", np.uint64), _column(answers, "crowded", np.bool_)
        order = np.argsort(known)
        known, crowded = known[order], crowded[order]
        at = np.minimum(np.searchsorted(known, gram), max(0, len(known) - 1))
        keep = known[at] == gram if len(known) else np.zeros(len(gram), bool)
        row, first, last, anchor, gram, at = (x[keep] for x in (row, first, last, anchor, gram, at))
        single = crowded[at]
        times = np.where(single, last - first + 1, 1)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, first, last, anchor, gram, single = (
            np.repeat(x, times) for x in (row, first, last, anchor, gram, single)
        )
        first = first + inner
        last = np.where(single, first, last)

        length = last - first + SPAN
        left = anchor - first
        around = self.buffer[first[:, None] + np.arange(WIDTH)]
        around[np.arange(WIDTH) >= length[:, None]] = 0
        number, one, digest = _distinct(around, left, length, self.ids[row])
        return {
            "row": row, "first": first, "last": last, "anchor": anchor, "number": number,
            "gram": gram[one], "id": self.ids[row[one]], "left": left[one].astype(np.uint8),
            "length": length[one].astype(np.uint8), "around": around[one], "crowded": single[one],
            "digest": digest[one],
        }


def _opens(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _dealt(bucket: np.ndarray, columns: dict[str, np.ndarray], block: int) -> pa.Table:
    """One row per bucket, with the bytes of its part of each column."""
    order = np.argsort(bucket, kind="stable")
    opens = _opens(bucket[order])
    ends = np.append(opens[1:], len(order))
    data = {"bucket": pa.array(bucket[order][opens], pa.int64()), "block": pa.array([block] * len(opens), pa.int64())}
    for name, values in columns.items():
        values = values[order]
        data[name] = pa.array([values[a:b].tobytes() for a, b in zip(opens, ends, strict=False)], pa.binary())
    return pa.table(data)


def _column(table: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table[name].to_pylist()), dtype)


def _answers(owner: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row per block that asked, with the bytes of its part of each column."""
    table = _dealt(owner, columns, 0)
    return table.drop_columns(["block"]).rename_columns({"bucket": "block"})


def _shared_grams(bucket: pa.Table) -> pa.Table:
    grams = _column(bucket, "grams", np.uint64)
    weight = _column(bucket, "weights", np.uint32)
    sizes = [len(x) // 8 for x in bucket["grams"].to_pylist()]
    block = np.repeat(bucket["block"].to_numpy(), sizes)
    order = np.argsort(grams, kind="stable")
    grams, weight, block = grams[order], weight[order], block[order]
    opens = _opens(grams)
    times = np.diff(np.append(opens, len(grams)))
    shared = (times > 1) | (np.bitwise_or.reduceat(weight & 1, opens) > 0)
    crowded = np.add.reduceat((weight >> 1).astype(np.int64), opens) > CROWDED
    keep = np.repeat(shared, times)
    answer = {"grams": grams[keep], "crowded": np.repeat(crowded, times)[keep]}
    return _answers(block[keep], answer)


def _common(hashes: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common start of suffixes i and j, by binary search."""
    low, high = np.zeros(len(i), np.int64), np.minimum(sizes[i], sizes[j])
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = hashes[i, middle] == hashes[j, middle]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _before(right, hashes, sizes, i, j, or_equal) -> np.ndarray:
    """Whether suffix i sorts before j, or is equal where ``or_equal``."""
    common = _common(hashes, sizes, i, j)
    ended = common == np.minimum(sizes[i], sizes[j])
    at = np.minimum(common, SPAN - 1)
    shorter = np.where(or_equal, sizes[i] <= sizes[j], sizes[i] < sizes[j])
    return np.where(ended, shorter, right[i, at] < right[j, at])


def suffix_order(grams: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within each gram, and the common start with the one before.

    ``right`` holds a suffix per row, ``sizes`` its length. Runs of all grams are
    merged side by side: an element's new place is its own plus its rank in the
    other run, found by binary search. Common starts of neighbours are compared
    byte by byte in the end; if a hash was wrong, the bytes themselves are sorted.
    """
    hashes = np.zeros((len(right), SPAN + 1), np.uint64)
    for i in range(SPAN):
        hashes[:, i + 1] = hashes[:, i] * _BASE + right[:, i] + np.uint64(1)
    order = np.argsort(grams, kind="stable")
    opens = _opens(grams[order])
    size = np.diff(np.append(opens, len(order)))
    open_, size = np.repeat(opens, size), np.repeat(size, size)
    offset = np.arange(len(order)) - open_
    width = 1
    while width < size.max(initial=0):
        run = offset // width
        other = run ^ 1
        begin = open_ + other * width
        active = np.flatnonzero((size > width) & (other * width < size))
        begin, length = begin[active], np.minimum(width, (size - other * width)[active])
        me, is_left = order[active], run[active] % 2 == 0
        low, high = np.zeros(len(active), np.int64), length.copy()
        while True:
            open_search = np.flatnonzero(low < high)
            if not len(open_search):
                break
            middle = (low[open_search] + high[open_search]) >> 1
            they = order[begin[open_search] + middle]
            before = _before(right, hashes, sizes, they, me[open_search], ~is_left[open_search])
            low[open_search] = np.where(before, middle + 1, low[open_search])
            high[open_search] = np.where(before, high[open_search], middle)
        place = open_[active] + (run[active] >> 1) * 2 * width + offset[active] % width + low
        merged = order.copy()
        merged[place] = me
        order = merged
        width *= 2

    def common_bytes(order: np.ndarray) -> np.ndarray:
        a, b = order[:-1], order[1:]
        differ = right[a] != right[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
        return np.where(grams[a] == grams[b], np.minimum(first, np.minimum(sizes[a], sizes[b])), 0)

    if len(order) < 2:
        return order, np.zeros(len(order), np.int64)
    exact = common_bytes(order)
    same = grams[order[:-1]] == grams[order[1:]]
    if (_common(hashes, sizes, order[:-1], order[1:])[same] != exact[same]).any():
        order = np.array(sorted(range(len(right)), key=lambda i: (grams[i], right[i, : sizes[i]].tobytes())))
        exact = common_bytes(order)
    return order, np.concatenate([[0], exact])


def _removable(bucket: pa.Table) -> pa.Table:
    """Of each block's surroundings, a bit per window that a smaller id has."""
    own = _column(bucket, "id", np.int64)
    number = _column(bucket, "number", np.uint32)
    block = np.repeat(bucket["block"].to_numpy(), [len(x) // 8 for x in bucket["id"].to_pylist()])
    packed = zstandard.ZstdDecompressor()
    raw = b"".join(packed.decompress(x) for x in bucket["around"].to_pylist())
    around = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    left, length = (_column(bucket, c, np.uint8).astype(np.int64) for c in ("left", "length"))
    which, one, _ = _distinct(around, left, length, own)
    ids, around, left, length = own[one], around[one], left[one], length[one]
    mask = _masks(ids, around, left, length - left)
    # Whoever has the same surroundings as a smaller id has all windows from it.
    mine = np.where(own > ids[which], np.uint32(2**32 - 1), mask[which])
    some = mine > 0
    return _answers(block[some], {"number": number[some], "mask": mine[some]})


def _masks(ids: np.ndarray, around: np.ndarray, left: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bit per window of different surroundings that one with a smaller id has.

    ``left`` and ``sizes`` are the lengths before the anchor and from it on.
    """
    rows, span, back = np.arange(len(ids))[:, None], np.arange(SPAN), np.arange(GRAMS - 1)
    eight, anchor = _words(around.reshape(-1)), np.arange(len(ids)) * WIDTH + left
    grams = _gram_hash(eight[anchor], eight[anchor + 8], eight[anchor + 12])
    right = around[rows, np.minimum(left[:, None] + span, WIDTH - 1)]
    right[span >= sizes[:, None]] = 0
    reversed_ = around[rows, np.maximum(left[:, None] - 1 - back, 0)]
    before = np.zeros((len(ids), GRAMS), np.uint64)
    for i in back:
        before[:, i + 1] = before[:, i] * _BASE + reversed_[:, i] + np.uint64(1)

    order, common = suffix_order(grams, right, sizes)
    mask = np.zeros(len(ids), np.uint32)
    for shift in range(GRAMS):
        group = np.cumsum(common < SPAN - shift)
        has = (left[order] >= shift) & (sizes[order] >= SPAN - shift)
        who, group = order[has], group[has]
        # Alone with its right side, a window is alone.
        size = np.bincount(group)
        several = size[group] > 1
        who, group = who[several], group[several]
        if not len(who):
            continue
        key = np.lexsort((before[who, shift], group))
        who, group = who[key], group[key]
        near = (group[1:] == group[:-1]) & (before[who[1:], shift] == before[who[:-1], shift])
        same = np.flatnonzero(near)
        if (reversed_[who[same + 1], :shift] != reversed_[who[same], :shift]).any():
            # Two lefts with one hash: tell them apart by their bytes.
            key = sorted(range(len(who)), key=lambda i: (group[i], reversed_[who[i], :shift].tobytes()))
            who, group = who[key], group[key]
            near = (group[1:] == group[:-1]) & (
                reversed_[who[1:], :shift] == reversed_[who[:-1], :shift]
            ).all(axis=1)
        opens = np.flatnonzero(np.concatenate([[True], ~near]))
        least = np.minimum.reduceat(ids[who], opens)
        least = np.repeat(least, np.diff(np.append(opens, len(who))))
        mask[who] |= (least < ids[who]).astype(np.uint32) << np.uint32(shift)
    return mask


def _covered(docs: _Block, shared: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
    """Which bytes of the block lie in a window that a smaller id has."""
    # Of the same surroundings in one block, only the smallest id needs the mask.
    row, number = shared["row"], shared["number"]
    all_ = docs.ids[row] > shared["id"][number]
    begins = np.zeros(len(docs.buffer), np.int32)
    for shift in range(GRAMS):
        start = shared["anchor"] - shift
        hit = (start >= shared["first"]) & (start <= shared["last"])
        hit &= all_ | (mask[number] >> np.uint32(shift) & np.uint32(1) > 0)
        begins[start[hit]] = 1
    running = np.cumsum(begins, dtype=np.int32)
    running[SPAN:] -= running[:-SPAN].copy()
    return running > 0


def _cleaned(docs: _Block, covered: np.ndarray) -> pa.Table:
    rows = []
    for doc_id, at, size in zip(docs.doc_ids, docs.begins.tolist(), docs.lengths.tolist()):
        own, text = covered[at : at + size], docs.buffer[at : at + size]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        rows.append((doc_id, size, int(own.sum()), len(edges) // 2, text[~own].tobytes()))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    columns = zip(*rows, strict=True)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})


@dataclass(frozen=True)
class Exchanges:
    """What a block does in each of the three exchanges."""

    blocks: int

    def bucket_of(self, content: np.ndarray) -> np.ndarray:
        return (mixed(content) % np.uint64(self.blocks)).astype(np.int64)

    def ask(self, table: pa.Table) -> pa.Table:
        block = _Block(table)
        row, _, _, _, gram = block.anchors()
        order = np.lexsort((block.ids[row], gram))
        gram, ids = gram[order], block.ids[row][order]
        opens = _opens(gram)
        ends = np.append(opens[1:], len(gram)) if len(gram) else opens
        several = ids[opens] != ids[ends - 1]
        columns = {"grams": gram[opens], "weights": (ends - opens << 1 | several).astype(np.uint32)}
        return _dealt(self.bucket_of(gram[opens]), columns, table["block"][0].as_py())

    def send(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        shared = _Block(table).shared(answers)
        bucket = self.bucket_of(np.where(shared["crowded"], shared["digest"], shared["gram"]))
        columns = {"number": np.arange(len(bucket), dtype=np.uint32)}
        columns |= {name: shared[name] for name in ("id", "left", "length", "around")}
        table = _dealt(bucket, columns, table["block"][0].as_py())
        pack = zstandard.ZstdCompressor(level=1)
        texts = [pack.compress(x) for x in table["around"].to_pylist()]
        return table.set_column(table.column_names.index("around"), "around", pa.array(texts, pa.binary()))

    def report(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(table)
        shared = block.shared(replies)
        mask = np.zeros(len(shared["gram"]), np.uint32)
        mask[_column(replies, "number", np.uint32)] = _column(replies, "mask", np.uint32)
        return _cleaned(block, _covered(block, shared, mask))


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept.

    Removed is every byte that lies in a 50-byte string which also starts in a
    document with a smaller doc_id, judged on the texts as given. ``n_spans``
    are the runs of removed bytes, ``kept`` the other bytes end to end. Texts
    are UTF-8 bytes, null is empty; texts under 50 bytes lose nothing. A null id
    counts as larger than any. Rows that repeat an id lose nothing to each
    other. Columns other than doc_id and text are not read.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))

    steps = Exchanges(blocks)

    grams = dealt.groupBy("block").applyInArrow(
        lambda docs: steps.ask(docs), "bucket long, block long, grams binary, weights binary"
    )
    answers = grams.groupBy("bucket").applyInArrow(_shared_grams, "block long, grams binary, crowded binary")
    around = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda docs, answers: steps.send(docs, answers),
        "bucket long, block long, number binary, id binary, left binary, length binary, around binary",
    )
    marks = around.groupBy("bucket").applyInArrow(_removable, "block long, number binary, mask binary")
    replies = answers.unionByName(marks, allowMissingColumns=True)
    cleaned = dealt.groupBy("block").cogroup(replies.groupBy("block"))
    return cleaned.applyInArrow(
        lambda docs, replies: steps.report(docs, replies),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary",
    )
