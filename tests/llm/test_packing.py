from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from clientela.llm import packing
from clientela.llm.packing import best_fit, pack_documents, packing_plan, reduced
from clientela.llm.queries import tokenizer_path
from clientela.llm.tokens import WordTokenizer


def encoded(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(docs, capacity):
    """Pieces are the documents' ids, and sequences are full without gaps."""
    rows = pack_documents(docs, tokenizer_path(), capacity).collect()
    want = Counter()
    for i, text in docs.select("doc_id", "text").collect():
        ids = encoded(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want[i, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return rows, len(sequences)


@pytest.mark.parametrize("frame", ["odd", "clashing", "empty"])
@pytest.mark.parametrize("capacity", [7, 2048])
def test_odd_rows(request, frame, capacity):
    check(request.getfixturevalue(frame), capacity)


def test_hot_length_over_several_salts(make, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 40)
    rows = [(i, "a b c") for i in range(300)] + [(i, "word " * (i % 50)) for i in range(300, 500)]
    _, sequences = check(make(rows), 64)
    tokens = 300 * 4 + sum(i % 50 + 1 for i in range(300, 500))
    assert sequences == -(-tokens // 64)


def best(sizes, capacity):
    """Fewest bins, by trying all ways for the largest piece first."""
    sizes = sorted(sizes, reverse=True)
    limit = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= limit[0]:
            return
        if i == len(sizes):
            limit[0] = len(rooms)
            return
        for n in {room: k for k, room in enumerate(rooms)}.values():
            if rooms[n] >= sizes[i]:
                place(i + 1, rooms[:n] + [rooms[n] - sizes[i]] + rooms[n + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return limit[0]


def test_reduction_keeps_a_best_packing():
    generator = random.Random(2)
    fixed_some = 0
    for _ in range(400):
        sizes = [generator.randint(1, 20) for _ in range(generator.randint(1, 9))]
        fixed, left = reduced(Counter(sizes), 20)
        held = Counter()
        for pattern in fixed:
            assert sum(a * n for a, n in pattern.holds) <= 20
            for length, each in pattern.holds:
                held[length] += each * pattern.sequences
        assert held + left == Counter(sizes)
        used = sum(p.sequences for p in fixed)
        fixed_some += used > 0
        assert used + best(left.elements(), 20) == best(sizes, 20)
    assert fixed_some > 300


def test_best_fit_equals_one_by_one():
    generator = random.Random(3)
    for _ in range(300):
        sizes = [generator.randint(1, 30) for _ in range(generator.randint(0, 60))]
        rooms = []
        for size in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(30 - size)
        plan = best_fit(Counter(sizes), 30)
        got = [30 - sum(a * n for a, n in p.holds) for p in plan for _ in range(p.sequences)]
        assert sorted(got) == sorted(rooms)


def test_plan_of_many_pieces_is_small():
    counts = {length: 10**9 + length for length in range(1, 2049)}
    plan = packing_plan(counts)
    held = Counter()
    for pattern in plan:
        assert sum(a * n for a, n in pattern.holds) <= 2048
        for length, each in pattern.holds:
            held[length] += each * pattern.sequences
    assert held == Counter(counts)
    assert len(plan) < 20_000


def test_word_by_word_equals_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [
        "Don't stop, it's we're I'LL 'sample they'd", "ÀÉÎ straße ŒUVRE Σίσυφος İstanbul ﬁne ½ ①", "é ́a á́b ",
        "x!!y ## a-b_c (d) <|endoftext|> <|startoftext|>a", "tabs\tand\x0bfeeds\x0c\r\n  end ", "nbsp em \x1cfs\x85nel",
        "日本語 テキスト 한국어 العربية 🙂🙂 a🙂b", "3.14 1,000 v2 ´`~^|{}[]\\/\"'", "", " ", "÷×ß ðþ ÿÿ",
    ]
    generator = random.Random(1)
    letters = "abcXYZ éÜß'.,!-’\n\t0😀́Ǆ"
    texts += ["".join(generator.choices(letters, k=generator.randrange(60))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    tokenizer = WordTokenizer(tokenizer_path())
    for _ in range(2):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in tokenizer.encode(raw)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
