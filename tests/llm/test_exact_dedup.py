from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clientela.llm.exact_dedup import first_of_each, text_groups


def literal(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    result = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        result += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(result, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("frame", ["odd", "clashing", "empty"])
def test_odd_rows(request, frame):
    docs = request.getfixturevalue(frame)
    got = text_groups(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "digest"]
    assert rows_of(got) == literal([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_hot_text_and_equal_digests(make):
    rows = [(i, f"text {i % 7}" if i % 3 else "hot") for i in range(3000)]
    docs = make(rows).repartition(17)
    assert rows_of(text_groups(docs)) == literal(rows)
    # Texts that share a digest stay apart.
    weak = text_groups(docs, digest=lambda text: F.lit("same"))
    assert [r[:4] for r in rows_of(weak)] == [r[:4] for r in literal(rows)]


def test_first_of_each_keeps_columns_and_ids(clashing, make):
    kept = first_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 2, 4, 5, 7, 8, 9]
    # One id with two texts loses neither for the other.
    again = first_of_each(make([(1, "a"), (2, "b"), (2, "a"), (2, "c")]))
    assert sorted(r["text"] for r in again.collect()) == ["a", "b", "c"]
