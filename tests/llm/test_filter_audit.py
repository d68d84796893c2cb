"""Filter interactions against running every order over every document."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

from clientela.llm import filter_audit as audit

from .conftest import DOCUMENT

LABELS = "doc_id long, quality int, toxic int"


def literal_failures(rows):
    """Per row of (doc_id, text) the letters of the filters it fails."""
    failing = []
    for doc_id, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t in rows)
        failing.append({
            letter for letter, fails in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), earlier,
            ), strict=True) if fails
        })
    return failing


def literal(rows, parts, good=(), toxic=()):
    failing = literal_failures(rows)
    result = {}
    for part in set(parts):
        mine = [n for n in range(len(rows)) if parts[n] == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                out = [n for n in left if letter in failing[n]]
                gone = [n for n in mine if n not in left]
                left = [n for n in left if n not in out]
                result[part, "".join(order), step] = [
                    len(left), len(out), sum(letter in failing[n] for n in gone),
                    sum(failing[n] == {letter} for n in mine),
                    sum(rows[n][0] in good for n in out), sum(rows[n][0] in toxic for n in out),
                ]
    for (part, order, step), row in result.items():
        letter = order[step - 1]
        row.append(sum(r[1] for (p, o, s), r in result.items() if p == part and o[s - 1] == letter))
    return result


def got(frame):
    return {tuple(r)[:3]: list(r)[3:] for r in frame.collect()}


LONG = " ".join(f"w{i}" for i in range(220))
TEXTS = [
    LONG, LONG, LONG + " #", "short", "short", "Short & Bad", None, "", " \t ", "a a a a", LONG.upper(), "w " * 250, "Ünïcode ÀÉ",
]


def test_all_orders_against_running_them(spark):
    rows = list(enumerate(TEXTS)) + [(3, "short"), (None, "short"), (None, None)]
    parts = ["x", "y", None][: 3] * 6
    frame = [(i, t, "en", parts[n], 0) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(frame, DOCUMENT).repartition(4)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 0, 0), (3, None, 1), (5, 0, 1), (None, 1, 1), (99, 1, 1)], LABELS)
    want = literal(rows, [p or "" for p in parts[: len(rows)]], good={0, 1}, toxic={1, 3, 5})
    result = audit.audit_filters(docs, labels)
    assert got(result) == want and len(want) == 3 * 600


def test_null_and_empty_parts_are_one(spark):
    docs = spark.createDataFrame([(1, "a", "", None, 1), (2, "b", "", "", 1)], DOCUMENT)
    result = audit.audit_filters(docs, spark.createDataFrame([], LABELS))
    assert {(r["part"], r["kept"] + r["removed"]) for r in result.where("step = 1").collect()} == {("", 2)}


def test_odd_rows_clashing_names_and_no_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([], LABELS)
    plain = audit.audit_filters(odd, labels)
    assert got(plain) == got(audit.audit_filters(clashing.withColumn("part", clashing["doc_id"]).withColumn("first", clashing["doc_id"]).withColumn("failing", clashing["doc_id"]), labels))
    assert plain.count() == 1800
    nothing = audit.audit_filters(empty, labels)
    assert nothing.count() == 0 and nothing.dtypes == plain.dtypes


def test_one_text_in_most_rows(spark, make):
    rows = [(i, "same" if i % 3 else f"other {i}") for i in range(3000)]
    marked = audit.failures(make(rows).repartition(16))
    assert marked.where(f"failing >= {1 << 4}").count() == sum(i % 3 > 0 for i in range(3000)) - 1
    assert marked.count() == 3000


@pytest.mark.parametrize("n,groups", [(0, 1), (1, 1), (2, 2), (7, 3), (1000, 1), (1000, 17), (4099, 4099)])
def test_positional_popcounts(n, groups):
    rng = np.random.default_rng(n + groups)
    words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    group = rng.integers(0, groups, n)
    want = np.zeros((groups, 32), int)
    for word, g in zip(words.tolist(), group.tolist(), strict=True):
        want[g] += [word >> bit & 1 for bit in range(32)]
    assert (audit.positional_popcounts(words, group, groups) == want).all()


def test_truth_table():
    table = audit.truth_table(5)
    assert len(table) == 32 and table[0] == 0xFFFFFFFF and table[31] == 1
    for failed in range(32):
        assert [int(table[failed]) >> s & 1 for s in range(32)] == [int(failed & s == 0) for s in range(32)]
    assert audit.truth_table(2).tolist() == [15, 5, 3, 1]


def test_fewer_filters(spark):
    marked = spark.createDataFrame(
        [("p", 0, True, False), ("p", 1, False, False), ("p", 3, True, True)], "part string, failing int, good boolean, toxic boolean"
    )
    row = audit.subset_survivors(marked, 2).first()
    assert row["documents"] == [3, 1, 2, 1] and row["good"] == [2, 1, 1, 1] and row["toxic"] == [1, 0, 0, 0]
    steps = {tuple(r)[:3]: list(r)[3:5] for r in audit.interactions(audit.subset_survivors(marked, 2), "XY").collect()}
    assert steps == {("p", "XY", 1): [1, 2], ("p", "XY", 2): [1, 0], ("p", "YX", 1): [2, 1], ("p", "YX", 2): [1, 1]}
