"""Records with line breaks, read in splits of a few bytes, against Python's csv."""

import csv
import io
import random

import pytest

from clientela.sources.delimited import scan_losses, scan_table, write_table
from clientela.sources.records import whole_records
from clientela.sources.tables import TABLES

from helpers import plan

ALPHABET = ["a", "é", ";", "\n", "\r\n", '"', "\n\n", " ", "xyz", "", "\r"]


def _text(seed, rows, newline="\n"):
    rng = random.Random(seed)
    records = [["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 9))) for _ in range(2)] for _ in range(rows)]
    # The first column keeps rows from being blank lines.
    records = [[str(i), *values] for i, values in enumerate(records)]
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator=newline)
    writer.writerow(["KEY", "A", "B"])
    writer.writerows(records)
    return out.getvalue(), records


def _file(folder, text):
    (folder / TABLES["privacy"].file).write_bytes(text.encode())
    return str(folder)


@pytest.mark.parametrize("seed,split", [(0, 16), (1, 64), (2, 7), (3, 1 << 20), (4, 200)])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_splits_of_any_size_give_the_same_records(spark, settings, tmp_path, seed, split, newline):
    text, records = _text(seed, 60, newline)
    folder = _file(tmp_path, text.replace('"KEY";"A";"B"', "KEY;A;B"))
    settings(spark__sql__files__maxPartitionBytes=split, spark__sql__files__openCostInBytes=1)
    rows = scan_table(spark, folder, "privacy", multiline=True)
    want = sorted((k, a or None, b or None) for k, a, b in records)
    assert sorted(map(tuple, rows.collect())) == want
    tasks = spark.read.text(folder).rdd.getNumPartitions()
    assert tasks > 10 if split < 100 else tasks >= 1


def test_one_value_over_many_splits(spark, settings, tmp_path):
    long = "\n".join(f"line {i}; \"quoted\"" for i in range(300))
    text = 'KEY;A\n1;x\n2;"' + long.replace('"', '""') + '"\n3;y\n'
    settings(spark__sql__files__maxPartitionBytes=50, spark__sql__files__openCostInBytes=1)
    rows = scan_table(spark, _file(tmp_path, text), "privacy", multiline=True).collect()
    assert sorted(map(tuple, rows)) == [("1", "x"), ("2", long), ("3", "y")]


def test_several_files(spark, settings, tmp_path):
    folder = tmp_path / TABLES["privacy"].file
    folder.mkdir()
    want = []
    for n in range(5):
        text, records = _text(10 + n, 20)
        (folder / f"part-{n}.csv").write_bytes(text.replace('"KEY";"A";"B"', "KEY;A;B").encode())
        want += [(k, a or None, b or None) for k, a, b in records]
    settings(spark__sql__files__maxPartitionBytes=300, spark__sql__files__openCostInBytes=100)
    rows = scan_table(spark, str(tmp_path), "privacy", multiline=True).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("split", [10, 1 << 20])
def test_a_quote_that_stays_open_fails_or_is_counted(spark, settings, tmp_path, split):
    folder = _file(tmp_path, 'KEY;A\n1;"a\nb"\n2;"open\n3;x\n4;y\n')
    settings(spark__sql__files__maxPartitionBytes=split, spark__sql__files__openCostInBytes=1)
    with pytest.raises(Exception, match="a quoted value goes on"):
        scan_table(spark, folder, "privacy", multiline=True).collect()
    losses = scan_losses(spark, folder, "privacy", multiline=True).first()
    assert (losses.RECORDS, losses.OPEN_QUOTES) == (2, 1)


def test_files_without_records(spark, tmp_path):
    assert scan_table(spark, _file(tmp_path, "KEY;A\n"), "privacy", multiline=True).collect() == []
    assert scan_table(spark, _file(tmp_path, "KEY;A\n\n \n1;x"), "privacy", multiline=True).count() == 1
    with pytest.raises(ValueError, match="no header"):
        scan_table(spark, _file(tmp_path, ""), "privacy", multiline=True)


def test_lines_are_shuffled_by_split_once(spark, settings, tmp_path):
    text, _ = _text(3, 200)
    settings(spark__sql__autoBroadcastJoinThreshold=-1)
    records = whole_records(spark, _file(tmp_path, text) + "/" + TABLES["privacy"].file)
    records.collect()
    # One exchange carries the lines, the others read it again.
    assert plan(records).count("ReusedExchange") + plan(records).count("TableCacheQueryStage") >= 2


def test_written_tables_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a"b\n;c'), ("2", "\r\n x \n"), ("3", "plain"), ("4", None)], "KEY string, A string")
    write_table(rows.repartition(3), str(tmp_path), "privacy")
    back = scan_table(spark, str(tmp_path), "privacy", multiline=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
