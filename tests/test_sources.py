"""Delimited text: tokens, decimal commas, leading zeros, dates, sink."""

from datetime import date, datetime
from types import SimpleNamespace

import pytest

from clientela.functions.datetimes import parse_iso
from clientela.sources import star_schema as star
from clientela.sources.delimited import read_csv, scan_losses, scan_table, write_csv, write_table
from clientela.sources.scratch import scratch_dir, stored
from clientela.sources.tables import TABLES

from helpers import sorted_rows


def _file(folder, table, text):
    (folder / TABLES[table].file).write_text(text)
    return str(folder)


def test_address_keeps_leading_zeros_and_the_province_na(spark, tmp_path):
    folder = _file(
        tmp_path, "address",
        "ID_ADDRESS;CAP;PRV;REGION\n1;00100;NA;LAZIO\n2;;RM;\n",
    )
    df = scan_table(spark, folder, "address")
    assert df.dtypes == [
        ("ID_ADDRESS", "bigint"), ("CAP", "string"), ("PRV", "string"), ("REGION", "string"),
    ]
    assert [tuple(r) for r in df.collect()] == [(1, "00100", "NA", "LAZIO"), (2, None, "RM", None)]


@pytest.mark.parametrize("table", [t for t in TABLES if t != "address"])
def test_na_is_missing_in_all_other_tables(spark, tmp_path, table):
    folder = _file(tmp_path, table, 'ANY;OTHER\nNA;x\n"NA";\n')
    assert [tuple(r) for r in scan_table(spark, folder, table).collect()] == [
        (None, "x"), (None, None),
    ]


def test_decimal_comma_and_unknown_columns(spark, tmp_path):
    folder = _file(
        tmp_path, "ticket",
        "ID_TICKET;ID_CLI;TIC_DATE;AMOUNT;SHOP\n1;7;2019-01-02;1,5;A\n2;8;NA;2;NA\n",
    )
    assert [tuple(r) for r in scan_table(spark, folder, "ticket").collect()] == [
        (1, 7, date(2019, 1, 2), 1.5, "A"), (2, 8, None, 2.0, None),
    ]


BAD = {
    "unreadable number": ("4x;8;2019-01-02;2;A", "column ID_TICKET is no bigint: 4x", (None, 8, date(2019, 1, 2), 2.0, "A")),
    "unreadable date": ("4;8;bad;2;A", "column TIC_DATE is no date: bad", (4, 8, None, 2.0, "A")),
    "surplus field": ("4;8;2019-01-02;2;A;more", "more fields than the header: more", (4, 8, date(2019, 1, 2), 2.0, "A")),
}


@pytest.mark.parametrize("line,message,lenient", BAD.values(), ids=BAD.keys())
def test_what_cannot_be_kept_fails_loudly_or_is_counted(spark, tmp_path, line, message, lenient):
    text = f"ID_TICKET;ID_CLI;TIC_DATE;AMOUNT;SHOP\n1;7;2019-01-02;1,5;A\n{line}\n"
    folder = _file(tmp_path, "ticket", text)
    with pytest.raises(Exception, match=message):
        scan_table(spark, folder, "ticket").collect()
    rows = scan_table(spark, folder, "ticket", strict=False).collect()
    assert [tuple(r) for r in rows] == [(1, 7, date(2019, 1, 2), 1.5, "A"), lenient]
    losses = scan_losses(spark, folder, "ticket").first()
    surplus = int("more" in line)
    assert tuple(losses) == ("ticket", 2, surplus, 0, 1 - surplus)


def test_a_quoted_line_break_fails_unless_it_is_asked_for(spark, tmp_path):
    folder = _file(tmp_path, "account", 'ID_ADDRESS;NOTE\n1;"two\nlines"\n2;"one ""line"""\n')
    with pytest.raises(Exception, match="a quoted value goes on in the next line"):
        scan_table(spark, folder, "account").collect()
    with pytest.raises(Exception, match="a quoted value goes on in the next line"):
        scan_table(spark, folder, "account").count()
    assert scan_losses(spark, folder, "account").first().OPEN_QUOTES == 2
    rows = scan_table(spark, folder, "account", multiline=True).collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, 'one "line"')]
    assert scan_losses(spark, folder, "account", multiline=True).first().RECORDS == 2


def test_clean_scans_lose_nothing(spark, sf_dir, tmp_path):
    rows = star.address(spark, sf_dir)
    write_table(rows, str(tmp_path), "address")
    assert tuple(scan_losses(spark, str(tmp_path), "address").first()) == ("address", rows.count(), 0, 0, 0)


def test_columns_are_found_by_name_in_any_order(spark, tmp_path):
    folder = _file(tmp_path, "campaign", "TYP_CAMP;CHANNEL_CAMP;ID_CAMP\nPROMO;EMAIL;3\n")
    assert scan_table(spark, folder, "campaign").first().asDict() == {
        "TYP_CAMP": "PROMO", "CHANNEL_CAMP": "EMAIL", "ID_CAMP": 3,
    }


def test_quoted_separators_and_quotes(spark, tmp_path):
    folder = _file(tmp_path, "privacy", 'A;B\n"x;y";"say ""hi"""\n')
    assert tuple(scan_table(spark, folder, "privacy").first()) == ("x;y", 'say "hi"')


def test_short_rows_are_filled_up(spark, tmp_path):
    folder = _file(tmp_path, "account", "ID_ADDRESS;A;B\n1;x\n2\n")
    assert [tuple(r) for r in scan_table(spark, folder, "account").collect()] == [
        (1, "x", None), (2, None, None),
    ]


def test_iso_text(spark):
    texts = [
        "2019-01-02T03:04:05.123Z", "2019-1-2T3:4:5", " 2019-01-02T03:04:05+02:00", "bad", None,
        "2019-02-30T00:00:00", "2019-01-02", "2019-01-02 03:04:05",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    good = datetime(2019, 1, 2, 3, 4, 5)
    assert [r[0] for r in df.select(parse_iso("t")).collect()] == [
        good, good, good, None, None, None, None, None,
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_hour_and_date_do_not_depend_on_the_session_zone(spark, settings, zone):
    from clientela.operators.events import type_events

    from helpers import event_frame

    settings(spark__sql__session__timeZone=zone)
    out = type_events(event_frame(spark, [(1, 1, 1, 1, "S", "2019-03-31T23:30:00")])).first()
    assert (out.EVENT_HOUR, out.EVENT_DATE) == (23, date(2019, 3, 31))


@pytest.mark.parametrize(
    "table", ["fidelity", "account", "address", "campaign", "event", "ticket"]
)
def test_round_trip_of_whole_tables(spark, sf_dir, tmp_path, table):
    rows = getattr(star, table)(spark, sf_dir)
    write_table(rows, str(tmp_path), table)
    back = scan_table(spark, str(tmp_path), table)
    assert back.dtypes == rows.dtypes
    assert sorted_rows(back) == sorted_rows(rows)


def test_sink_has_a_header_commas_and_no_row_numbers(spark, tmp_path):
    df = spark.createDataFrame([("LAZIO", 2, 0.5), (None, 2, 0.5)], "R string, N bigint, P double")
    write_csv(df.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().splitlines() == ["R,N,P", "LAZIO,2,0.5", "NA,2,0.5"]
    back = read_csv(spark, str(tmp_path / "out"), "R string, N bigint, P double")
    assert sorted_rows(back) == sorted_rows(df)


def test_scratch_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_dir(spark), scratch_dir(spark)
    assert a != b and a.startswith(shared) and b.startswith(shared)


def test_scratch_without_a_shared_folder_is_on_the_default_file_system():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default))
    assert scratch_dir(session).startswith("/tmp/clientela-scratch/")


def test_stored_cuts_the_lineage(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "x")
    table = stored(df, str(tmp_path / "t"))
    assert sorted_rows(table) == sorted_rows(df)
    assert "Range" not in table._jdf.queryExecution().toString()
