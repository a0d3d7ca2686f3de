import random

import pytest
from conftest import write_related_csv
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from riskloom.errors import ValidationError
from riskloom.schema import Contract, WIDE_FEATURES, struct_of
from riskloom.sources import csv as source
from riskloom.sources import rows

LEDGER = Contract("ledger", struct_of("account long, balance double, closed int", "closed"))
NOTES = Contract("notes", struct_of("account long, note string"))


def put(folder, text, name="ledger.csv", encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_columns_may_come_in_any_order(spark, tmp_path):
    loaded = source.read_csv(spark, put(tmp_path, "closed,account,balance\n0,70,-3.25\n1,71,12\n1,72,0\n"), LEDGER)
    assert loaded.report["row_count"] == 3 and loaded.report["target_distribution"] == {0: 1, 1: 2}
    assert loaded.report["encoding"] == "utf-8" and loaded.report["missing_values"] == {}
    assert [tuple(r) for r in loaded.frame.select("account", "balance", "closed").orderBy("account").collect()] == [(70, -3.25, 0), (71, 12.0, 1), (72, 0.0, 1)]


def test_byte_order_mark_quotes_and_blank_lines(spark, tmp_path):
    loaded = source.read_csv(spark, put(tmp_path, '﻿account,note\r\n5,"x; ""y"", z"\r\n\r\n6,w\r\n'), NOTES)
    assert [r.note for r in loaded.frame.orderBy("account").collect()] == ['x; "y", z', "w"]


def test_windows_encoding(spark, tmp_path):
    loaded = source.read_csv(spark, put(tmp_path, "account,note\n9,naïve – 5 €\n", encoding="cp1252"), NOTES)
    assert loaded.report["encoding"] == "cp1252" and loaded.frame.first().note == "naïve – 5 €"
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b"account,note\n9,na\xefve \x90\n")
    with pytest.raises(ValidationError, match="neither"):
        source.read_csv(spark, str(bad), NOTES)


@pytest.mark.parametrize("text, told", [
    ("", "no header"),
    ("account,balance,closed\n", "0 rows where 1 to any number"),
    ("account,balance,closed\n70,1,0\n71,1\n", "1 row.s. with other than 3 fields"),
    ("account,balance,closed\n70,1,0\n71,1,0,0,0\n72,5\n", "2 row.s. with other than 3 fields"),
    ("account,balance,closed,owner,city\n70,1,0,a,b\n", "has undeclared 'owner', has undeclared 'city'"),
    ("account,closed\n70,0\n", "lacks 'balance'"),
    ("balance,owner\n70,0\n", "lacks 'account', lacks 'closed', has undeclared 'owner'"),
    ("account,balance,closed\n70,1,0\n71,1,5\n72,1,\n", "cells without value {'closed': 1}; 2 labels other than"),
    ("account,balance,closed\n70,n/a,0\n71,,1\n", "cells without value {'balance': 2}"),
    ("account,balance,closed\n70,ten,0\n", "no numbers {'balance': 1}"),
    ('account,balance,closed\n70,"1,0\n71,2,1\n', "never ends"),
    ("account,account,closed\n70,1,0\n", "repeats a column"),
])
def test_rejections_name_every_breach(spark, tmp_path, text, told):
    with pytest.raises(ValidationError, match=told):
        source.read_csv(spark, put(tmp_path, text), LEDGER)


def test_missing_path(spark, tmp_path):
    with pytest.raises(ValidationError, match="nothing to read"):
        source.read_csv(spark, str(tmp_path / "none.csv"), LEDGER)


def test_repeated_rows_are_reported_not_removed(spark, tmp_path):
    path = put(tmp_path, "account,balance,closed\n" + "70,4.5,0\n" * 4 + "71,4.5,1\n")
    loaded = source.read_csv(spark, path, LEDGER)
    assert loaded.report["duplicate_rows"] == 3 and loaded.frame.count() == 5
    with pytest.raises(ValidationError, match="3 repeated rows"):
        source.read_csv(spark, path, LEDGER, duplicate_policy="error")


def test_bounds_of_rows(spark, tmp_path):
    path = put(tmp_path, "account,balance,closed\n70,1,0\n71,2,1\n")
    for bounds, told in (((3, 3), "2 rows where 3 to 3"), ((0, 1), "2 rows where 0 to 1")):
        with pytest.raises(ValidationError, match=told):
            source.read_csv(spark, path, Contract("ledger", LEDGER.schema, rows=bounds))
    assert source.read_csv(spark, path, Contract("ledger", LEDGER.schema, rows=(2, 2))).report["row_count"] == 2


def test_discovery(spark, tmp_path):
    for place in ("p/q/open.csv", "p/shut.csv", "r/shut.csv"):
        put(tmp_path, "k\n7\n", place)
    assert source.discover_csv(spark, str(tmp_path), ["open.csv"])["open.csv"].endswith("p/q/open.csv")
    for names, told in ((["shut.csv"], "more than once"), (["open.csv", "void.csv"], r"absent below .*void.csv")):
        with pytest.raises(ValidationError, match=told):
            source.discover_csv(spark, str(tmp_path), names)
    with pytest.raises(ValidationError, match="no folder"):
        source.discover_csv(spark, str(tmp_path / "elsewhere"), ["open.csv"])


def test_related_tables_and_join(spark, tmp_path):
    write_related_csv(tmp_path)
    tables = source.read_related_tables(spark, str(tmp_path))
    assert len(tables) == 10 and all(t.report["row_count"] == 3 and not t.report["duplicate_rows"] for t in tables.values())
    assert tables["fraud_indicators"].report["target_distribution"] == {0: 2, 1: 1}
    assert source.load_reports(spark, tables).count() == 10
    joined, audits = source.read_transaction_table(spark, str(tmp_path))
    assert joined.count() == 3 and len(joined.columns) == 12 and audits.count() == 9


def test_wide_table(spark, tmp_path):
    line = lambda value: ",".join([str(value)] * 31)
    header = ",".join([*WIDE_FEATURES, "Class"])
    path = put(tmp_path, "\n".join([header, *map(line, (1, 0, 1, 0, 0))]) + "\n")
    loaded = source.read_wide_table(spark, path)
    assert loaded.report["row_count"] == 5 and loaded.report["duplicate_rows"] == 3
    assert loaded.report["target_distribution"] == {0: 3, 1: 2}
    source.check_wide_header(spark, path)
    with pytest.raises(ValidationError, match="another order"):
        source.read_wide_table(spark, put(tmp_path, ",".join(["Class", *WIDE_FEATURES]) + f"\n{line(0)}\n", "swapped.csv"))
    for text in ("Amount\n4\n", f"{header}\n", ""):
        with pytest.raises(ValidationError):
            source.check_wide_header(spark, put(tmp_path, text, "bad.csv"))


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in ',"\n\r') or cell == "" else cell


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_line_breaks_inside_quotes_however_files_are_cut(spark, tmp_path, block):
    rng = random.Random(block)
    parts = ["a", "b c", ",", '"', "\n", "\n\n", "é", '5" pipe', "x\r\ny", "end", ""]
    cells = [(str(i), "".join(rng.choices(parts, k=rng.randint(1, 9))).strip("\r") or "z") for i in range(300)] + [("300", 'long "' + "line\n" * 200)]
    text = "id,note\n" + "".join(f"{quoted(i)},{quoted(c)}\n" for i, c in cells)
    path = put(tmp_path, text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        blocks = rows.numbered_lines(rows.raw_lines(spark, path, "notes")).select("block").distinct().count()
        frame, _, names = source.read_text_cells(spark, path, "notes")
        got = sorted(((r.id, r.note) for r in frame.collect()), key=lambda r: int(r[0]))
        assert frame.where(F.col("_malformed").isNotNull()).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert names == ["id", "note"] and (blocks > 20) == (block == 64)
    assert got == [(i, c.replace("\r\n", "\n")) for i, c in cells] or got == cells


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_and_records_give_the_same_cells(spark, tmp_path, end):
    rows = ["k,t,u", '1,"a ""b"", c",x', "", "2,,", '3," padded ",5" pipe', "4,one too few", "5,a,b,one too many", '"6",,""']
    alone = put(tmp_path, end.join(rows) + end, "alone.csv")
    spanning = put(tmp_path, end.join([*rows, '7,"two\nlines",z']) + end, "spanning.csv")
    assert source._line_facts(source.raw_lines(spark, alone, "n"), "n")[1]
    assert not source._line_facts(source.raw_lines(spark, spanning, "n"), "n")[1]

    def cells(path):
        frame, _, names = source.read_text_cells(spark, path, "n")
        assert names == ["k", "t", "u"]
        return {r.k: (r.t, r.u, r._malformed is not None) for r in frame.collect()}

    assert cells(alone) == {k: v for k, v in cells(spanning).items() if k != "7"}
    assert cells(alone)["1"] == ('a "b", c', "x", False) and cells(alone)["4"][2] and cells(alone)["5"][2]


def test_folders_named_like_a_file_count_as_one(spark, tmp_path):
    spark.range(40).repartition(4).write.option("header", True).csv(str(tmp_path / "q" / "open.csv"))
    put(tmp_path, "k\n7\n", "shut.csv")
    found = source.discover_csv(spark, str(tmp_path), ["open.csv", "shut.csv"])
    assert found["open.csv"].endswith("q/open.csv") and source.read_text_cells(spark, found["open.csv"], "open")[0].count() == 40
    put(tmp_path, "k\n7\n", "r/open.csv")
    with pytest.raises(ValidationError, match="more than once"):
        source.discover_csv(spark, str(tmp_path), ["open.csv"])


def test_cells_are_made_numbers_once(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, path, **options):
        plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, path, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    loaded = source.read_csv(spark, put(tmp_path, "account,balance,closed\n70,-3.25,0\n+71,12, 1.00\n72.0,1e3,0\n"), LEDGER)
    assert sorted(tuple(r) for r in loaded.frame.collect()) == [(70, -3.25, 0), (71, 12.0, 1), (72, 1000.0, 0)]
    assert plans[0].count("RLIKE(balance") == 1


def test_lines_of_long_records_are_marked_once(spark, tmp_path, monkeypatch):
    seen, numbered = [], rows.numbered_lines
    monkeypatch.setattr(rows, "numbered_lines", lambda *given: numbered(*given).withColumn("value", F.udf(lambda v: (open(tmp_path / "seen", "a").write("."), v)[1])("value")))
    path = put(tmp_path, 'account,note\n70,"a\nb"\n71,c\n', "long.csv")
    frame, _, names = source.read_text_cells(spark, path, "notes")
    for _ in range(3):
        seen.append(sorted(tuple(r)[:2] for r in frame.collect()))
    assert names == ["account", "note"] and seen == [[("70", "a\nb"), ("71", "c")]] * 3
    assert (tmp_path / "seen").stat().st_size <= 2 * 4  # four lines, read for the marks and perhaps for the counts


def test_a_header_may_span_lines(spark, tmp_path):
    path = put(tmp_path, '"acc\nount",note\n70,"a\nb"\n', "wide.csv")
    frame, _, names = source.read_text_cells(spark, path, "notes")
    assert names == ["acc\nount", "note"] and [tuple(r)[:2] for r in frame.collect()] == [("70", "a\nb")]
