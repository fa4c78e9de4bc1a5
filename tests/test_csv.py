import csv
import io
import logging
import random

import pytest

from quarrymill.sources import files, records


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{folder}/{name}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_each_file_has_its_own_head(spark, tmp_path, caplog):
    paths = [
        put(tmp_path, "a.csv", "order_id,product_name,note\n1,apple,x\n2,pear,\n"), put(tmp_path, "b.csv", "product_name;order_id\nplum;3\n"), put(tmp_path, "c.tsv", "﻿order_id\tproduct_name\n4\tcafé\n"),
        put(tmp_path, "d.csv", "order_id,product_name\n5,café €\n".encode("cp1252")), put(tmp_path, "e.csv", b""), f"file://{tmp_path}/none.csv", put(tmp_path, "f.parquet", b"x"),
    ]
    with caplog.at_level(logging.WARNING):
        got = files.ingest(spark, paths, with_path=True)
    assert got.rows.columns == ["order_id", "product_name", "note", "source_file"]
    assert rows(got.rows.drop("source_file")) == [("1", "apple", "x"), ("2", "pear", None), ("3", "plum", None), ("4", "café", None), ("5", "café €", None)]
    assert {r.source_file.rsplit("/", 1)[-1] for r in got.rows.filter("order_id = 3").collect()} == {"b.csv"}
    assert sorted(p.rsplit("/", 1)[-1] for p in got.skipped) == ["e.csv", "f.parquet", "none.csv"] and "none.csv" in caplog.text
    with pytest.raises(ValueError, match="no file can be read"):
        files.ingest(spark, paths[4:])


def test_repeated_and_odd_names(spark, tmp_path):
    df = files.read_sales_csv(spark, put(tmp_path, "a.csv", "x,x,,a.b,c`d\n1,2,3,4,5\n"))
    assert df.columns == ["x", "x.1", "column_2", "a.b", "c`d"] and rows(df) == [("1", "2", "3", "4", "5")]


def test_figures_come_from_the_one_scan(spark, tmp_path):
    data = 'a,b\n1,"x\ny"\n2,\n\n3,4,5\n"6","q ""r"" s"\n7\n"8","\n\n"\na,b\n'
    got = files.ingest(spark, put(tmp_path, "a.csv", data))
    plan = got.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 2  # whole records, and fragments of block boundaries
    df, stats = files.timed_ingestion(spark, f"file://{tmp_path}/a.csv")
    assert rows(df) == [("1", "x\ny"), ("2", None), ("6", 'q "r" s'), ("8", "\n\n")]
    assert (stats["rows"], stats["dropped"], stats["nulls"], stats["success_rate"]) == (4, 2, {"a": 0, "b": 1}, 100.0 * 4 / 6)
    plain, stats = files.timed_ingestion(spark, put(tmp_path, "b.csv", "a,b\n1,2\n3,4,5\n6,7\n"))
    assert plain._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1 and "ArrowEvalPython" not in plain._jdf.queryExecution().executedPlan().toString()
    assert (stats["rows"], stats["dropped"]) == (2, 1)


def test_folders_and_given_delimiter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.csv", "a|b,c\n1|2,3\n")
    put(tmp_path / "in", "b.csv", "b,c|a\n5|4\n")
    put(tmp_path / "in", "_hidden.csv", "z\n1\n")
    assert rows(files.read_sales_csv(spark, f"file://{tmp_path}/in", delimiter="|")) == [("1", "2,3"), ("4", "5")]


@pytest.mark.parametrize("line", ['a,"b', 'a,b"c', '"a"b",c', '"a""', '"a"""', '""', '"",", ', "", 'x"', '"', ',"', ',""",', 'a,"b"c,"d', '"x","y",z"', '""""'])
def test_states_of_lines(line):
    quotes = records.Quotes(",")

    def brute(inside):
        """Character by character."""
        state, i = "in" if inside else "start", 0
        while i < len(line):
            c = line[i]
            if state == "in":
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    state = "rest"
            elif c == ",":
                state = "start"
            else:
                state = "in" if state == "start" and c == '"' else "rest"
            i += 1
        return state == "in"

    for inside in (False, True):
        assert quotes.after(line.encode(), inside) == brute(inside)


def test_blocks_that_start_inside_quotes(spark, tmp_path):
    r = random.Random(5)
    want = [(str(i), r.choice(["plain", "", 'say "hi"', "two\nlines", "a,b", "\n" * 7 + "x", '5" wide', '"\n"', "long \n" * r.randrange(60)]), "end") for i in range(900)]
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator="\n")
    w.writerow(("id", 'head "two\nlines"', "z"))
    w.writerows(want)
    path = put(tmp_path, "big.csv", out.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.read_sales_csv(spark, path)
        assert df.rdd.getNumPartitions() > 30 and df.columns[1] == 'head "two\nlines"'
        assert rows(df) == sorted(((a, b or None, c) for a, b, c in want), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_quote_without_an_end(spark, tmp_path):
    got = files.ingest(spark, put(tmp_path, "a.csv", 'a,b\n1,2\n3,"4\n5,6\n'))
    assert rows(got.rows) == [("1", "2"), ("3", "4\n5,6")]


def test_delimiters():
    assert files.detect_delimiter('note;type;id\n"said ""a"",\nx, y, z";b;1\n') == ";" and files.detect_delimiter("one\n1\n2\n") == "," and files.detect_delimiter("a\tb\n1\t2\n") == "\t" and files.detect_delimiter("") == ","
