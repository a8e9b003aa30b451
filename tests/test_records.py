"""Numbered scans: record and line numbers as a plain reader gives them, however the files are split."""

import csv
import io
import json
import random

import pytest

from scoregate.sources import files, records

SCHEMA = "a string, b int, c string"


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "0b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def cell(rng):
    text = "".join(rng.choice(("a", "é", "日", " ", ",", '"', "\n", "\r\n", "x" * 30)) for _ in range(rng.randrange(0, 6)))
    return '"' + text.replace('"', '""') + '"' if set(text) & set(',"\n\r') or rng.random() < 0.3 else text


def plain(raw):
    """(number, line, cells) of each record by Python's reader, empty lines left out."""
    reader = csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))
    out, number, line = [], 0, 1
    for row in reader:
        if row:
            number += 1
            out.append((number, line, row))
        line = reader.line_num + 1
    return out


def test_numbers_equal_a_plain_readers(spark, tmp_path, small_splits):
    rng = random.Random(7)
    want = {}
    for k in range(12):
        end = rng.choice(("\n", "\r\n"))
        body = ["a,b,c"]
        for _ in range(rng.randrange(0, 60)):
            body.append("" if rng.random() < 0.1 else f"{cell(rng)},{rng.randrange(100)},{cell(rng)}")
        raw = ("﻿" if k % 3 == 0 else "") + end.join(body) + (end if k % 2 else "")
        (tmp_path / f"f{k}.csv").write_bytes(raw.encode())
        want[f"f{k}.csv"] = plain(raw.encode())
    (tmp_path / "none.csv").write_bytes(b"")
    path = f"file://{tmp_path}"
    found = records.numbered_records(spark, path)
    assert found.rdd.getNumPartitions() > 1 and spark.read.text(path).rdd.getNumPartitions() > 20
    got = {}
    for r in found.collect():
        assert r["reason"] is None
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["source_row"], r["line"], next(csv.reader(io.StringIO(r["text"], newline="")))))
    assert {k: sorted(v) for k, v in got.items()} == want
    rows = {(r["file"].rsplit("/", 1)[-1], r["source_row"]): (r["a"], r["b"], r["c"], r["reason"]) for r in records.csv_records(spark, path, SCHEMA).collect()}
    assert rows.keys() == {(f, n) for f, own in want.items() for n, _, _ in own if n > 1}
    for f, own in want.items():
        for n, _, (a, b, c) in own[1:]:
            assert (rows[f, n][0] or "", rows[f, n][1], rows[f, n][2] or "", rows[f, n][3]) == (a, int(b), c, None), (f, n)


def test_broken_records_are_rows(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(records, "MOST_LINES", 3)
    (tmp_path / "a.csv").write_text('a,b,c\n1,2,3\n\nx,no,3\nx,1\nx,1,2,3\n"l\nl\nl\nl",1,2\nok,5,"l\nl"\n"open,1,2\nx,1,2\n')
    (tmp_path / "b.csv").write_text("a,c,b\n1,2,3\n")
    got = sorted((r["file"][-5:], r["source_row"], r["line"], r["reason"]) for r in records.csv_records(spark, f"file://{tmp_path}", SCHEMA).collect())
    assert got == [
        ("a.csv", 2, 2, None), ("a.csv", 3, 4, "malformed"), ("a.csv", 4, 5, "malformed"), ("a.csv", 5, 6, "malformed"), ("a.csv", 6, 7, "quote_not_closed"),
        ("a.csv", 7, 11, None), ("a.csv", 8, 13, "quote_not_closed"), ("b.csv", 1, 1, "header"), ("b.csv", 2, 2, None),
    ]


def test_json_lines(spark, tmp_path, small_splits):
    lines = [json.dumps({"k": i, "t": "x" * (i % 50)}) for i in range(80)]
    lines[10], lines[40], lines[70] = "{broken", "[1, 2]", ""
    (tmp_path / "j.jsonl").write_text("\n".join(lines) + "\n")
    bad = sorted((r["line"], r["reason"]) for r in records.json_records(spark, f"file://{tmp_path}").collect() if r["reason"])
    assert bad == [(11, "not_json"), (41, "not_an_object"), (71, "not_json")]
    with pytest.raises(ValueError, match="j.jsonl:11 not_json; j.jsonl:41 not_an_object; j.jsonl:71 not_json"):
        files.read_jsonl(spark, f"file://{tmp_path}", "k long, t string", located=True)


def test_split_table(spark, tmp_path):
    head = "object,split,label,image,mask\n"
    (tmp_path / "s.csv").write_text(head + "a,train,normal,a/1,\nb,train,normal,a/2,\na,test,anomaly,a/3,a/m\n")
    path = f"file://{tmp_path}/s.csv"
    assert sorted(r["image"] for r in files.read_split(spark, path, "a").collect()) == ["a/1", "a/3"]  # b's row under a is b's
    for body, reason in (
        ("a,train,normal,b/1,\n", "outside_category at line 2"),
        ("a,train,normal,a/1,\na,test,normal,a/1,\n", "repeated_path at line 3"),
        ("a,train,normal,../a/1,\n", "unsafe_path"),
        ("a,train\n", "malformed at line 2")
    ):
        (tmp_path / "t.csv").write_text(head + body)
        with pytest.raises(ValueError, match=reason):
            files.read_split(spark, f"file://{tmp_path}/t.csv", "a")
    (tmp_path / "u.csv").write_text(head + "a,train,anomaly,a/1,\na,test,other,a/2,\na,dev,normal,a/3,\nb,dev,x,y,\n")
    rows = records.csv_records(spark, f"file://{tmp_path}/u.csv", files.SPLIT)
    assert sorted(
        (r["source_row"], r["reason"]) for r in records.split_scan_violations(rows, "a").collect()
    ) == [(2, "train_not_normal"), (3, "test_label_unknown"), (4, "unknown_split")]
    assert [r["reason"] for r in records.split_scan_violations(rows, "c").collect()] == ["no_rows"]
