import csv
import io
import os
import random

import pytest

from gradus.sources import delimited, readers

MAPPING = {"query_id": "id", "document_ids": "docs"}


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def parsed(spark, path):
    rows, issues = delimited.table(spark, path)
    return [r.fields for r in rows.orderBy("line", "nth").collect()], sorted((r.code, r.message) for r in issues.collect())


def test_records_in_blocks_against_the_standard_parser(spark, tmp_path):
    """Blocks of a few bytes, so that quoted fields span several of them."""
    draw = random.Random(2)
    pieces = ["a", "b,", ",", "\n", "\r\n", '"', '""', "é", " ", "x" * 30]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "40")
        for n in range(4):
            rows = [["".join(draw.choice(pieces) for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(1, 4))] for _ in range(draw.randint(1, 40))]
            out = io.StringIO(newline="")
            csv.writer(out, lineterminator=draw.choice(["\n", "\r\n"]), quoting=draw.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL])).writerows(rows)
            text = out.getvalue()
            path = put(tmp_path / f"{n}.csv", text)
            want = [r for r in csv.reader(io.StringIO(text, newline=""), strict=True) if r]
            assert parsed(spark, path) == (want, [])
            if len(text) > 200:
                assert spark.read.text(path).rdd.getNumPartitions() > 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_quotes_inside_plain_fields(spark, tmp_path):
    text = 'id,docs\na"b,c"d\n"x\ny",z\n,""\n"""q""",\n'
    assert parsed(spark, put(tmp_path / "a.csv", text)) == ([r for r in csv.reader(io.StringIO(text, newline=""), strict=True)], [])


def test_broken_records(spark, tmp_path):
    assert parsed(spark, put(tmp_path / "a.csv", 'id,docs\n"a"b,c\n1,2\n')) == ([["id", "docs"], ["1", "2"]], [("INVALID_CSV", "line 2")])
    assert parsed(spark, put(tmp_path / "b.csv", 'id,docs\n1,2\n3,"open\nmore\n'))[1] == [("INVALID_CSV", "line 3")]
    assert parsed(spark, put(tmp_path / "c.csv", b"id,docs\n1,\xff\n2,b\n")) == ([["id", "docs"], ["2", "b"]], [("INVALID_UTF8", "line 2")])


def test_mapped_records(spark, tmp_path):
    text = '﻿\r\n id , docs,more\r\n1,"a| b ||c",x\r\n"2\n",,\r\n\r\n 3 ,"d|\ne",y\r\n'
    records, issues = readers.csv_records(spark, put(tmp_path / "x.csv", text), "predictions", MAPPING)
    assert {r.query_id: r.retrieved for r in records.collect()} == {"1": ["a", "b", "c"], "2\n".strip(): [], "3": ["d", "\ne".strip()]} and not issues.count()


def test_a_case_for_each_code(spark, tmp_path):
    at = lambda name, data: put(tmp_path / name, data)
    fine = at("fine.csv", "id,docs\n1,a\n")
    os.mkdir(tmp_path / "folder.csv")
    at_once = [
        ("UNSUPPORTED_KIND", fine, "other", MAPPING), ("INVALID_MAPPING", fine, "predictions", {"query_id": "id"}), ("INVALID_MAPPING", fine, "predictions", {"query_id": "id", "document_ids": " id "}),
        ("UNSUPPORTED_FORMAT", at("x.txt", "id,docs\n1,a\n"), "predictions", MAPPING), ("INVALID_REFERENCE_PATH", "fine.csv", "predictions", MAPPING), ("INVALID_REFERENCE_PATH", "//host/fine.csv", "predictions", MAPPING),
        ("NOT_A_FILE", str(tmp_path / "folder.csv"), "predictions", MAPPING), ("UNREADABLE_INPUT", str(tmp_path / "none.csv"), "predictions", MAPPING), ("EMPTY_INPUT", at("e.csv", ""), "predictions", MAPPING),
        ("EMPTY_INPUT", at("f.csv", "\n \n".replace(" ", "")), "predictions", MAPPING), ("EMPTY_INPUT", at("g.csv", "id,docs\n"), "predictions", MAPPING), ("DUPLICATE_HEADERS", at("h.csv", "id, id,docs\n1,2,a\n"), "predictions", MAPPING),
        ("DUPLICATE_HEADERS", at("i.csv", "id,,docs\n1,2,a\n"), "predictions", MAPPING), ("MISSING_COLUMN", at("j.csv", "id,other\n1,a\n"), "predictions", MAPPING),
    ]
    for code, path, kind, mapping in at_once:
        with pytest.raises(readers.InputError) as e:
            readers.csv_records(spark, path, kind, mapping)
        assert e.value.code == code, path
    with pytest.raises(readers.InputError, match="INPUT_TOO_LARGE"):
        readers.csv_records(spark, fine, "predictions", MAPPING, most_bytes=5)
    found = [
        ("INVALID_UTF8", b"id,docs\n1,\xff\n2,b\n"), ("INVALID_CSV", 'id,docs\n"a"b,c\n2,b\n'), ("INVALID_CSV", "id,docs\n1,a,more\n2,b\n"), ("INVALID_CSV", "id,docs\n1\n2,b\n"), ("INVALID_CSV", 'id,docs\n2,b\n1,"a\n'),
        ("DUPLICATE_QUERY_ID", "id,docs\n1,a\n 1,b\n2,b\n"), ("INVALID_RECORD", "id,docs\n,a\n2,b\n"), ("INVALID_RECORD", "id,docs\n1,a|a\n2,b\n"),
    ]
    for n, (code, data) in enumerate(found):
        path = at(f"{n}.csv", data)
        records, issues = readers.csv_records(spark, path, "predictions", MAPPING)
        assert [r.code for r in issues.collect()] == [code] and [tuple(r) for r in records.collect()] == [("2", ["b"])], data
        with pytest.raises(Exception, match=code):
            readers.mapped_csv(spark, path, "predictions", MAPPING).collect()


def test_codes_of_registered_input(spark, tmp_path):
    fine = put(tmp_path / "a.jsonl", '{"query_id": "1", "relevant_document_ids": ["a"]}\n')
    os.mkdir(tmp_path / "d.jsonl")
    for code, path, kind in (
        ("UNSUPPORTED_KIND", fine, "x"), ("UNSUPPORTED_FORMAT", put(tmp_path / "a.json", "{}"), "ground_truth"), ("INVALID_REFERENCE_PATH", "a.jsonl", "ground_truth"), ("NOT_A_FILE", str(tmp_path / "d.jsonl"), "ground_truth"),
        ("UNREADABLE_INPUT", str(tmp_path / "no.jsonl"), "ground_truth"), ("EMPTY_INPUT", put(tmp_path / "e.jsonl", " \n"), "ground_truth"), ("INVALID_UTF8", put(tmp_path / "u.jsonl", b'{"query_id": "\xff"}'), "ground_truth"),
        ("INPUT_TOO_LARGE", put(tmp_path / "l.jsonl", b"x" * (readers.MAX_INPUT_BYTES + 1)), "ground_truth"),
    ):
        with pytest.raises(readers.InputError) as e:
            readers.registered_input(spark, path, kind)
        assert e.value.code == code
    os.symlink(fine, tmp_path / "link.jsonl")
    assert readers.registered_input(spark, str(tmp_path / "link.jsonl"), "ground_truth").first().records == 1
