"""Scanner, header, inference, load rules, and the distributed form of the scanner."""

import random

import pytest

from tabq.errors import CsvError, SqlError, UsageError
from tabq.sources import infer
from tabq.sources.delimited import check_delimiter, read_delimited, with_rowid
from tabq.sources.scanner import Scanner, block_records, ends_both, ends_inside, records, whole_line

SCANS = [
    ("q,w\n7,8\n9,0\n", ",", [["q", "w"], ["7", "8"], ["9", "0"]]),
    ('5,"left, right",\n', ",", [["5", "left, right", ""]]),
    ('"""",""""""\n', ",", [['"', '""']]),
    ('"up\n\ndown",k\n1,"a\rb"\n', ",", [["up\n\ndown", "k"], ["1", "a\rb"]]),
    ("m;n\r\n\r\n3;4\r\n", ";", [["m", "n"], [""], ["3", "4"]]),
    (";;\n", ";", [["", "", ""]]),
    ("tail", ",", [["tail"]]),
    ('h\n"end"', ",", [["h"], ["end"]]),
    ('"","",""\n', ",", [["", "", ""]]),
    ("", "|", []),
    ('r|"s|t"|u\n', "|", [["r", "s|t", "u"]]),
    ("é\tß\n\tø\n", "\t", [["é", "ß"], ["", "ø"]]),
    ('"cl"osed,"no"t"e"\n', ",", [["closed", 'not"e"']]),
    ("o\rne,t\r\rwo\n", ",", [["one", "two"]]),
    ('5" pipe,"a\r"\r\n', ",", [['5" pipe', "a\r"]]),
    ("\n\nz\n", ",", [[""], [""], ["z"]]),
    ('\r"q,1"\r\r,2\n', ",", [["q,1", "2"]]),
]


@pytest.mark.parametrize("text,d,want", SCANS)
def test_records(text, d, want):
    assert list(records(text, d)) == want


def test_unterminated_quote_names_the_record():
    with pytest.raises(CsvError, match="row 2: unterminated quoted field"):
        list(records('a\n"x\n'))


def test_blocks_compose_to_the_whole_scan():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice('ab,"\n\r') for _ in range(r.randrange(60))) + "\n"
        try:
            want = list(records(text))
        except CsvError:
            continue
        lines = text.split("\n")[:-1]
        assert ends_both(lines, ",") == (ends_inside(lines, ",", False), ends_inside(lines, ",", True))
        got, inside, open_, at = [], False, None, 0
        while at < len(lines):
            n = r.randrange(1, 5)
            part = lines[at : at + n]
            head, rows, tail = block_records(part, ",", inside)
            if head is not None:
                open_ += head
                if not ends_inside(open_.split("\n")[:-1], ",", False):
                    got += list(records(open_))
                    open_ = None
            got += rows
            if tail is not None:
                open_ = tail
            inside, at = ends_inside(part, ",", inside), at + n
        assert got == want


def test_fast_lines_are_those_of_the_scanner():
    r = random.Random(8)
    some = 0
    for k in range(20_000):
        d = r.choice(",;|^-]")
        line = "".join(r.choice(["a", "b", d, d, '"', '"', "\r"] if k % 2 else ["a", d, '"', '""']) for _ in range(r.randrange(12)))
        fast = whole_line(line, d)
        if fast is not None:
            some += 1
            assert [fast] == list(records(line + "\n", d)), (line, d)
        for inside in (False, True):
            s = Scanner(d)
            s.state = "quoted" if inside else "start"
            list(s.feed(line + "\n"))
            assert ends_inside([line], d, inside) == (s.state == "quoted"), (line, d, inside)
    assert some > 5000


def test_encode_and_scan_round_trip():
    r = random.Random(2)
    for _ in range(200):
        rows = [["".join(r.choice('xy ,"\n\ré') for _ in range(r.randrange(5))) for _ in range(3)] for _ in range(4)]
        text = "".join(",".join('"' + c.replace('"', '""') + '"' for c in row) + "\n" for row in rows)
        assert list(records(text)) == rows


def test_header_rules():
    assert infer.header_names(["﻿a", " b ", "a", "a", "c\r"]) == ["a", "b", "a_2", "a_3", "c"]
    with pytest.raises(CsvError, match="row 1: empty column name in header"):
        infer.header_names(["a", " "])
    with pytest.raises(SqlError):
        infer.header_names(["A", "a"])


@pytest.mark.parametrize(
    "cells,kind",
    [(["+5"], "int"), (["-"], "text"), (["007"], "int"), ([" 30"], "text"), (["1e3"], "real"), ([".5"], "real"), (["5."], "real"), (["nan"], "real"), (["INF"], "real"), (["1_000"], "real"), (["0x10"], "real"), (["12345678901234567890"], "int"), (["", ""], "text"), (["1", "2.5"], "real"), (["1", "", "x"], "text"), (["1\n"], "text")],
)
def test_inference(cells, kind):
    assert infer.infer([[c] for c in cells], 1) == [kind]


def test_delimiter_option():
    assert check_delimiter("\\t") == "\t" and check_delimiter("|") == "|"
    for bad in ("", "ab", "é", "\n", "\r"):
        with pytest.raises(UsageError):
            check_delimiter(bad)


def load(spark, tmp_path, text, **options):
    p = tmp_path / f"in{len(list(tmp_path.iterdir()))}.csv"
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    out = read_delimited(spark, str(p), **options)
    return out.columns, [tuple(r) for r in out.df.collect()]


def test_load_rules(spark, tmp_path):
    assert load(spark, tmp_path, "bird,eggs\nwren,6\nowl,4") == ([("bird", "text"), ("eggs", "int")], [("wren", 6), ("owl", 4)])
    assert load(spark, tmp_path, "a,b\n1,2\n\n3,4\n")[1] == [(1, 2), (None, None), (3, 4)]
    assert load(spark, tmp_path, "a,b\n1\n1,2,3\n")[1] == [(1, None), (1, 2)]
    assert load(spark, tmp_path, b"\xef\xbb\xbfa\n1\n")[0] == [("a", "int")]
    assert load(spark, tmp_path, b'\xef\xbb\xbf"a"\n1\n')[0] == [("a", "int")]
    assert load(spark, tmp_path, "a,b\n1,\n2,\n") == ([("a", "int"), ("b", "text")], [(1, None), (2, None)])
    assert load(spark, tmp_path, 'a,b\n"x","1\n2"\n"",3\n') == ([("a", "text"), ("b", "text")], [("x", "1\n2"), (None, "3")])
    assert load(spark, tmp_path, "a\n1_000\n0x10\n-0x1\ninf\n")[1] == [(1000.0,), (16.0,), (-1.0,), (float("inf"),)]
    assert load(spark, tmp_path, "part|v\nrim|12\nhub|3\n", delimiter="|", infer=False)[1] == [("rim", "12"), ("hub", "3")]
    assert load(spark, tmp_path, 'a"b\n1"2\n', delimiter='"')[0] == [("a", "int"), ("b", "int")]
    assert load(spark, tmp_path, "a,b\n") == ([("a", "text"), ("b", "text")], [])
    for text, message in (("", "empty input"), ('a\n"x\n', "row 2: unterminated"), ("a,,b\n", "row 1: empty column name")):
        with pytest.raises(CsvError, match=message):
            load(spark, tmp_path, text)


def test_cells_that_break_the_type_after_the_sample(spark, tmp_path):
    ints = "".join(f"{i}\n" for i in range(100))
    assert load(spark, tmp_path, "a\n" + ints + "3.5\n")[0] == [("a", "real")]
    columns, rows = load(spark, tmp_path, "a\n" + ints + "abc\n7\n")
    assert columns == [("a", "text")] and rows[-2:] == [("abc",), ("7",)]
    with pytest.raises(CsvError):
        load(spark, tmp_path, "a\n" + ints + "abc\n", dirty="strict")
    assert load(spark, tmp_path, "a\n" + ints + "abc\n", dirty="null")[1][-1] == (None,)


def test_an_open_quote_is_bounded(spark, tmp_path, monkeypatch):
    from tabq.sources import delimited

    monkeypatch.setattr(delimited, "MAX_OPEN", 2000)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        with pytest.raises(CsvError, match="unterminated"):
            load(spark, tmp_path, 'a,b\n1,"open\n' + "2,x\n" * 3000)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_quoted_text_over_block_edges(spark, tmp_path):
    """Small splits, so that records with line breaks lie over several blocks."""
    r = random.Random(3)
    rows = [(str(i), "".join(r.choice(["word ", "\n", ",", '"', "é"]) for _ in range(r.randrange(80)))) for i in range(400)]
    text = "id,body\n" + "".join(f'{i},"' + b.replace('"', '""') + '"\n' for i, b in rows)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        _, got = load(spark, tmp_path, text)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted((int(i), b or None) for i, b in rows)


def test_rowid_is_dense_and_in_order(spark):
    rows = with_rowid(spark.range(1000).repartition(7)).collect()
    assert sorted(r["__rowid"] for r in rows) == list(range(1, 1001))
    assert [r["__rowid"] - 1 for r in with_rowid(spark.range(0, 100, 1, 4)).collect()] == list(range(100))
