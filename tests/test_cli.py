"""The command line and the writers."""

import io
import math

import pytest

from tabq import cli, sinks
from tabq.engine import Engine


def tool(spark, text, *args):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main(list(args), io.BytesIO(text.encode()), out, err, spark)
    return code, out.getvalue(), err.getvalue()


STOCK = "sku,qty,shelf\nbolt,140,A3\nnut,75,\nwasher,310,B1\n"
CASES = [
    (STOCK, ["SELECT sku FROM t WHERE qty >= 140"], "bolt\nwasher\n"),
    (STOCK.rstrip("\n"), ["SELECT count(*), sum(qty) FROM t"], "3,525\n"),
    ("code,level\nx1,100\nx2,20\nx3,3\n", ["--no-type-inference", "SELECT code FROM t WHERE level < 3 ORDER BY code DESC"], "x2\nx1\n"),
    ("code,level\nx1,100\nx2,20\nx3,3\n", ["SELECT code FROM t WHERE level < 30 ORDER BY level"], "x3\nx2\n"),
    ("tree,kg\noak,7.25\nfir,6.00\nash,12.75\n", ["SELECT min(kg), total(kg), max(kg) FROM t"], "6.0,26.0,12.75\n"),
    ("city;pop\nOslo;709\nBergen;291\nTromso;\n", ["--delimiter=;", "SELECT city, pop FROM t ORDER BY pop, city"], "Tromso,NULL\nBergen,291\nOslo,709\n"),
    ("a:b\n1:x,y\n2:z\n", ["-d", ":", "SELECT b, a FROM t"], '"x,y",1\nz,2\n'),
    ("k\tv\tw\nq\t\t3\np\t4\t\n", ["--delimiter", "\\t", "SELECT k, v, w FROM t ORDER BY k"], "p,4,NULL\nq,NULL,3\n"),
    ("k\tv\tw\nq\t\t3\np\t4\t\n", ["--tsv", "SELECT w IS NULL, k || v FROM t ORDER BY 1"], "0,NULL\n1,p4\n"),
    (STOCK, ["--header", "SELECT shelf, qty / 10 AS tens FROM t ORDER BY sku DESC"], "shelf,tens\nB1,31\nNULL,7\nA3,14\n"),
    ("u|v\n5|6\n", ["-H", "--delimiter", "|", "SELECT v - u, * FROM t"], "v - u,u,v\n1,5,6\n"),
    (STOCK, ["--json", "SELECT sku, shelf, qty * 0.5 AS half FROM t WHERE qty < 200 ORDER BY qty"], '[{"sku":"nut","shelf":null,"half":37.5},{"sku":"bolt","shelf":"A3","half":70}]\n'),
    ("only\n", ["--json", "SELECT only FROM t"], "[]\n"),
    ("w\n-4.0\n0.125\n\n", ["--json", "SELECT w FROM t"], '[{"w":-4},{"w":0.125},{"w":null}]\n'),
    ("p,q,r\n,,z\n", ["SELECT * FROM t"], "NULL,NULL,z\n"),
    ("m\n8\n8\n", ["-H", 'SELECT count(*), m - 1 AS "less;, one" FROM t GROUP BY m'], 'count(*),"less;, one"\n2,7\n'),
    ("m\n8\n", ["CREATE TABLE other (z)"], ""),
]


@pytest.mark.parametrize("text,args,want", CASES)
def test_output(spark, text, args, want):
    assert tool(spark, text, *args) == (0, want, "")


def test_codes(spark):
    code, out, err = tool(spark, "", "--help")
    assert code == 0 and out == "" and "Usage:" in err
    code, out, err = tool(spark, "", "--version")
    assert code == 0 and "tabq" in err
    assert tool(spark, "")[0] == 1
    assert tool(spark, "a\n1\n", "--nope", "SELECT 1")[0] == 1
    assert tool(spark, STOCK, "--json", "--header", "SELECT * FROM t")[0] == 1
    assert tool(spark, STOCK, "--json", "--tsv", "SELECT * FROM t")[0] == 1
    assert tool(spark, STOCK, "-d", "ab", "SELECT 1")[0] == 1
    assert tool(spark, "", "SELECT 1")[0] == 2
    assert tool(spark, 'a\n"x\n', "SELECT 1")[0] == 2
    code, out, err = tool(spark, "a\n1\n", "SELECT * FROM nowhere")
    assert code == 3 and err.startswith("error:")
    assert tool(spark, "a\n9223372036854775807\n1\n", "SELECT sum(a) FROM t")[0] == 3


def test_numbers_as_text():
    t = sinks.real_to_text
    assert [t(x) for x in (12.5, 3.0, 0.1 + 0.2, 1e15, 100 / 3, -0.0, float("inf"), 1e-5, 123456789012345.0, float("nan"))] == ["12.5", "3.0", "0.3", "1.0e+15", "33.3333333333333", "0.0", "Inf", "1.0e-05", "123456789012345.0", None]
    j = sinks.json_number
    assert [j(x) for x in (3.0, 2.5, 1e-7, 1e20, math.inf)] == ["3", "2.5", "0.0000001", "100000000000000000000", "null"]


def test_json_escapes():
    assert sinks.json_string('"\\/\t\x01é') == '"\\"\\\\\\/\\t\\u0001é"'


def test_distributed_text_is_what_the_writer_prints(spark, tmp_path):
    rows = [(1, 0.1, 'a "b", c'), (None, 1e15, "x\ny"), (3, -2.0, None), (4, 33.333333333333336, "")]
    e = Engine(spark).register("t", spark.createDataFrame(rows, "a long, b double, c string").coalesce(1))
    df = e.sql("SELECT * FROM t")
    assert [r.line + "\n" for r in sinks.line_frame(df).collect()] == list(sinks.csv_lines(df.columns, df.collect()))
    sinks.write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.startswith("a,b,c\n1,0.1,") and "NULL,1.0e+15" in text
    assert list(sinks.csv_lines(["a"], [("x,y",)], raw_cells=True)) == ["x,y\n"]


def test_chained_text_equals_reparse(spark):
    first = tool(spark, "u,v\n1,2\n1,3\n2,\n", "-H", "SELECT u, sum(v) AS s FROM t GROUP BY u ORDER BY u")[1]
    second = tool(spark, first, "SELECT count(*), min(s) FROM t")[1]
    e = Engine(spark).register("t", spark.createDataFrame([(1, 2), (1, 3), (2, None)], "u long, v long"))
    assert second == "".join(sinks.csv_lines([], e.pipe(["SELECT u, sum(v) AS s FROM t GROUP BY u ORDER BY u", "SELECT count(*), min(s) FROM t"], reparse=True).collect()))
