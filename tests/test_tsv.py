"""Tab-separated files in the format of a database's dump: every escaped byte in every column, both ways."""

import itertools

from pagegraph.sources import readers as R
from pagegraph.sources import sinks as W

HARD = ["\t", "\n", "\r", "\b", "\0", "\x16", "\\", "\\\\", "\\N", "\\t", "\\\t", "\t\\", "\\\n\\", "N", "", '"', "'a\"", ",", "é\t漢", "\r\n", "\\\\t", None]


def test_every_escape_in_every_column(spark, tmp_path):
    rows = [(k, *[x if i == j else "plain" for i in range(3)], float(k), k % 2 == 0) for k, (x, j) in enumerate(itertools.product(HARD, range(3)))]
    rows += [(1000 + k, x, x, x, None, None) for k, x in enumerate(HARD)] + [(None, "a" + (x or "") + "b", (x or "") * 3, "z" + (x or ""), -0.5, True) for x in HARD]
    kind = "k long, a string, b string, c string, x double, t boolean"
    for header in (False, True):
        path = f"{tmp_path}/t{header}"
        W.write_tsv(spark.createDataFrame(rows, kind).repartition(3), path, header)
        back = R.read_tsv(spark, path, kind, header)
        assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))


def test_a_line_a_row(spark, tmp_path):
    W.write_tsv(spark.createDataFrame([("a\tb\\\n", None, 1.5, True)], "a string, b string, x double, t boolean").coalesce(1), f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["a\\tb\\\\\\n\t\\N\t1.5\t1"]


def test_files_written_elsewhere(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x\\ty\t1\tp\\\\q\n\\N\t\\N\t\\N\n\\a\\0\\Z\t2\n\t3\tz\tmore\n\\\\\\t\\\\\\\\n\tbad\t\\\n")
    got = R.read_tsv(spark, f"{tmp_path}/f", "a string, n int, b string", sets={"m": "n * 2"}).collect()
    assert [tuple(r) for r in got] == [("x\ty", 1, "p\\q", 2), (None, None, None, None), ("a\0\x16", 2, None, 4), ("", 3, "z", 6), ("\\\t\\\\n", None, "\\", None)]


def test_columns_with_odd_names(spark, tmp_path):
    W.write_tsv(spark.createDataFrame([("a", "b")], "`x.y` string, `value` string"), f"{tmp_path}/t")
    assert R.read_tsv(spark, f"{tmp_path}/t", "`x.y` string, `value` string").collect()[0][:] == ("a", "b")
    W.write_tsv(spark.createDataFrame([], "a string, b long"), f"{tmp_path}/none")
    assert R.read_tsv(spark, f"{tmp_path}/none", "a string, b long").count() == 0
