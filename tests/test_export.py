"""Order and quoting of exported records."""

import csv
import glob
import io

import pytest

from vulnloom.sinks import export


def read(path):
    return "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture
def records(spark):
    return spark.createDataFrame([("a", "2020-01-01"), ("m", "2021-01-01"), ("z", "2022-01-01")], "name string, day string").repartition(3)


@pytest.mark.parametrize("fmt", ["csv", "json", "md", "html", "txt"])
def test_records_keep_their_order(records, tmp_path, fmt):
    export.export(records, str(tmp_path / "out"), fmt, order=[("day", True)], fields=["name"])
    text = read(tmp_path / "out").replace("name", "").replace("html", "").replace("meta", "").replace("table", "")
    marks = {"csv": "{}", "json": '"{}"', "md": "| {} |", "html": "<td>{}</td>", "txt": ": {}"}[fmt]
    places = [text.index(marks.format(x)) for x in "zma"]
    assert places == sorted(places)
    if fmt == "html":
        assert text.index("<h1>") < places[0] and places[-1] < text.index("</body>")


def test_csv_quotes(spark, tmp_path):
    rows = [('say "hi", ok', "two\nlines"), ("plain", 'back\\slash"')]
    export.export(spark.createDataFrame(rows, "a string, b string").coalesce(1), str(tmp_path / "x.csv"))
    got = list(csv.reader(io.StringIO(read(tmp_path / "x.csv"))))
    assert got[0] == ["a", "b"] and sorted(map(tuple, got[1:])) == sorted(rows)
