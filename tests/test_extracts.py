"""Extracts of different layouts under one glob, and what is put aside."""

import os

from helpers import rows
from monthloom.model import PANEL_SCHEMA
from monthloom.sources.panel_io import header_lines, read_mixed_extracts

H = {"id": "ID", "name": "Name", "rat": "Rat", "year": "Year", "mon": "Mon"}


def written(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return f"{tmp_path}/*.csv"


def read(spark, glob):
    panel, aside = read_mixed_extracts(spark, glob, header=H)
    assert [(f.name, f.dataType) for f in panel.schema] == [(f.name, f.dataType) for f in PANEL_SCHEMA]
    assert panel.count() == len(panel.collect())
    got = sorted((os.path.basename(f), reason, line) for f, reason, line in aside.collect())
    return rows(panel.select("id", "name", "rat", "year", "mon")), got


def test_layouts_and_broken_lines(spark, tmp_path):
    glob = written(tmp_path,
                   a="ID|Name|Rat|Year|Mon\n1|Ann|2000|2019|1\n2|Bob\n3|\"Lee | jr\"|x12|2019|1\n|Nobody|1|2019|1\n",
                   b="Mon|Year|Extra|ID\n2|2019|e|1\n2|2019|e|4|5|6\n 3 |2019||5\n",
                   c="ID Nr|Year|Mon\n9|2019|1\n", d="ID|Year|Mon|ID\n9|2019|1|9\n", e="", f="\n1|2019|1\n")
    got, aside = read(spark, glob)
    assert got == [(1, "Ann", 2000, 2019, 1), (1, None, None, 2019, 2), (5, None, None, 2019, 3)]
    assert aside == [("a.csv", "fields", "2|Bob"), ("a.csv", "id", "|Nobody|1|2019|1"), ("a.csv", "rat", "3|Lee | jr|x12|2019|1"),
                     ("b.csv", "fields", "2|2019|e|4|5|6"), ("c.csv", "no column ID", "ID Nr|Year|Mon"),
                     ("d.csv", "twice: ID", "ID|Year|Mon|ID"), ("f.csv", "no column ID, Year, Mon", "")]


def test_repeated_lines_and_headers_alone(spark, tmp_path):
    glob = written(tmp_path, a="ID|Year|Mon\n1|2019|1\n1|2019|1\n", b="ID|Year|Mon\n")
    assert read(spark, glob) == ([(1, None, None, 2019, 1)] * 2, [])
    assert sorted(header_lines(spark, glob).values()) == ["ID|Year|Mon"] * 2
