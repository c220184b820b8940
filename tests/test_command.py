"""The command line, result files and the timing harness."""

import io
import json

import pytest

from tripleweave.__main__ import main
from tripleweave.sources import results

YML = """
prefixes: {ex: "http://ex.org/"}
mappings:
  Kite:
    sources: [{table: kites}]
    s: ex:kite/$(tail)
    po: [[a, ex:Kite], [ex:colour, $(colour)], [ex:site, $(site)~iri]]
"""
ASK = "PREFIX ex: <http://ex.org/> SELECT ?k ?c WHERE { ?k a ex:Kite OPTIONAL { ?k ex:colour ?c } } ORDER BY ?k"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("command")
    rows = [(1, "red\tand blue", "http://ex.org/hill"), (2, None, None), (3, "", "http://ex.org/the beach")]
    spark.createDataFrame(rows, "tail int, colour string, site string").write.parquet(str(path / "kites"))
    (path / "m.yml").write_text(YML)
    (path / "q.rq").write_text(ASK)
    (path / "all.yml").write_text(json.dumps({"kites": ASK, "wrong": "SELECT ?x WHERE {"}))
    return path


def call(spark, files, *args):
    return main([args[0], *[str(files / a) for a in args[1:3]], "--table", f"kites={files / 'kites'}", "--key", "kites=tail", *args[3:]], spark)


def test_query(spark, files, capsys):
    assert call(spark, files, "query", "m.yml", "q.rq") == 0
    assert capsys.readouterr().out.splitlines() == ["k\tc", "http://ex.org/kite/1\tred\\tand blue", "http://ex.org/kite/2\tNULL", "http://ex.org/kite/3\t"]
    assert call(spark, files, "query", "m.yml", "q.rq", "--explain") == 0
    assert "Scan parquet" in capsys.readouterr().out
    assert call(spark, files, "query", "m.yml", "q.rq", "--out", str(files / "out")) == 0
    assert sorted(r.value for r in spark.read.text(str(files / "out")).distinct().collect()) == ["http://ex.org/kite/1\tred\\tand blue", "http://ex.org/kite/2\tNULL", "http://ex.org/kite/3\t", "k\tc"]


def test_forward(spark, files, capsys):
    assert call(spark, files, "forward", "m.yml", "graph") == 0
    assert spark.read.text(str(files / "graph")).count() == 7
    assert call(spark, files, "forward", "m.yml", "strict", "--strict") == 1
    assert "not an IRI: http://ex.org/the beach" in capsys.readouterr().err


def test_bench(spark, files, capsys):
    assert call(spark, files, "bench", "m.yml", "all.yml", "--runs", "2", "--warm", "0") == 0
    good, bad = map(json.loads, capsys.readouterr().out.splitlines())
    assert good["rows"] == 3 and set(good["execution_ms"]) == {"min", "median", "max"} and good["planning_ms"]["min"] > 0
    assert bad["query"] == "wrong" and "ParseError" in bad["error"]


def test_faults(spark, files, capsys):
    assert main(["parse", str(files / "q.rq")]) == 0 and "ORDER BY" in capsys.readouterr().out
    (files / "bad.rq").write_text("SELECT ?x WHERE {")
    assert main(["parse", str(files / "bad.rq")]) == 1
    assert main(["query", str(files / "none.yml"), str(files / "q.rq")], spark) == 1
    (files / "lost.yml").write_text(YML.replace("kites", "no_such_table"))
    assert main(["query", str(files / "lost.yml"), str(files / "q.rq")], spark) == 1
    with pytest.raises(SystemExit):
        main(["query", "m.yml", "q.rq", "--table", "kites"])


def test_empty_and_odd_values(spark):
    out = io.StringIO()
    results.show(spark.createDataFrame([("a\nb\\", None), (None, 2)], "`x.y` string, n int"), out)
    assert out.getvalue() == "x.y\tn\na\\nb\\\\\tNULL\nNULL\t2\n"
    out = io.StringIO()
    results.show(spark.createDataFrame([], "x string"), out)
    assert out.getvalue() == "x\n"
