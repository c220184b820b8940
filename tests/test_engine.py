"""The engine over small tables: expected rows, plans, and virtual against materialised."""

import re

import pytest

from tripleweave.engine import Catalog, Engine
from tripleweave.functions.exprs import QueryError
from tripleweave.mapping import parse_r2rml, parse_yarrrml
from tripleweave.operators import rdf
from tripleweave.sparql import printer
from tripleweave.sparql.parser import ParseError, parse
from tripleweave.template import Template

TTL = """
@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <http://ex.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
<#Boat> rr:logicalTable [ rr:tableName "boats" ] ; rr:subjectMap [ rr:template "http://ex.org/boat/{hull}" ; rr:class ex:Boat ] ;
  rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rr:column "title" ] ] ,
    [ rr:predicate ex:harbour ; rr:objectMap [ rr:parentTriplesMap <#Harbour> ; rr:joinCondition [ rr:child "berth" ; rr:parent "code" ] ] ] ,
    [ rr:predicate ex:tows ; rr:objectMap [ rr:template "http://ex.org/boat/{towed}" ] ] .
<#Harbour> rr:logicalTable [ rr:sqlQuery "SELECT code, town, coast FROM harbours;" ] ; rr:subjectMap [ rr:template "http://ex.org/harbour/{code}" ] ;
  rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rr:column "town" ; rr:language "en" ] ] ,
    [ rr:predicate ex:coast ; rr:objectMap [ rr:template "http://ex.org/coast/{coast}" ] ] .
<#Buoy> rr:logicalTable [ rr:tableName "buoys" ] ; rr:subjectMap [ rr:template "http://ex.org/buoy/{no}" ] ;
  rr:predicateObjectMap [ rr:predicate ex:next ; rr:objectMap [ rr:template "http://ex.org/buoy/{then}" ] ] .
"""
YML = """
prefixes: {ex: "http://ex.org/"}
mappings:
  Boat:
    sources: [{table: boats}]
    s: ex:boat/$(hull)
    po:
      - [a, ex:Boat]
      - [ex:name, $(title)]
      - p: ex:harbour
        o: {mapping: Harbour, condition: {function: equal, parameters: [[str1, $(berth)], [str2, $(code)]]}}
      - [ex:tows, "ex:boat/$(towed)~iri"]
  Harbour:
    sources: [{query: "SELECT code, town, coast FROM harbours"}]
    s: ex:harbour/$(code)
    po:
      - [ex:name, $(town), en~lang]
      - [ex:coast, "ex:coast/$(coast)~iri"]
  Buoy:
    sources: [{table: buoys}]
    s: ex:buoy/$(no)
    po: [[ex:next, "ex:buoy/$(then)~iri"]]
"""
P = "PREFIX ex: <http://ex.org/> "


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark)
    c.add("boats", spark.createDataFrame([(31, "Petrel", 4, 58), (58, "Tern", None, None)], "hull int, title string, berth int, towed int"), ("hull",))
    c.add("harbours", spark.createDataFrame([(4, "Whitby", "north sea"), (6, "Looe", "channel")], "code int, town string, coast string"), ("code",))
    c.add("buoys", spark.createDataFrame([(5, 6), (6, 8), (8, 5)], "no int, then int"), ("no",))
    return c


@pytest.fixture(scope="module")
def engine(spark, catalog):
    m = parse_r2rml(TTL)
    assert not m.errors
    return Engine(spark, m, catalog)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


B, H, N = "http://ex.org/boat/", "http://ex.org/harbour/", "http://ex.org/buoy/"
CASES = {
    "SELECT ?e ?n WHERE { ?e a ex:Boat ; ex:name ?n }": [(B + "31", "Petrel"), (B + "58", "Tern")],
    'SELECT ?x WHERE { ?x ex:name "Whitby"@en }': [(H + "4",)],
    "SELECT ?n ?d WHERE { ?e a ex:Boat ; ex:name ?n OPTIONAL { ?e ex:harbour ?d } }": [("Tern", None), ("Petrel", H + "4")],
    "SELECT ?n WHERE { ?e a ex:Boat ; ex:name ?n MINUS { ?e ex:harbour ?d } }": [("Tern",)],
    "SELECT ?n WHERE { ?e a ex:Boat ; ex:name ?n FILTER NOT EXISTS { ?e ex:tows ?x } }": [("Tern",)],
    "SELECT ?n WHERE { ?e a ex:Boat ; ex:name ?n BIND(EXISTS { ?e ex:harbour ?x } AS ?b) FILTER(!?b) }": [("Tern",)],
    "SELECT ?l WHERE { ?e ex:harbour/ex:coast ?l }": [("http://ex.org/coast/north%20sea",)],
    "SELECT ?d WHERE { ?d ex:coast <http://ex.org/coast/north%20sea> }": [(H + "4",)],
    "SELECT ?a ?b WHERE { ?a ex:next+ ?b }": [(N + a, N + b) for a in "568" for b in "568"],
    "SELECT ?b WHERE { <http://ex.org/buoy/5> ex:next* ?b }": [(N + b,) for b in "568"],
    "SELECT ?a WHERE { ?a ex:next+ <http://ex.org/buoy/5> }": [(N + b,) for b in "568"],
    "SELECT ?x ?y WHERE { { ?x ex:tows ?y } UNION { ?x ex:harbour ?z } }": [(B + "31", None), (B + "31", B + "58")],
    "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }": [(13,)],
    "SELECT ?s WHERE { ?s !(ex:name|ex:coast|ex:next|a) ?o }": [(B + "31",), (B + "31",)],
    "SELECT ?v WHERE { VALUES (?v ?w) { (1 UNDEF) (2 3) } VALUES (?v ?w) { (1 7) (UNDEF 3) } }": [(1,), (1,), (2,)],
    "SELECT (LANG(?n) AS ?l) (DATATYPE(?n) AS ?t) WHERE { ?x ex:name ?n }": [("", "http://www.w3.org/2001/XMLSchema#string")] * 2 + [("en", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")] * 2,
    "ASK { ?x ex:next ?x }": [(False,)],
    "SELECT ?n WHERE { ?e a ex:Boat ; ex:name ?n FILTER EXISTS { ?f a ex:Boat ; ex:name ?m FILTER(?m != ?n) } }": [("Petrel",), ("Tern",)],
    "SELECT ?n WHERE { ?e a ex:Boat ; ex:name ?n FILTER EXISTS { ?f a ex:Boat ; ex:name ?m FILTER(?m > ?n) } }": [("Petrel",)],
    "SELECT (STR(SUM(?v)) AS ?s) WHERE { VALUES ?v { 9223372036854775807 9223372036854775807 } }": [("18446744073709551614",)],
}


@pytest.mark.parametrize("text", CASES)
def test_rows(engine, text):
    assert rows(engine.query(P + text)) == sorted(CASES[text], key=str)


@pytest.mark.parametrize("text", list(CASES)[:6] + list(CASES)[12:14])
def test_plans_agree(spark, catalog, engine, text):
    plain = Engine(spark, engine.mapping, catalog, star=False, native=False)
    assert rows(plain.query(P + text)) == rows(engine.query(P + text))


def test_same_model(spark, catalog, engine):
    m = parse_yarrrml(YML)
    assert not m.errors
    assert rows(Engine(spark, m, catalog).quads(True)) == rows(engine.quads(True))


def test_virtual_is_materialised(engine):
    graph = {(r.s, r.p, r.o) for r in engine.quads().collect()}
    made = {tuple(r) for r in engine.query("CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }").collect()}
    assert graph == made and len(graph) == 13
    assert all(re.fullmatch(r"<[^>]*> <[^>]*> (<[^>]*>|\".*\"(@en)?) \.", r.value) for r in rdf.lines(engine.quads()).collect())


def test_pushdown(engine):
    q = engine.query(P + "SELECT ?n WHERE { <http://ex.org/boat/31> ex:name ?n }")
    assert "31" in q._jdf.queryExecution().optimizedPlan().toString() and "http" not in q._jdf.queryExecution().optimizedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_arms_are_pruned(engine):
    """A shared predicate is looked for only in the maps that the other patterns leave, and a star is one scan a map."""
    one = plan(engine.query(P + "SELECT ?n WHERE { ?e a ex:Boat ; ex:name ?n }"))
    assert one.count("LogicalRDD") == 1 and "Join" not in one
    two = plan(engine.query(P + "SELECT ?n ?m WHERE { ?e a ex:Boat ; ex:name ?n ; ex:tows ?f . ?f ex:name ?m }"))
    assert two.count("LogicalRDD") == 2
    assert plan(engine.query(P + "SELECT * WHERE { ?s ?p ?o }")).count("LogicalRDD") == 6  # boats, buoys, two arms over the view without a key, and the two sides of a join


def test_exists_refuses_what_it_cannot_read(engine):
    with pytest.raises(QueryError):
        engine.query(P + "SELECT ?n WHERE { ?e ex:name ?n FILTER EXISTS { ?f a ex:Boat OPTIONAL { ?f ex:name ?m FILTER(?m != ?n) } } }")


def test_catalog(spark, engine):
    c = Catalog.from_spark(spark, engine.mapping, {"boats": [("hull",)], "buoys": [("then",)], "harbours": [("coast",)]})
    assert c.unique(engine.mapping.maps["#Boat"] if "#Boat" in engine.mapping.maps else next(m for m in engine.maps if m.table == "boats"), ["hull"]) and c.verify() == []
    c.declare_key("boats", "berth")
    assert c.verify() == ["boats: berth"]


def test_files_and_streams(spark, engine, tmp_path):
    from tripleweave.mapping import load_mapping, predicate_object, template, column, TriplesMap
    from tripleweave.streaming import write_stream

    for name, text in (("m.ttl", TTL), ("m.yml", YML)):
        (tmp_path / name).write_text(text)
        assert len(load_mapping(str(tmp_path / name)).maps) == 3
    with pytest.raises(ValueError):
        load_mapping(str(tmp_path / "m.ttl").replace(".ttl", ".txt")) if (tmp_path / "m.txt").write_text("") == 0 else None
    for form, least in (("ntriples", 13), ("nquads", 13), ("turtle", 13)):
        rdf.write(engine.quads(), str(tmp_path / form), form)
        assert spark.read.text(str(tmp_path / form)).count() >= least
    m = TriplesMap("m", template("http://ex.org/v/{id}"), pos=[predicate_object("http://ex.org/w", column("w"))])
    spark.createDataFrame([(1, "a"), (2, None)], "id int, w string").write.parquet(str(tmp_path / "in"))
    q = write_stream(engine, m, spark.readStream.schema("id int, w string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['<http://ex.org/v/1> <http://ex.org/w> "a" .']


def test_strict(spark, engine):
    from tripleweave.mapping import TriplesMap, column, predicate_object, template

    m = TriplesMap("m", template("http://ex.org/v/{id}"), pos=[predicate_object("http://ex.org/w", column("w", kind="I"))])
    good = spark.createDataFrame([("a b", "http://ex.org/x"), ("c", None)], "id string, w string")
    assert rows(rdf.map_dataframe(engine, m, good, True).select("s", "o")) == [("<http://ex.org/v/a%20b>", "<http://ex.org/x>")]
    bad = spark.createDataFrame([("a", "http://ex.org/x y")], "id string, w string")
    assert rdf.map_dataframe(engine, m, bad).count() == 1
    with pytest.raises(Exception, match="not an IRI: http://ex.org/x y"):
        rdf.map_dataframe(engine, m, bad, True).collect()
    assert rows(engine.quads(strict=True)) == rows(engine.quads())


@pytest.mark.parametrize("text", ["SELECT * WHERE { GRAPH ?g { ?s ?p ?o } }", "SELECT * WHERE { SERVICE <http://x> { ?s ?p ?o } }", "SELECT * FROM <http://x> WHERE { ?s ?p ?o }"])
def test_refused(engine, text):
    with pytest.raises(QueryError):
        engine.query(text)


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x", "SELECT WHERE { }", "SELECT ?x { ?x ?y \"a }", "SELECT ?x { VALUES (?x ?y) { (1) } }", "SELECT ?x { ?x foo:bar ?y }", "FOO ?x {}"])
def test_syntax_errors(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", list(CASES) + ["SELECT DISTINCT (SUM(?x+1) AS ?s) WHERE { [] ex:p (1 2.5 'x'@en) ; ex:q|^ex:r/(ex:s?)* ?x } GROUP BY (?x AS ?k) HAVING(?k IN (1,2)) ORDER BY DESC(?s) LIMIT 3 OFFSET 1"])
def test_printer(text):
    once = printer.query(parse(P + text))
    assert printer.query(parse(once)) == once


def test_template():
    t = Template.parse(r"http://x/\{{A}/{B}")
    assert t.invertible() and t.invert("http://x/{a%20b/c") == ["a b", "c"] and t.invert("http://x/{a b/c") is None
    assert not Template.parse("{A}{B}").invertible() and not t.can_meet(Template.parse("http://y/{A}"))
    with pytest.raises(ValueError):
        Template.parse("x{A")
