"""More queries of the driver contract, over mappings that are loaded: one from R2RML in Turtle, the same in YARRRML.

The tables are views with gaps (nulls), a cycle, texts that need percent-encoding, and one predicate, ex:val, with objects of
many kinds, so that what a term is only shows in the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Catalog, Engine
from .mapping import parse_r2rml, parse_yarrrml
from .operators import rdf

EX, XSD = "http://ex.org/", "http://www.w3.org/2001/XMLSchema#"
PREFIX = f"PREFIX ex: <{EX}> PREFIX xsd: <{XSD}> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> "
_PLACE = "SELECT n_nationkey, n_name, NULLIF(n_regionkey, 2) AS rk, (n_nationkey + 1) % 25 AS nxt FROM nation"
_THING = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, p_size > 25 AS big FROM part WHERE p_partkey < 60"
TTL = f"""
@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <{EX}> . @prefix xsd: <{XSD}> .
<#Place> rr:logicalTable [ rr:sqlQuery "{_PLACE}" ] ; rr:subjectMap [ rr:template "{EX}place/{{n_nationkey}}" ; rr:class ex:Place ] ;
  rr:predicateObjectMap [ rr:predicate ex:val ; rr:objectMap [ rr:column "n_name" ] ] , [ rr:predicate ex:name ; rr:objectMap [ rr:column "n_name" ] ] ,
    [ rr:predicate ex:code ; rr:objectMap [ rr:column "rk" ] ] , [ rr:predicate ex:area ; rr:objectMap [ rr:template "{EX}area/{{rk}}" ] ] ,
    [ rr:predicate ex:after ; rr:objectMap [ rr:template "{EX}place/{{nxt}}" ] ] , [ rr:predicate ex:kind ; rr:object "place" ] ,
    [ rr:predicate ex:ref ; rr:objectMap [ rr:parentTriplesMap <#Area> ; rr:joinCondition [ rr:child "rk" ; rr:parent "r_regionkey" ] ] ] .
<#Area> rr:logicalTable [ rr:tableName "region" ] ; rr:subjectMap [ rr:template "{EX}area/{{r_regionkey}}" ; rr:class ex:Area ; rr:graph ex:areas ] ;
  rr:predicateObjectMap [ rr:predicate ex:val ; rr:objectMap [ rr:column "r_name" ; rr:language "en" ] ] , [ rr:predicate ex:name ; rr:objectMap [ rr:column "r_name" ; rr:language "en" ] ] ,
    [ rr:predicate ex:val ; rr:objectMap [ rr:template "{EX}area/{{r_regionkey}}" ] ] , [ rr:predicate ex:since ; rr:objectMap [ rr:template "200{{r_regionkey}}-03-0{{r_regionkey}}" ; rr:datatype xsd:date ] ] .
<#Note> rr:logicalTable [ rr:tableName "region" ] ; rr:subjectMap [ rr:template "note{{r_regionkey}}" ; rr:termType rr:BlankNode ] ;
  rr:predicateObjectMap [ rr:predicate ex:on ; rr:objectMap [ rr:template "{EX}area/{{r_regionkey}}" ] ] , [ rr:predicate ex:val ; rr:objectMap [ rr:column "r_regionkey" ] ] .
<#Thing> rr:logicalTable [ rr:sqlQuery "{_THING}" ] ; rr:subjectMap [ rr:template "{EX}thing/{{p_partkey}}" ; rr:class ex:Thing ] ;
  rr:predicateObjectMap [ rr:predicate ex:val ; rr:objectMap [ rr:column "p_size" ] ] , [ rr:predicate ex:size ; rr:objectMap [ rr:column "p_size" ] ] ,
    [ rr:predicate ex:price ; rr:objectMap [ rr:column "p_retailprice" ] ] , [ rr:predicate ex:big ; rr:objectMap [ rr:column "big" ] ] ,
    [ rr:predicate ex:made ; rr:objectMap [ rr:template "{EX}made/{{p_name}}?{{p_brand}}" ] ] , [ rr:predicate ex:label ; rr:objectMap [ rr:column "p_name" ; rr:language "en" ] ] ,
    [ rr:predicate ex:self ; rr:objectMap [ rr:template "{EX}thing/{{p_size}}" ] ] , [ rr:predicate ex:brand ; rr:objectMap [ rr:column "p_brand" ] ] .
<#Line> rr:logicalTable [ rr:tableName "lineitem" ] ; rr:subjectMap [ rr:template "{EX}row/{{l_orderkey}}/{{l_linenumber}}" ] ;
  rr:predicateObjectMap [ rr:predicate ex:flag ; rr:objectMap [ rr:column "l_returnflag" ] ] , [ rr:predicate ex:item ; rr:objectMap [ rr:template "{EX}row/{{l_orderkey}}/{{l_linenumber}}" ] ] .
"""
YML = f"""
prefixes: {{ex: "{EX}"}}
sources: {{places: {{query: "{_PLACE}"}}, areas: {{table: region}}}}
mappings:
  Place:
    sources: [places]
    s: ex:place/$(n_nationkey)
    po:
      - [a, ex:Place]
      - [[ex:val, ex:name], $(n_name)]
      - [ex:area, "ex:area/$(rk)~iri"]
      - p: ex:ref
        o: {{mapping: Area, condition: {{function: equal, parameters: [[str1, $(rk)], [str2, $(r_regionkey)]]}}}}
  Area:
    sources: [areas]
    s: ex:area/$(r_regionkey)
    po: [[a, ex:Area], [ex:name, $(r_name), en~lang]]
"""
_ENGINES: dict = {}


def engine(spark: SparkSession, sf_dir: str, form: str = "ttl") -> Engine:
    """The engine over the loaded mapping; its views are resolved here, while the session's tables are those of sf_dir."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, form)
    if key not in _ENGINES:
        for t in ("nation", "region", "part", "lineitem"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        mapping = parse_r2rml(TTL, strict=True) if form == "ttl" else parse_yarrrml(YML, strict=True)
        keys = {f"view:{_PLACE}": [("n_nationkey",)], f"view:{_THING}": [("p_partkey",)], "region": [("r_regionkey",)]}
        _ENGINES[key] = Engine(spark, mapping, Catalog.from_spark(spark, mapping, keys))
    return _ENGINES[key]


def _i(kind: str, key: str) -> str:
    return f"'{EX}{kind}/'||{key}"


_P, _T, _R = f"({_PLACE}) p", f"({_THING}) t", "region r"
#: (lexical form, kind, datatype, language) of all objects of ex:val
_VAL = f"""(SELECT n_name AS v, 'L' AS k, '{XSD}string' AS d, '' AS l, {_i('place', 'n_nationkey')} AS s FROM {_P}
  UNION ALL SELECT r_name, 'L', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', 'en', {_i('area', 'r_regionkey')} FROM {_R}
  UNION ALL SELECT {_i('area', 'r_regionkey')}, 'I', NULL, NULL, {_i('area', 'r_regionkey')} FROM {_R}
  UNION ALL SELECT r_regionkey::VARCHAR, 'L', '{XSD}integer', '', 'note'||r_regionkey FROM {_R}
  UNION ALL SELECT p_size::VARCHAR, 'L', '{XSD}integer', '', {_i('thing', 'p_partkey')} FROM {_T}) x"""

#: name: (SPARQL, SQL)
SPARQL = {
    "r2rml_view": ("SELECT ?x ?n WHERE { ?x a ex:Place ; ex:name ?n }", f"SELECT {_i('place', 'n_nationkey')} AS x, n_name AS n FROM {_P}"),
    "nullable_column": ("SELECT ?x ?c WHERE { ?x ex:code ?c }", f"SELECT {_i('place', 'n_nationkey')} AS x, rk::BIGINT AS c FROM {_P} WHERE rk IS NOT NULL"),
    "ref_object_nulls": ("SELECT ?x ?n WHERE { ?x ex:ref ?a . ?a ex:name ?n }", f"SELECT {_i('place', 'n_nationkey')} AS x, r_name AS n FROM {_P} JOIN {_R} ON rk = r_regionkey"),
    "constant_object": ('SELECT ?x WHERE { ?x ex:kind "place" }', f"SELECT {_i('place', 'n_nationkey')} AS x FROM {_P}"),
    "constant_object_var": ("SELECT ?k (COUNT(*) AS ?n) WHERE { ?x ex:kind ?k } GROUP BY ?k", f"SELECT 'place' AS k, COUNT(*) AS n FROM {_P}"),
    "bgp_variable_predicate": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o . ?s a ex:Place } GROUP BY ?p",
        f"""SELECT p, n FROM (SELECT '{EX}'||k AS p, n FROM (SELECT unnest(['val', 'name', 'after', 'kind', 'code', 'area', 'ref']) AS k,
        unnest([COUNT(*), COUNT(*), COUNT(*), COUNT(*), COUNT(rk), COUNT(rk), COUNT(rk)]) AS n FROM {_P}) UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', COUNT(*) FROM {_P})"""),
    "bgp_all_triples": ("SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }",
        f"""SELECT (SELECT 5 * COUNT(*) + 3 * COUNT(rk) FROM {_P}) + (SELECT 7 * COUNT(*) FROM {_R}) + (SELECT 9 * COUNT(*) FROM {_T})
        + (SELECT COUNT(DISTINCT (l_orderkey, l_linenumber, l_returnflag)) + COUNT(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) AS n"""),
    "bgp_same_variable": ("SELECT ?x WHERE { ?x ex:self ?x }", f"SELECT {_i('thing', 'p_partkey')} AS x FROM {_T} WHERE p_partkey = p_size"),
    "bgp_no_key": ("SELECT ?x ?f WHERE { ?x ex:flag ?f ; ex:item ?x }", f"SELECT DISTINCT {_i('row', 'l_orderkey')}||'/'||l_linenumber AS x, l_returnflag AS f FROM lineitem"),
    "bgp_multi_placeholder": ("SELECT ?f WHERE { <http://ex.org/row/5979/6> ex:flag ?f }", "SELECT DISTINCT l_returnflag AS f FROM lineitem WHERE l_orderkey = 5979 AND l_linenumber = 6"),
    "bgp_percent_encode": ("SELECT ?m WHERE { ?x ex:made ?m }", f"SELECT '{EX}made/'||replace(p_name, ' ', '%20')||'?'||replace(p_brand, '#', '%23') AS m FROM {_T}"),
    "bgp_percent_decode": ("SELECT (COUNT(*) AS ?n) WHERE { ?x ex:made <http://ex.org/made/red%20widget?Brand%2317> }", f"SELECT COUNT(*) AS n FROM {_T} WHERE p_name = 'red widget' AND p_brand = 'Brand#17'"),
    "bgp_blank_subject": ("SELECT ?a ?v (isBLANK(?b) AS ?k) WHERE { ?b ex:on ?a ; ex:val ?v }", f"SELECT {_i('area', 'r_regionkey')} AS a, r_regionkey::BIGINT AS v, true AS k FROM {_R}"),
    "bgp_anonymous": ("SELECT ?v WHERE { [] ex:on [ ex:name ?v ] }", f"SELECT r_name AS v FROM {_R}"),
    "star_over_union": ("SELECT ?x ?n ?c WHERE { ?x ex:name ?n ; a ?c }", f"SELECT {_i('place', 'n_nationkey')} AS x, n_name AS n, '{EX}Place' AS c FROM {_P} UNION ALL SELECT {_i('area', 'r_regionkey')}, r_name, '{EX}Area' FROM {_R}"),
    "cross_join": ("SELECT ?n ?b WHERE { ?a a ex:Area ; ex:name ?n . ?b ex:code 1 }", f"SELECT r_name AS n, {_i('place', 'n_nationkey')} AS b FROM {_R}, {_P} WHERE rk = 1"),
    "optional_chain": ("SELECT ?x ?a ?n WHERE { ?x a ex:Place OPTIONAL { ?x ex:area ?a } OPTIONAL { ?a ex:name ?n . ?b ex:on ?a } }",
        f"SELECT {_i('place', 'n_nationkey')} AS x, {_i('area', 'coalesce(rk, r_regionkey)')} AS a, r_name AS n FROM {_P} JOIN {_R} ON rk IS NULL OR rk = r_regionkey"),
    "null_tolerant_join": ("SELECT ?x ?a ?n WHERE { ?x a ex:Place OPTIONAL { ?x ex:area ?a } ?a ex:name ?n . ?a a ex:Area }",
        f"SELECT {_i('place', 'n_nationkey')} AS x, {_i('area', 'r_regionkey')} AS a, r_name AS n FROM {_P} JOIN {_R} ON rk IS NULL OR rk = r_regionkey"),
    "null_tolerant_both": ("SELECT ?x ?y ?a WHERE { { ?x a ex:Place OPTIONAL { ?x ex:area ?a } FILTER(?x IN (ex:place\\/2, ex:place\\/3)) } { ?y a ex:Place OPTIONAL { ?y ex:area ?a } FILTER(?y IN (ex:place\\/7, ex:place\\/8, ex:place\\/9)) } }",
        f"""SELECT {_i('place', 'p.n_nationkey')} AS x, {_i('place', 'q.n_nationkey')} AS y, {_i('area', 'coalesce(p.rk, q.rk)')} AS a FROM {_P}, ({_PLACE}) q
        WHERE p.n_nationkey IN (2, 3) AND q.n_nationkey IN (7, 8, 9) AND (p.rk IS NULL OR q.rk IS NULL OR p.rk = q.rk)"""),
    "optional_no_shared": ("SELECT ?x ?n WHERE { ?x ex:code 1 OPTIONAL { ?a a ex:Area ; ex:name ?n FILTER(LANG(?n) = \"de\") } }", f"SELECT {_i('place', 'n_nationkey')} AS x, NULL AS n FROM {_P} WHERE rk = 1"),
    "optional_outer_filter": ("SELECT ?x ?c ?y WHERE { ?x ex:code ?c OPTIONAL { ?y ex:size ?s FILTER(?s = ?c * 9 + 3) } }",
        f"SELECT {_i('place', 'n_nationkey')} AS x, rk::BIGINT AS c, {_i('thing', 'p_partkey')} AS y FROM {_P} LEFT JOIN {_T} ON p_size = rk * 9 + 3 WHERE rk IS NOT NULL"),
    "minus_nullable": ("SELECT ?x WHERE { ?x a ex:Place OPTIONAL { ?x ex:area ?a } MINUS { ?y ex:on ?a . ?y ex:val 1 } }", f"SELECT {_i('place', 'n_nationkey')} AS x FROM {_P} WHERE rk IS DISTINCT FROM 1"),
    "minus_no_shared": ("SELECT ?x WHERE { ?x a ex:Place MINUS { ?y a ex:Area } }", f"SELECT {_i('place', 'n_nationkey')} AS x FROM {_P}"),
    "exists_outer": ("SELECT ?x WHERE { ?x ex:name ?n ; ex:code ?c FILTER EXISTS { ?x ex:ref ?z . ?b ex:on ?z ; ex:val ?w FILTER(?w >= ?c * ?c) } }", f"SELECT {_i('place', 'n_nationkey')} AS x FROM {_P} WHERE rk >= rk * rk"),
    "exists_other": ("SELECT ?n WHERE { ?x a ex:Area ; ex:name ?n FILTER EXISTS { ?y ex:name ?m FILTER(STR(?m) != STR(?n)) } }", f"SELECT r_name AS n FROM {_R}"),
    "not_exists_max": ("SELECT ?v WHERE { ?x ex:size ?v FILTER NOT EXISTS { ?y ex:size ?w FILTER(?w > ?v) } }", f"SELECT p_size::BIGINT AS v FROM {_T} WHERE p_size = (SELECT MAX(p_size) FROM {_T})"),
    "exists_bind": ("SELECT ?x ?f WHERE { ?x a ex:Place BIND(EXISTS { ?x ex:area ?a } AS ?f) }", f"SELECT {_i('place', 'n_nationkey')} AS x, rk IS NOT NULL AS f FROM {_P}"),
    "having_exists": ("SELECT ?a (COUNT(*) AS ?n) WHERE { ?x ex:area ?a } GROUP BY ?a HAVING(EXISTS { ?b ex:on ?a ; ex:val ?v FILTER(?v > 2) })", f"SELECT {_i('area', 'rk')} AS a, COUNT(*) AS n FROM {_P} WHERE rk > 2 GROUP BY rk"),
    "order_exists": ("SELECT ?x WHERE { ?x a ex:Place } ORDER BY DESC(EXISTS { ?x ex:area ?a }) ?x LIMIT 20", f"SELECT {_i('place', 'n_nationkey')} AS x FROM {_P} ORDER BY rk IS NULL, 1 LIMIT 20"),
    "values_undef": ("SELECT ?n ?c WHERE { VALUES (?n ?c) { (\"NATION_1\" UNDEF) (UNDEF 3) (\"NATION_2\" 4) } ?x ex:name ?n ; ex:code ?c }", f"SELECT n_name AS n, rk::BIGINT AS c FROM {_P} WHERE n_name = 'NATION_1' OR rk = 3"),
    "values_trailing": ("SELECT ?x ?c WHERE { ?x ex:code ?c } VALUES ?c { 1 4 }", f"SELECT {_i('place', 'n_nationkey')} AS x, rk::BIGINT AS c FROM {_P} WHERE rk IN (1, 4)"),
    "nested_group": ("SELECT ?x ?c WHERE { { ?x ex:code ?c FILTER(?c > 2) } { ?x a ex:Place } }", f"SELECT {_i('place', 'n_nationkey')} AS x, rk::BIGINT AS c FROM {_P} WHERE rk > 2"),
    "path_negated": ("SELECT ?s ?o WHERE { ?s !(ex:name|ex:val|rdf:type|ex:after|ex:kind|ex:area|ex:ref) ?o . ?s a ex:Place }", f"SELECT {_i('place', 'n_nationkey')} AS s, rk::VARCHAR AS o FROM {_P} WHERE rk IS NOT NULL"),
    "path_negated_inverse": ("SELECT ?a (COUNT(*) AS ?n) WHERE { ?a !(^ex:ref|^ex:val) ?x . ?a a ex:Area } GROUP BY ?a", f"SELECT {_i('area', 'r_regionkey')} AS a, 1 + COUNT(rk) AS n FROM {_R} LEFT JOIN {_P} ON rk = r_regionkey GROUP BY r_regionkey"),
    "path_zero_or_one": ("SELECT ?b WHERE { ex:place\\/3 ex:after? ?b }", f"SELECT {_i('place', 'n_nationkey')} AS b FROM {_P} WHERE n_nationkey IN (3, 4)"),
    "path_star": ("SELECT ?b WHERE { ex:place\\/3 ex:after* ?b }", f"SELECT {_i('place', 'n_nationkey')} AS b FROM {_P}"),
    "path_plus_cycle": ("SELECT ?a ?b WHERE { ?a ex:after+ ?b }", f"SELECT {_i('place', 'p.n_nationkey')} AS a, {_i('place', 'q.n_nationkey')} AS b FROM {_P}, ({_PLACE}) q"),
    "path_plus_diagonal": ("SELECT ?a WHERE { ?a ex:after+ ?a }", f"SELECT {_i('place', 'n_nationkey')} AS a FROM {_P}"),
    "path_plus_backward": ("SELECT ?a WHERE { ?a ex:after+ ex:place\\/9 }", f"SELECT {_i('place', 'n_nationkey')} AS a FROM {_P}"),
    "path_plus_bound": ("ASK { ex:place\\/9 ex:after+ ex:place\\/2 }", "SELECT true AS ask"),
    "path_zero_terms": ("SELECT (COUNT(*) AS ?n) WHERE { ?a ex:after? ?b . ?a a ex:Place }", f"SELECT 2 * COUNT(*) AS n FROM {_P}"),
    "reduced": ("SELECT REDUCED ?c WHERE { ?x ex:code ?c }", f"SELECT DISTINCT rk::BIGINT AS c FROM {_P} WHERE rk IS NOT NULL"),
    "avg": ("SELECT ?b (AVG(?s) AS ?m) (AVG(DISTINCT ?s) AS ?d) WHERE { ?x ex:big ?b ; ex:size ?s } GROUP BY ?b", f"SELECT big AS b, AVG(p_size) AS m, AVG(DISTINCT p_size) AS d FROM {_T} GROUP BY big"),
    "sample": ("SELECT ?x (SAMPLE(?n) AS ?m) WHERE { ?x ex:name ?n ; a ex:Place } GROUP BY ?x", f"SELECT {_i('place', 'n_nationkey')} AS x, n_name AS m FROM {_P}"),
    "sum_big": ("SELECT (STR(SUM(?s * 1000000000000000000)) AS ?t) WHERE { ?x ex:code ?s }", f"SELECT CAST(SUM(rk::HUGEINT * 1000000000000000000) AS VARCHAR) AS t FROM {_P}"),
    "sum_integer": ("SELECT ?b (STR(SUM(?s)) AS ?t) (STR(SUM(DISTINCT ?s) + 1) AS ?u) WHERE { ?x ex:big ?b ; ex:size ?s } GROUP BY ?b", f"SELECT big AS b, SUM(p_size)::VARCHAR AS t, (SUM(DISTINCT p_size) + 1)::VARCHAR AS u FROM {_T} GROUP BY big"),
    "group_by_expression": ("SELECT ?k (COUNT(*) AS ?n) WHERE { ?x ex:size ?s } GROUP BY (STRLEN(STR(?s)) AS ?k)", f"SELECT length(p_size::VARCHAR)::BIGINT AS k, COUNT(*) AS n FROM {_T} GROUP BY 1"),
    "group_implicit": ("SELECT (MIN(?s) AS ?a) (MAX(?p) AS ?z) WHERE { ?x ex:size ?s ; ex:price ?p }", f"SELECT MIN(p_size)::BIGINT AS a, MAX(p_retailprice) AS z FROM {_T}"),
    "order_by_count": ("SELECT ?c (COUNT(?x) AS ?n) WHERE { ?x ex:big ?c } GROUP BY ?c ORDER BY ?n LIMIT 1", f"SELECT big AS c, COUNT(*) AS n FROM {_T} GROUP BY big ORDER BY n LIMIT 1"),
    "in_not_in": ("SELECT ?x WHERE { ?x ex:code ?c FILTER(?c IN (1, 3.0) && ?c NOT IN (3)) }", f"SELECT {_i('place', 'n_nationkey')} AS x FROM {_P} WHERE rk = 1"),
    "unary": ("SELECT ?x (-?c AS ?m) (+?c AS ?q) WHERE { ?x ex:code ?c FILTER(!(?c = 3)) }", f"SELECT {_i('place', 'n_nationkey')} AS x, -rk::BIGINT AS m, rk::BIGINT AS q FROM {_P} WHERE rk <> 3"),
    "arithmetic": ("SELECT ?x (?s / 4 AS ?d) (?s * ?s - 1 AS ?e) (?s + 0.5 AS ?f) WHERE { ?x ex:size ?s }", f"SELECT {_i('thing', 'p_partkey')} AS x, p_size / 4.0::DOUBLE AS d, p_size::BIGINT * p_size - 1 AS e, p_size + 0.5::DOUBLE AS f FROM {_T}"),
    "logic_unbound": ("SELECT ?x WHERE { ?x a ex:Place OPTIONAL { ?x ex:code ?c } FILTER(?c > 3 || !BOUND(?c)) }", f"SELECT {_i('place', 'n_nationkey')} AS x FROM {_P} WHERE rk > 3 OR rk IS NULL"),
    "string_builtins": ('SELECT ?x (CONCAT(STR(?n), "-", STR(?x)) AS ?c) (STRSTARTS(?n, "NATION_1") AS ?a) (STRENDS(?n, "2") AS ?z) (LCASE(?n) AS ?l) (ENCODE_FOR_URI("a b/ç") AS ?e) WHERE { ?x a ex:Place ; ex:name ?n }',
        f"SELECT {_i('place', 'n_nationkey')} AS x, n_name||'-'||{_i('place', 'n_nationkey')} AS c, starts_with(n_name, 'NATION_1') AS a, ends_with(n_name, '2') AS z, lower(n_name) AS l, 'a%20b%2F%C3%A7' AS e FROM {_P}"),
    "number_builtins": ("SELECT ?x (ABS(-?s) AS ?a) (CEIL(?p) AS ?c) (FLOOR(?p) AS ?f) (ROUND(?p) AS ?r) (isNUMERIC(?p) AS ?n) (isNUMERIC(?x) AS ?m) WHERE { ?x ex:size ?s ; ex:price ?p }",
        f"SELECT {_i('thing', 'p_partkey')} AS x, p_size::BIGINT AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, floor(p_retailprice + 0.5) AS r, true AS n, false AS m FROM {_T}"),
    "hash_builtins": ("SELECT ?n (SHA1(?n) AS ?s) (STRLEN(SHA384(?n)) AS ?k) (STRLEN(SHA512(?n)) AS ?m) WHERE { ?x a ex:Place ; ex:name ?n }", f"SELECT n_name AS n, sha1(n_name) AS s, 96::BIGINT AS k, 128::BIGINT AS m FROM {_P}"),
    "date_builtins": ("SELECT ?x (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?t) (HOURS(?d) AS ?h) WHERE { ?x ex:since ?d FILTER(?d >= \"2001-01-01\"^^xsd:date) }",
        f"SELECT {_i('area', 'r_regionkey')} AS x, 2000 + r_regionkey::BIGINT AS y, 3::BIGINT AS m, r_regionkey::BIGINT AS t, 0::BIGINT AS h FROM {_R} WHERE r_regionkey > 0"),
    "time_zone": ('SELECT (TZ("2020-01-01T10:00:00+02:30"^^xsd:dateTime) AS ?z) (STR(TIMEZONE("2020-01-01T10:00:00+02:30"^^xsd:dateTime)) AS ?t) (MINUTES("2020-01-01T10:11:12Z"^^xsd:dateTime) AS ?m) (SECONDS("2020-01-01T10:11:12Z"^^xsd:dateTime) AS ?s) WHERE { }',
        "SELECT '+02:30' AS z, 'PT2H30M' AS t, 11::BIGINT AS m, 12::BIGINT AS s"),
    "casts_integer": ('SELECT (xsd:integer("7") AS ?a) (xsd:integer(7.9) AS ?b) (xsd:int(-7.9) AS ?c) (xsd:long(true) AS ?d) (xsd:integer("x") AS ?e) WHERE { }', "SELECT 7::BIGINT AS a, 7::BIGINT AS b, -7::BIGINT AS c, 1::BIGINT AS d, NULL AS e"),
    "casts_other": (f'SELECT (xsd:double("1.5") AS ?a) (xsd:boolean("1") AS ?b) (STR(xsd:date("2020-05-15T10:30:45")) AS ?c) (STR(xsd:dateTime("2020-05-15")) AS ?d) (xsd:string(ex:a) AS ?e) (STR(DATATYPE(xsd:float("2.5"))) AS ?f) (STR(xsd:decimal("1.25") = 1.25) AS ?g) WHERE {{ }}',
        f"SELECT 1.5::DOUBLE AS a, true AS b, '2020-05-15' AS c, '2020-05-15T00:00:00' AS d, '{EX}a' AS e, '{XSD}float' AS f, 'true' AS g"),
    "casts_column": ("SELECT ?x (xsd:integer(?p) AS ?i) (xsd:string(?s) AS ?t) (xsd:boolean(?s) AS ?b) WHERE { ?x ex:price ?p ; ex:size ?s }", f"SELECT {_i('thing', 'p_partkey')} AS x, floor(p_retailprice)::BIGINT AS i, p_size::VARCHAR AS t, p_size <> 0 AS b FROM {_T}"),
    "language_builtins": ('SELECT ?n (LANG(?n) AS ?l) (LANGMATCHES(LANG(?n), "EN") AS ?m) (LANGMATCHES(LANG(?n), "*") AS ?s) (STRLEN(?n) AS ?k) WHERE { ?x ex:name ?n ; a ex:Area }', f"SELECT r_name AS n, 'en' AS l, true AS m, true AS s, length(r_name) AS k FROM {_R}"),
    "str_dt_lang": ('SELECT ?n (DATATYPE(STRDT(?n, ex:t)) AS ?d) (LANG(STRLANG(?n, "fr")) AS ?l) (sameTerm(?n, STRDT(?n, xsd:string)) AS ?s) WHERE { ?x a ex:Place ; ex:name ?n }', f"SELECT n_name AS n, '{EX}t' AS d, 'fr' AS l, true AS s FROM {_P}"),
    "iri_bnode": ('SELECT ?n (IRI(CONCAT("http://ex.org/", ?n)) AS ?i) (isIRI(IRI(?n)) AS ?a) (isBLANK(BNODE(?n)) AS ?b) (isBLANK(BNODE()) AS ?c) (BNODE(?n) AS ?k) WHERE { ?x a ex:Place ; ex:name ?n }',
        f"SELECT n_name AS n, '{EX}'||n_name AS i, true AS a, true AS b, true AS c, 'b'||md5(n_name) AS k FROM {_P}"),
    "random_builtins": ("SELECT ?x (RAND() < 1 AS ?r) (isIRI(UUID()) AS ?u) (STRLEN(STRUUID()) AS ?s) (YEAR(NOW()) > 2000 AS ?y) WHERE { ?x a ex:Area }", f"SELECT {_i('area', 'r_regionkey')} AS x, true AS r, true AS u, 36::BIGINT AS s, true AS y FROM {_R}"),
    "regex_flags": ('SELECT ?n (REPLACE(?n, "(nation)_(\\\\d)", "$2$1", "i") AS ?r) WHERE { ?x a ex:Place ; ex:name ?n FILTER REGEX(?n, "^nation_[1-9]$", "i") }', f"SELECT n_name AS n, regexp_replace(n_name, '(?i)(nation)_(\\d)', '\\2\\1', 'g') AS r FROM {_P} WHERE regexp_matches(n_name, '(?i)^nation_[1-9]$')"),
    "dyn_term_kinds": ("SELECT ?v (isIRI(?v) AS ?i) (isLITERAL(?v) AS ?l) WHERE { ?x ex:val ?v }", f"SELECT v, k = 'I' AS i, k = 'L' AS l FROM {_VAL}"),
    "dyn_datatype": ("SELECT ?v (STR(DATATYPE(?v)) AS ?d) WHERE { ?x ex:val ?v }", f"SELECT v, d FROM {_VAL}"),
    "dyn_lang": ("SELECT ?v (LANG(?v) AS ?l) WHERE { ?x ex:val ?v }", f"SELECT v, l FROM {_VAL}"),
    "dyn_distinct": ("SELECT (COUNT(*) AS ?n) WHERE { { SELECT DISTINCT ?v WHERE { ?x ex:val ?v } } }", f"SELECT COUNT(*) AS n FROM (SELECT DISTINCT v, k, d FROM {_VAL})"),
    "dyn_group": ("SELECT ?v (COUNT(*) AS ?n) WHERE { ?x ex:val ?v } GROUP BY ?v", f"SELECT v, COUNT(*) AS n FROM {_VAL} GROUP BY v, k, d"),
    "dyn_order": ("SELECT ?v WHERE { { SELECT DISTINCT ?v WHERE { ?x ex:val ?v } } } ORDER BY ?v LIMIT 12", f"SELECT v FROM (SELECT DISTINCT v, k, d FROM {_VAL}) ORDER BY k, TRY_CAST(v AS DOUBLE) NULLS FIRST, v LIMIT 12"),
    "dyn_compare": ("SELECT ?v WHERE { ?x ex:val ?v FILTER(?v > 5) }", f"SELECT v FROM {_VAL} WHERE d = '{XSD}integer' AND TRY_CAST(v AS BIGINT) > 5"),
    "dyn_equal": ('SELECT ?v WHERE { ?x ex:val ?v FILTER(?v = "NATION_3" || ?v = ex:area\\/1 || ?v = 7) }', f"SELECT v FROM {_VAL} WHERE v IN ('NATION_3', '{EX}area/1') OR d = '{XSD}integer' AND v = '7'"),
    "dyn_minmax": ("SELECT (MIN(?v) AS ?a) (MAX(?v) AS ?z) WHERE { ?x ex:val ?v }", f"SELECT MIN(v) AS a, MAX(v) AS z FROM {_VAL}"),
    "dyn_strdt": ("SELECT ?v (isLITERAL(STRDT(STR(?v), IRI(CONCAT(\"http://ex.org/\", STR(?v))))) AS ?t) WHERE { ?x ex:val ?v }", f"SELECT v, true AS t FROM {_VAL}"),
    "dyn_join": ("SELECT ?x ?y WHERE { ?x ex:val ?v . ?y ex:size ?v . ?x ex:on ?a }", f"SELECT 'note'||r_regionkey AS x, {_i('thing', 'p_partkey')} AS y FROM {_R} JOIN {_T} ON p_size = r_regionkey"),
    "dyn_if": ('SELECT ?x (STR(DATATYPE(IF(?b, ?s, STR(?s)))) AS ?d) WHERE { ?x ex:big ?b ; ex:size ?s }', f"SELECT {_i('thing', 'p_partkey')} AS x, CASE WHEN big THEN '{XSD}integer' ELSE '{XSD}string' END AS d FROM {_T}"),
    "construct": ("CONSTRUCT { ?a ex:has ?x } WHERE { ?x ex:ref ?a }", f"SELECT '<'||{_i('area', 'rk')}||'>' AS s, '<{EX}has>' AS p, '<'||{_i('place', 'n_nationkey')}||'>' AS o FROM {_P} WHERE rk IS NOT NULL"),
    "describe": ("DESCRIBE ex:area\\/1", f"""SELECT '<{EX}area/1>' AS s, p, o FROM (SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<{EX}Area>' AS o UNION ALL SELECT '<{EX}val>', '<{EX}area/1>'
        UNION ALL SELECT unnest(['<{EX}val>', '<{EX}name>']), '"'||r_name||'"@en' FROM region WHERE r_regionkey = 1 UNION ALL SELECT '<{EX}since>', '"2001-03-01"^^<{XSD}date>')"""),
}

#: name: (DataFrame of an engine, mapping, SQL)
FORWARD = {
    "rdf_class_triples": (lambda e: rdf.quads(e).where("p = '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'").select("s", "o"), "ttl",
        f"""SELECT '<'||{_i('place', 'n_nationkey')}||'>' AS s, '<{EX}Place>' AS o FROM {_P} UNION ALL SELECT '<'||{_i('area', 'r_regionkey')}||'>', '<{EX}Area>' FROM {_R}
        UNION ALL SELECT '<'||{_i('thing', 'p_partkey')}||'>', '<{EX}Thing>' FROM {_T}"""),
    "rdf_ref_object": (lambda e: rdf.quads(e).where(f"p = '<{EX}ref>'").select("s", "o"), "ttl", f"SELECT '<'||{_i('place', 'n_nationkey')}||'>' AS s, '<'||{_i('area', 'rk')}||'>' AS o FROM {_P} WHERE rk IS NOT NULL"),
    "rdf_named_graph": (lambda e: rdf.quads(e).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("g is not null"), "ttl", f"SELECT '<{EX}areas>' AS g, 5 * COUNT(*) AS n FROM {_R}"),
    "rdf_nquads": (lambda e: rdf.lines(rdf.quads(e).where("g is not null"), True).where(F.col("value").contains("since")), "ttl",
        f"SELECT '<'||{_i('area', 'r_regionkey')}||'> <{EX}since> \"200'||r_regionkey||'-03-0'||r_regionkey||'\"^^<{XSD}date> <{EX}areas> .' AS value FROM {_R}"),
    "rdf_ntriples": (lambda e: rdf.lines(rdf.quads(e).where(f"p = '<{EX}size>'")), "ttl", f"SELECT '<'||{_i('thing', 'p_partkey')}||'> <{EX}size> \"'||p_size||'\"^^<{XSD}integer> .' AS value FROM {_T}"),
    "rdf_turtle": (lambda e: rdf.turtle(rdf.quads(e).where(f"p in ('<{EX}code>', '<{EX}kind>') and s like '%place%'")), "ttl",
        f"SELECT '<'||{_i('place', 'n_nationkey')}||'>'||chr(10)||'    '||CASE WHEN rk IS NULL THEN '' ELSE '<{EX}code> \"'||rk||'\"^^<{XSD}integer> ;'||chr(10)||'    ' END||'<{EX}kind> \"place\" .'||chr(10) AS value FROM {_P}"),
    "rdf_distinct": (lambda e: rdf.quads(e, True).where(f"p = '<{EX}flag>'").select("s", "o"), "ttl", f"SELECT DISTINCT '<'||{_i('row', 'l_orderkey')}||'/'||l_linenumber||'>' AS s, '\"'||l_returnflag||'\"' AS o FROM lineitem"),
    "rdf_yarrrml": (lambda e: rdf.quads(e).select("s", "p", "o"), "yml",
        f"""SELECT '<'||{_i('place', 'n_nationkey')}||'>' AS s, unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<{EX}val>', '<{EX}name>']) AS p, unnest(['<{EX}Place>', '"'||n_name||'"', '"'||n_name||'"']) AS o FROM {_P}
        UNION ALL SELECT '<'||{_i('place', 'n_nationkey')}||'>', unnest(['<{EX}area>', '<{EX}ref>']), '<'||{_i('area', 'rk')}||'>' FROM {_P} WHERE rk IS NOT NULL
        UNION ALL SELECT '<'||{_i('area', 'r_regionkey')}||'>', unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<{EX}name>']), unnest(['<{EX}Area>', '"'||r_name||'"@en']) FROM {_R}"""),
    "yarrrml_query": (lambda e: e.query(PREFIX + "SELECT ?x ?n WHERE { ?x ex:ref ?a . ?a ex:name ?n }"), "yml", f"SELECT {_i('place', 'n_nationkey')} AS x, r_name AS n FROM {_P} JOIN {_R} ON rk = r_regionkey"),
}


def _sparql(text: str):
    return lambda spark, sf_dir: engine(spark, sf_dir).query(PREFIX + text)


def _forward(make, form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(engine(spark, sf_dir, form))

    return run


def queries() -> dict:
    return {name: _sparql(text) for name, (text, _) in SPARQL.items()} | {name: _forward(make, form) for name, (make, form, _) in FORWARD.items()}


def oracles() -> dict:
    return {name: sql for name, (_, sql) in SPARQL.items()} | {name: sql for name, (_, _, sql) in FORWARD.items()}
