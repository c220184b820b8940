"""Queries of the driver contract: a mapping over the test tables, SPARQL queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import plans_loaded
from .engine import Catalog, Engine
from .mapping import Mapping, RefMap, TriplesMap, column, predicate_object, template
from .operators import rdf

EX = "http://ex.org/"
PREFIX = f"PREFIX ex: <{EX}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
#: name: (class, template, key, {property: column}, {link: (template of the object)})
_TABLES = {
    "region": ("Region", "region/{r_regionkey}", ("r_regionkey",), {"name": "r_name"}, {}),
    "nation": ("Nation", "nation/{n_nationkey}", ("n_nationkey",), {"name": "n_name"}, {"inRegion": "region/{n_regionkey}"}),
    "customer": ("Customer", "customer/{c_custkey}", ("c_custkey",), {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}, {"inNation": "nation/{c_nationkey}"}),
    "supplier": ("Supplier", "supplier/{s_suppkey}", ("s_suppkey",), {"name": "s_name", "balance": "s_acctbal"}, {"inNation": "nation/{s_nationkey}"}),
    "part": ("Part", "part/{p_partkey}", ("p_partkey",), {"name": "p_name", "brand": "p_brand", "size": "p_size", "price": "p_retailprice"}, {}),
    "orders": ("Order", "order/{o_orderkey}", ("o_orderkey",), {"status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority"}, {"placedBy": "customer/{o_custkey}"}),
    "lineitem": ("LineItem", "line/{l_orderkey}/{l_linenumber}/{l_partkey}/{l_suppkey}/{l_shipdate}", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"),
                 {"quantity": "l_quantity", "extended": "l_extendedprice", "discount": "l_discount", "shipped": "l_shipdate", "flag": "l_returnflag"},
                 {"ofOrder": "order/{l_orderkey}", "ofPart": "part/{l_partkey}", "fromSupplier": "supplier/{l_suppkey}"}),
    "documents": ("Document", "document/{doc_id}", ("doc_id",), {"language": "lang", "origin": "source", "chars": "n_chars"}, {}),
    "labels": ("Label", "label/{doc_id}", ("doc_id",), {"quality": "quality", "toxic": "toxic"}, {"about": "document/{doc_id}"}),
}
_NEXT = "SELECT a.conv_id, a.turn, a.role, b.turn AS next_turn FROM {t} a LEFT JOIN {t} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def mapping() -> Mapping:
    maps = {}
    for table, (cls, subject, _, props, links) in _TABLES.items():
        pos = [predicate_object(EX + p, column(c)) for p, c in props.items()] + [predicate_object(EX + p, template(EX + t)) for p, t in links.items()]
        maps[EX + cls] = TriplesMap(EX + cls, template(EX + subject), table=table, classes=(EX + cls,), pos=pos)
    maps[EX + "Nation"].pos.append(predicate_object(EX + "regionOf", RefMap(EX + "Region", (("n_regionkey", "r_regionkey"),))))
    turn = [predicate_object(EX + "role", column("role")), predicate_object(EX + "next", template(EX + "turn/{conv_id}/{next_turn}"))]
    maps[EX + "Message"] = TriplesMap(EX + "Message", template(EX + "turn/{conv_id}/{turn}"), table="turns", classes=(EX + "Message",), pos=turn)
    return Mapping(maps)


_ENGINES: dict = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine a session and folder: table schemas are read once."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _ENGINES:
        _ENGINES[key] = new_engine(spark, sf_dir)
    return _ENGINES[key]


def new_engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    cat = Catalog(spark)
    for table, (_, _, key, _, _) in _TABLES.items():
        cat.add(table, spark.read.parquet(f"{sf_dir}/{table}.parquet"), key)
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    conv.createOrReplaceTempView("conversation_turns")
    cat.add("turns", spark.sql(_NEXT.format(t="conversation_turns")), ("conv_id", "turn"))
    return Engine(spark, mapping(), cat, **options)


def _iri(kind: str, key: str) -> str:
    return f"'{EX}{kind}/'||{key}"


#: name: (SPARQL, SQL)
SPARQL = {
    "flagship": ("""SELECT ?o (SUM(?e * (1 - ?d)) AS ?revenue) WHERE { ?c ex:segment "BUILDING" . ?o ex:placedBy ?c ; ex:date ?t .
        ?l ex:ofOrder ?o ; ex:extended ?e ; ex:discount ?d . FILTER(?t < "1995-03-15T00:00:00"^^xsd:dateTime) } GROUP BY ?o ORDER BY DESC(?revenue) ?o LIMIT 10""",
        f"""SELECT {_iri('order', 'o_orderkey')} AS o, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey
        JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' GROUP BY o_orderkey ORDER BY 2 DESC, 1 LIMIT 10"""),
    "bgp_star": ("SELECT ?n ?b ?s WHERE { ?c ex:name ?n ; ex:balance ?b ; ex:segment ?s }", "SELECT c_name AS n, c_acctbal AS b, c_mktsegment AS s FROM customer"),
    "bgp_chain": ('SELECT ?n ?r WHERE { ?x a ex:Nation ; ex:name ?n ; ex:inRegion ?g . ?g ex:name ?r . FILTER(?r = "ASIA") }',
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "bgp_bound_subject": ("SELECT ?p ?o WHERE { ex:nation\\/7 ?p ?o }", f"""SELECT * FROM (SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{EX}Nation' AS o UNION ALL
        SELECT '{EX}name', n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT '{EX}inRegion', {_iri('region', 'n_regionkey')} FROM nation WHERE n_nationkey = 7
        UNION ALL SELECT '{EX}regionOf', {_iri('region', 'n_regionkey')} FROM nation WHERE n_nationkey = 7)"""),
    "bgp_bound_object": ("SELECT ?c WHERE { ?c ex:inNation ex:nation\\/3 }", f"SELECT {_iri('customer', 'c_custkey')} AS c FROM customer WHERE c_nationkey = 3 UNION ALL SELECT {_iri('supplier', 's_suppkey')} FROM supplier WHERE s_nationkey = 3"),
    "bgp_multi_candidate": ("SELECT ?x ?n WHERE { ?x ex:name ?n }", " UNION ALL ".join(f"SELECT {_iri(k, c)} AS x, {n} AS n FROM {t}" for k, c, n, t in
        (("region", "r_regionkey", "r_name", "region"), ("nation", "n_nationkey", "n_name", "nation"), ("customer", "c_custkey", "c_name", "customer"), ("supplier", "s_suppkey", "s_name", "supplier"), ("part", "p_partkey", "p_name", "part")))),
    "ref_object": ("SELECT ?n ?r WHERE { ?n ex:regionOf ?r }", f"SELECT {_iri('nation', 'n_nationkey')} AS n, {_iri('region', 'n_regionkey')} AS r FROM nation"),
    "optional": ("SELECT ?d ?t WHERE { ?d a ex:Document . OPTIONAL { ?l ex:about ?d ; ex:toxic ?t } }", f"SELECT {_iri('document', 'd.doc_id')} AS d, toxic::BIGINT AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "optional_filter": ("SELECT ?d ?t WHERE { ?d a ex:Document . OPTIONAL { ?l ex:about ?d ; ex:toxic ?t FILTER(?t = 1) } }", f"SELECT {_iri('document', 'd.doc_id')} AS d, toxic::BIGINT AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND toxic = 1"),
    "union_mismatched": ("SELECT ?r ?n WHERE { { ?r a ex:Region } UNION { ?n a ex:Nation } }", f"SELECT {_iri('region', 'r_regionkey')} AS r, NULL AS n FROM region UNION ALL SELECT NULL, {_iri('nation', 'n_nationkey')} FROM nation"),
    "minus": ("SELECT ?d WHERE { ?d a ex:Document . MINUS { ?l ex:about ?d } }", f"SELECT {_iri('document', 'doc_id')} AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "exists": ("SELECT ?d WHERE { ?d a ex:Document . FILTER EXISTS { ?l ex:about ?d ; ex:toxic 1 } }", f"SELECT {_iri('document', 'doc_id')} AS d FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "not_exists": ("SELECT ?o WHERE { ?o a ex:Order . FILTER NOT EXISTS { ?l ex:ofOrder ?o } }", f"SELECT {_iri('order', 'o_orderkey')} AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "exists_in_or": ("SELECT ?d WHERE { ?d ex:language ?g . FILTER(?g = \"de\" || EXISTS { ?l ex:about ?d ; ex:toxic 1 }) }", f"SELECT {_iri('document', 'doc_id')} AS d FROM documents WHERE lang = 'de' OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "values": ('SELECT ?n ?s WHERE { VALUES ?s { "BUILDING" "MACHINERY" } ?c ex:segment ?s ; ex:name ?n }', "SELECT c_name AS n, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "subquery": ("SELECT ?n ?k WHERE { { SELECT ?x (COUNT(*) AS ?k) WHERE { ?c a ex:Customer ; ex:inNation ?x } GROUP BY ?x } ?x ex:name ?n }", "SELECT n_name AS n, COUNT(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"),
    "bind": ("SELECT ?n ?z WHERE { ?p a ex:Part ; ex:name ?n ; ex:size ?s . BIND(?s * 2 + 1 AS ?z) }", "SELECT p_name AS n, p_size::BIGINT * 2 + 1 AS z FROM part"),
    "path_seq": ("SELECT ?c ?r WHERE { ?c a ex:Customer ; ex:inNation/ex:inRegion ?r }", f"SELECT {_iri('customer', 'c_custkey')} AS c, {_iri('region', 'n_regionkey')} AS r FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "path_inverse": ("SELECT ?r ?n WHERE { ?r ^ex:inRegion ?n }", f"SELECT {_iri('region', 'n_regionkey')} AS r, {_iri('nation', 'n_nationkey')} AS n FROM nation"),
    "path_alt": ("SELECT ?n ?r WHERE { ?n ex:inRegion|ex:regionOf ?r }", f"SELECT {_iri('nation', 'n_nationkey')} AS n, {_iri('region', 'n_regionkey')} AS r FROM nation, (VALUES (1), (2))"),
    "path_plus": ("SELECT ?a ?b WHERE { ?a ex:next+ ?b }", f"SELECT {_iri('turn', 'a.conv_id')}||'/'||a.turn AS a, {_iri('turn', 'b.conv_id')}||'/'||b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn"),
    "path_plus_forward": ("SELECT ?b WHERE { ex:turn\\/0\\/0 ex:next+ ?b }", f"SELECT {_iri('turn', 'conv_id')}||'/'||turn AS b FROM conversations WHERE conv_id = 0 AND turn > 0"),
    "count_distinct": ("SELECT (COUNT(DISTINCT ?s) AS ?n) (COUNT(*) AS ?k) WHERE { ?c ex:segment ?s }", "SELECT COUNT(DISTINCT c_mktsegment) AS n, COUNT(*) AS k FROM customer"),
    "aggregates": ("SELECT ?f (COUNT(?q) AS ?n) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) (SUM(?q) AS ?s) WHERE { ?l ex:flag ?f ; ex:quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, COUNT(*) AS n, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, SUM(l_quantity) AS s FROM lineitem GROUP BY 1"),
    "having": ("SELECT ?b (COUNT(*) AS ?n) WHERE { ?p ex:brand ?b } GROUP BY ?b HAVING(COUNT(*) > 5)", "SELECT p_brand AS b, COUNT(*) AS n FROM part GROUP BY 1 HAVING COUNT(*) > 5"),
    "group_concat": ('SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=",") AS ?l) WHERE { ?x ex:inRegion ?r ; ex:name ?n } GROUP BY ?r', f"SELECT {_iri('region', 'n_regionkey')} AS r, string_agg(n_name, ',' ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey"),
    "distinct": ("SELECT DISTINCT ?s WHERE { ?c ex:segment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "order_limit": ("SELECT ?o ?t WHERE { ?o ex:total ?t } ORDER BY DESC(?t) ?o LIMIT 20 OFFSET 5", f"SELECT {_iri('order', 'o_orderkey')} AS o, o_totalprice AS t FROM orders ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5"),
    "ask_true": ("ASK { ?c ex:segment \"BUILDING\" }", "SELECT COUNT(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "ask_false": ("ASK { ?c ex:segment \"NOTHING\" }", "SELECT COUNT(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'NOTHING'"),
    "compare_date": ("SELECT ?o WHERE { ?o ex:date ?t . FILTER(?t >= \"1996-01-01T00:00:00\"^^xsd:dateTime && YEAR(?t) < 1997) }", f"SELECT {_iri('order', 'o_orderkey')} AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND year(o_orderdate) < 1997"),
    "string_functions": ('SELECT ?n (UCASE(?n) AS ?u) (STRLEN(?n) AS ?k) (SUBSTR(?n, 2, 3) AS ?s) (STRBEFORE(?n, "A") AS ?b) (STRAFTER(?n, "A") AS ?a) (CONTAINS(?n, "IA") AS ?c) WHERE { ?x a ex:Nation ; ex:name ?n }',
        "SELECT n_name AS n, upper(n_name) AS u, length(n_name) AS k, substr(n_name, 2, 3) AS s, CASE WHEN strpos(n_name, 'A') > 0 THEN substr(n_name, 1, strpos(n_name, 'A') - 1) ELSE '' END AS b, CASE WHEN strpos(n_name, 'A') > 0 THEN substr(n_name, strpos(n_name, 'A') + 1) ELSE '' END AS a, contains(n_name, 'IA') AS c FROM nation"),
    "regex_replace": ('SELECT ?n (REPLACE(?n, "[AE]", "_") AS ?r) WHERE { ?x a ex:Nation ; ex:name ?n . FILTER REGEX(?n, "on_1.*$", "i") }', "SELECT n_name AS n, regexp_replace(n_name, '[AE]', '_', 'g') AS r FROM nation WHERE regexp_matches(n_name, '(?i)on_1.*$')"),
    "if_coalesce": ('SELECT ?d (COALESCE(?t, -1) AS ?c) (IF(BOUND(?t), "yes", "no") AS ?i) WHERE { ?d a ex:Document . OPTIONAL { ?l ex:about ?d ; ex:toxic ?t } }', f"SELECT {_iri('document', 'd.doc_id')} AS d, coalesce(toxic, -1)::BIGINT AS c, CASE WHEN toxic IS NOT NULL THEN 'yes' ELSE 'no' END AS i FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "hashes": ("SELECT ?n (MD5(?n) AS ?m) (SHA256(?n) AS ?s) WHERE { ?x a ex:Region ; ex:name ?n }", "SELECT r_name AS n, md5(r_name) AS m, sha256(r_name) AS s FROM region"),
    "term_kinds": ("SELECT ?n (isIRI(?x) AS ?i) (isLITERAL(?n) AS ?l) (DATATYPE(?n) AS ?d) (LANG(?n) AS ?g) WHERE { ?x a ex:Region ; ex:name ?n }", "SELECT r_name AS n, true AS i, true AS l, 'http://www.w3.org/2001/XMLSchema#string' AS d, '' AS g FROM region"),
}


def _sparql(text: str):
    return lambda spark, sf_dir: engine(spark, sf_dir).query(PREFIX + text)


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.quads(engine(spark, sf_dir))


def queries() -> dict:
    return {name: _sparql(text) for name, (text, _) in SPARQL.items()} | {"rdf_quads": _quads} | plans_loaded.queries()


def oracles() -> dict:
    return {name: sql for name, (_, sql) in SPARQL.items()} | plans_loaded.oracles()
