"""Registered queries over the test tables, each with SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.graph import Graph
from graphloom.operators import schema
from graphloom.operators.lookup import TripleServer, decode_columns
from graphloom.operators.match import TableStore
from graphloom.operators.solutions import Solutions
from graphloom.operators.updates import add_triples, by_entity, remove_triples
from graphloom.sources import ntriples
from graphloom.sources.rows import EntityRows
from graphloom.sources.tables import entity_tables

PREFIX = "PREFIX v: <urn:v:> PREFIX c: <urn:class:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
RDF_TYPE = T.RDF_TYPE
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def tables_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_tables(spark, entity_tables(spark, sf_dir))


def triples_of(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Triples of some tables; of all without names."""
    found = entity_tables(spark, sf_dir)
    return TableStore(spark, [t for t in found if not names or t.name in names]).triples()


def rows_of(spark: SparkSession, sf_dir: str, *names: str) -> EntityRows:
    """The same, by entity."""
    return TableStore(spark, [t for t in entity_tables(spark, sf_dir) if not names or t.name in names]).entity_rows()


def _sparql(name: str, text: str, sql: str, **options) -> None:
    _QUERIES[name] = lambda spark, sf_dir: tables_graph(spark, sf_dir).query(PREFIX + text, **options)
    _SQL[name] = sql


def _direct(name: str, sql: str | None):
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def _iri(table: str, key: str) -> str:
    return f"'<urn:{table}:' || {key} || '>'"


def _lit(column: str) -> str:
    return f"""'"' || cast({column} as varchar) || '"'"""


def _triples_sql(*tables: str) -> str:
    """The mapping of entity tables to triples, in SQL."""
    line = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_quantity as bigint)"
    spec = {
        "region": ("r_regionkey", [("r_name", _lit("r_name"))]),
        "nation": ("n_nationkey", [("n_name", _lit("n_name")), ("n_region", _iri("region", "n_regionkey"))]),
        "customer": ("c_custkey", [("c_name", _lit("c_name")), ("c_segment", _lit("c_mktsegment")), ("c_acctbal", _lit("c_acctbal")), ("c_nation", _iri("nation", "c_nationkey"))]),
        "supplier": ("s_suppkey", [("s_name", _lit("s_name")), ("s_acctbal", _lit("s_acctbal")), ("s_nation", _iri("nation", "s_nationkey"))]),
        "part": ("p_partkey", [(p, _lit(p)) for p in ("p_name", "p_brand", "p_type", "p_size")]),
        "orders": ("o_orderkey", [("o_status", _lit("o_orderstatus")), ("o_priority", _lit("o_orderpriority")), ("o_totalprice", _lit("o_totalprice")), ("o_date", _lit("o_orderdate")), ("o_cust", _iri("customer", "o_custkey"))]),
        "lineitem": (line, [("l_order", _iri("orders", "l_orderkey")), ("l_part", _iri("part", "l_partkey")), ("l_supp", _iri("supplier", "l_suppkey")), ("l_quantity", _lit("l_quantity")), ("l_returnflag", _lit("l_returnflag")), ("l_linestatus", _lit("l_linestatus"))]),
        "events": ("event_id", [("e_type", _lit("event_type")), ("e_value", _lit("value")), ("e_ts", _lit("ts")), ("e_user", _iri("customer", "user_id"))]),
        "documents": ("doc_id", [("d_lang", _lit("lang")), ("d_source", _lit("source"))]),
        "labels": ("doc_id", [("d_quality", _lit("quality")), ("d_toxic", _lit("toxic"))]),
        "conversations": ("conv_id || '-' || turn", [("t_role", _lit("role")), ("t_conv", _iri("conversation", "conv_id"))]),
    }
    parts = []
    for t in tables or spec:
        key, pairs = spec[t]
        subject = _iri("documents" if t == "labels" else t, key)
        if t != "labels":
            pairs = [*pairs, (None, f"'<urn:class:{t.capitalize()}>'")]
        parts += [f"select {subject} s, '{f'<urn:v:{p}>' if p else RDF_TYPE}' p, {o} o from {t}" for p, o in pairs]
    return "(select * from (" + " union all ".join(parts) + ") where o is not null)"


FLAGSHIP = """SELECT ?cust ?cname ?nname ?order ?status WHERE {
  ?order v:o_cust ?cust . ?order v:o_status ?status .
  ?cust v:c_name ?cname . ?cust v:c_nation ?n .
  ?n v:n_name ?nname . ?n v:n_region ?r . ?r v:r_name "ASIA" . }"""
_FLAGSHIP_SQL = f"""select {_iri("customer", "c_custkey")} cust, {_lit("c_name")} cname, {_lit("n_name")} nname, {_iri("orders", "o_orderkey")} "order", {_lit("o_orderstatus")} status
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables_graph(spark, sf_dir).query(PREFIX + FLAGSHIP)


_CUSTOMER, _NATION, _ORDER = _iri("customer", "c_custkey"), _iri("nation", "n_nationkey"), _iri("orders", "o_orderkey")

_sparql("bgp_single_pattern", "SELECT ?c ?name WHERE { ?c v:c_name ?name }", f"select {_CUSTOMER} c, {_lit('c_name')} name from customer")
_sparql("bgp_star", "SELECT ?c ?name ?seg ?n WHERE { ?c v:c_name ?name ; v:c_segment ?seg ; v:c_nation ?n }", f"select {_CUSTOMER} c, {_lit('c_name')} name, {_lit('c_mktsegment')} seg, {_iri('nation', 'c_nationkey')} n from customer")
_sparql("bgp_chain3", "SELECT ?o ?c ?n ?r WHERE { ?o v:o_cust ?c . ?c v:c_nation ?n . ?n v:n_region ?r }", f"select {_ORDER} o, {_CUSTOMER} c, {_NATION} n, {_iri('region', 'n_regionkey')} r from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
_sparql("bgp_snowflake", FLAGSHIP, _FLAGSHIP_SQL)
_sparql(
    "bgp_triangle",
    "SELECT ?l ?s ?c ?n WHERE { ?l v:l_order ?o . ?l v:l_supp ?s . ?o v:o_cust ?c . ?c v:c_nation ?n . ?s v:s_nation ?n }",
    f"select {_iri('lineitem', 'l_orderkey || chr(45) || l_linenumber || chr(45) || l_partkey || chr(45) || l_suppkey || chr(45) || cast(l_quantity as bigint)')} l, {_iri('supplier', 's_suppkey')} s, {_CUSTOMER} c, {_iri('nation', 's_nationkey')} n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey",
)
_sparql("bgp_constant_object", 'SELECT ?c ?name WHERE { ?c v:c_segment "BUILDING" . ?c v:c_name ?name }', f"select {_CUSTOMER} c, {_lit('c_name')} name from customer where c_mktsegment = 'BUILDING'")
_sparql("bgp_constant_subject", "SELECT ?name ?n WHERE { <urn:customer:7> v:c_name ?name ; v:c_nation ?n }", f"select {_lit('c_name')} name, {_iri('nation', 'c_nationkey')} n from customer where c_custkey = 7")
_sparql("bgp_existential_leaf", "SELECT ?r ?rn WHERE { ?r v:r_name ?rn . ?n v:n_region ?r . ?n v:n_name ?unused }", f"select {_iri('region', 'r_regionkey')} r, {_lit('r_name')} rn from region join nation on n_regionkey = r_regionkey")
_sparql("bgp_type_fold", "SELECT ?c ?n WHERE { ?c a c:Customer ; v:c_nation ?n }", f"select {_CUSTOMER} c, {_iri('nation', 'c_nationkey')} n from customer")
_sparql("bgp_var_type_object", "SELECT ?t ?x WHERE { ?x a ?t . ?x v:n_name ?name }", f"select '<urn:class:Nation>' t, {_NATION} x from nation")
_sparql("bgp_var_predicate", "SELECT ?p ?o WHERE { <urn:nation:3> ?p ?o }", f"select p, o from {_triples_sql('nation')} where s = '<urn:nation:3>'")
_sparql("bgp_inverse_multivalue", "SELECT ?n ?c WHERE { ?n v:n_name ?x . ?c v:c_nation ?n }", f"select {_NATION} n, {_CUSTOMER} c from nation join customer on c_nationkey = n_nationkey")
_sparql("bgp_repeated_predicate", "SELECT ?a ?b ?n WHERE { ?a v:s_nation ?n . ?b v:s_nation ?n }", f"select {_iri('supplier', 'a.s_suppkey')} a, {_iri('supplier', 'b.s_suppkey')} b, {_iri('nation', 'a.s_nationkey')} n from supplier a join supplier b on a.s_nationkey = b.s_nationkey")
_sparql("bgp_cartesian", "SELECT ?rn ?nn WHERE { ?r v:r_name ?rn . ?n v:n_name ?nn }", f"select {_lit('r_name')} rn, {_lit('n_name')} nn from region, nation")
_sparql("bgp_two_sources", "SELECT ?d ?lang ?q WHERE { ?d v:d_lang ?lang ; v:d_quality ?q }", f"select {_iri('documents', 'd.doc_id')} d, {_lit('lang')} lang, {_lit('quality')} q from documents d join labels l on d.doc_id = l.doc_id")
_sparql("bgp_sparql_bag", "SELECT ?r WHERE { ?n v:n_region ?r . ?n v:n_name ?x }", f"select {_iri('region', 'n_regionkey')} r from nation", mode="sparql")
_sparql("q_distinct", "SELECT DISTINCT ?seg WHERE { ?c v:c_segment ?seg . ?o v:o_cust ?c }", f"select distinct {_lit('c_mktsegment')} seg from customer join orders on o_custkey = c_custkey")
_sparql("q_filter_num", "SELECT ?c ?b WHERE { ?c v:c_acctbal ?b FILTER(?b > 5000 && ?b <= 9000.5) }", f"select {_CUSTOMER} c, {_lit('c_acctbal')} b from customer where c_acctbal > 5000 and c_acctbal <= 9000.5")
_sparql("q_filter_regex", 'SELECT ?n ?x WHERE { ?n v:n_name ?x FILTER regex(?x, "^nation_1[0-4]$", "i") }', f"select {_NATION} n, {_lit('n_name')} x from nation where regexp_matches(n_name, '^NATION_1[0-4]$')")
_sparql("q_filter_text", 'SELECT ?n ?x WHERE { ?n v:n_name ?x FILTER(strlen(str(?x)) > 8 || ?x IN ("NATION_3", "NATION_5")) FILTER isLiteral(?x) }', f"select {_NATION} n, {_lit('n_name')} x from nation where length(n_name) > 8 or n_name in ('NATION_3', 'NATION_5')")
_sparql("q_optional", "SELECT ?d ?q WHERE { ?d v:d_lang ?l OPTIONAL { ?d v:d_quality ?q } }", f"select {_iri('documents', 'd.doc_id')} d, {_lit('quality')} q from documents d left join labels l on d.doc_id = l.doc_id")
_sparql("q_union", "SELECT ?x ?n WHERE { { ?x v:c_nation ?n } UNION { ?x v:s_nation ?n } }", f"select {_CUSTOMER} x, {_iri('nation', 'c_nationkey')} n from customer union all select {_iri('supplier', 's_suppkey')}, {_iri('nation', 's_nationkey')} from supplier")
_sparql("q_minus", "SELECT ?d ?l WHERE { ?d v:d_lang ?l MINUS { ?d v:d_toxic ?t } }", f"select {_iri('documents', 'doc_id')} d, {_lit('lang')} l from documents where doc_id not in (select doc_id from labels)")
_sparql("q_exists", "SELECT ?c WHERE { ?c v:c_name ?name FILTER EXISTS { ?o v:o_cust ?c } }", f"select {_CUSTOMER} c from customer where c_custkey in (select o_custkey from orders)")
_sparql("q_order_limit", "SELECT ?c ?b WHERE { ?c v:c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 10 OFFSET 5", f"select {_CUSTOMER} c, {_lit('c_acctbal')} b from customer order by c_acctbal desc, 1 limit 10 offset 5")
_sparql("q_count_group", "SELECT ?seg (COUNT(?c) AS ?n) (COUNT(DISTINCT ?nat) AS ?k) WHERE { ?c v:c_segment ?seg ; v:c_nation ?nat } GROUP BY ?seg HAVING (COUNT(?c) > 1)", f"select {_lit('c_mktsegment')} seg, count(*) n, count(distinct c_nationkey) k from customer group by c_mktsegment having count(*) > 1")
_sparql("q_aggregates", "SELECT ?n (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) WHERE { ?c v:c_nation ?n ; v:c_acctbal ?b } GROUP BY ?n", f"select {_iri('nation', 'c_nationkey')} n, {_lit('min(c_acctbal)')} lo, {_lit('max(c_acctbal)')} hi from customer group by c_nationkey")
_sparql("q_aggregates_text", "SELECT ?b (MIN(?n) AS ?lo) (MAX(?n) AS ?hi) (SAMPLE(?n) AS ?pick) (MIN(?z) AS ?least) WHERE { ?p v:p_brand ?b ; v:p_name ?n ; v:p_size ?z } GROUP BY ?b", f"select {_lit('p_brand')} b, {_lit('min(p_name)')} lo, {_lit('max(p_name)')} hi, {_lit('min(p_name)')} pick, {_lit('min(p_size)')} least from part group by p_brand")
_sparql("q_aggregates_distinct", "SELECT ?b (SUM(DISTINCT ?z) AS ?total) (AVG(DISTINCT ?z) AS ?mean) (AVG(?z) AS ?plain) WHERE { ?p v:p_brand ?b ; v:p_size ?z } GROUP BY ?b", f"select {_lit('p_brand')} b, cast(sum(distinct p_size) as double) total, avg(distinct p_size) mean, avg(p_size) plain from part group by p_brand", mode="sparql")
_sparql("q_having_range", "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c v:c_nation ?n ; v:c_acctbal ?b } GROUP BY ?n HAVING (MAX(?b) - MIN(?b) > 9000 && COUNT(?c) > 2)", f"select {_iri('nation', 'c_nationkey')} n, count(*) k from customer group by c_nationkey having max(c_acctbal) - min(c_acctbal) > 9000 and count(*) > 2")
_sparql("q_distinct_order_limit", "SELECT DISTINCT ?seg WHERE { ?c v:c_segment ?seg } ORDER BY DESC(?seg) LIMIT 3 OFFSET 1", f"select {_lit('c_mktsegment')} seg from (select distinct c_mktsegment from customer order by 1 desc limit 3 offset 1)")
_sparql("q_distinct_order_hidden", "SELECT DISTINCT ?n WHERE { ?c v:c_nation ?n ; v:c_acctbal ?b } ORDER BY ?b LIMIT 4", f"select {_iri('nation', 'c_nationkey')} n from (select c_nationkey from customer group by 1 order by min(c_acctbal) limit 4)")
_sparql("q_exists_unshared", 'SELECT ?r WHERE { ?r v:r_name ?x FILTER EXISTS { ?n v:n_name "NATION_3" } FILTER NOT EXISTS { ?m v:n_name "NOWHERE" } }', f"select {_iri('region', 'r_regionkey')} r from region")
_sparql("q_optional_first", "SELECT ?n ?x ?r WHERE { OPTIONAL { ?n v:n_region ?r } ?n v:n_name ?x }", f"select {_NATION} n, {_lit('n_name')} x, {_iri('region', 'n_regionkey')} r from nation", mode="sparql")
_sparql("q_optional_alone", 'SELECT ?n ?x WHERE { OPTIONAL { ?n v:n_name ?x FILTER(?x = "NOWHERE") } }', "select cast(null as varchar) n, cast(null as varchar) x")
_sparql("q_term_functions", 'SELECT ?n ?k ?s ?t WHERE { ?n v:n_name ?x ; v:n_region ?r BIND(isIRI(?r) && !isBlank(?r) && isLiteral(?x) && bound(?x) AS ?k) BIND(xsd:integer(strlen(str(?x))) * 2 - -1 AS ?s) BIND(sameTerm(?r, <urn:region:1>) AS ?t) FILTER(lang(?x) = "" && !langMatches(lang(?x), "*")) }', f"""select {_NATION} n, '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>' k, '"' || cast(cast(2 * length(n_name) + 1 as double) as varchar) || '"^^<http://www.w3.org/2001/XMLSchema#double>' s, '"' || (n_regionkey = 1)::varchar || '"^^<http://www.w3.org/2001/XMLSchema#boolean>' t from nation""")
_sparql("q_values", 'SELECT ?n ?name WHERE { VALUES ?name { "NATION_3" "NATION_17" "NOWHERE" } ?n v:n_name ?name }', f"select {_NATION} n, {_lit('n_name')} name from nation where n_name in ('NATION_3', 'NATION_17')")
_sparql("q_bind", 'SELECT ?n ?up WHERE { ?n v:n_name ?x BIND(concat("N-", lcase(str(?x))) AS ?up) }', f"""select {_NATION} n, '"N-' || lower(n_name) || '"' up from nation""")
_sparql("q_subselect", "SELECT ?c ?name WHERE { ?c v:c_name ?name { SELECT DISTINCT ?c WHERE { ?o v:o_cust ?c } } }", f"select {_CUSTOMER} c, {_lit('c_name')} name from customer where c_custkey in (select o_custkey from orders)")


@_direct("bgp_shared_var_predicate", f"select a.s a, a.p p, a.o o, b.s b from {_triples_sql('nation', 'region')} a join {_triples_sql('nation', 'region')} b on a.p = b.p and a.o = b.o")
def _(spark, sf_dir):
    graph = Graph.from_triples(triples_of(spark, sf_dir, "nation", "region"), distinct=False)
    return graph.query("SELECT ?a ?p ?o ?b WHERE { ?a ?p ?o . ?b ?p ?o }")


@_direct("bgp_inverse_predicates", f"with t as {_triples_sql('nation', 'region')}, b as (select s, p, o from t union all select o, '_' || p, s from t) select p, o from b where s = '<urn:region:1>'")
def _(spark, sf_dir):
    graph = Graph.from_triples(triples_of(spark, sf_dir, "nation", "region"), distinct=False)
    return graph.query("SELECT ?p ?o WHERE { <urn:region:1> ?p ?o }", inverse_predicates=True)


@_direct("bgp_triples_snowflake", _FLAGSHIP_SQL)
def _(spark, sf_dir):
    """The flagship over plain triples: joins per predicate instead of entity tables."""
    return Graph.from_triples(triples_of(spark, sf_dir, "orders", "customer", "nation", "region"), distinct=False).query(PREFIX + FLAGSHIP)


@_direct("bgp_encoded_snowflake", _FLAGSHIP_SQL)
def _(spark, sf_dir):
    """The flagship over ids of the whole graph, stars read by type ranges."""
    return tables_graph(spark, sf_dir).encoded().query(PREFIX + FLAGSHIP)


@_direct("bgp_encoded_var_predicate", f"select p, o from {_triples_sql()} where s = '<urn:nation:7>'")
def _(spark, sf_dir):
    return tables_graph(spark, sf_dir).encoded().query(PREFIX + "SELECT ?p ?o WHERE { <urn:nation:7> ?p ?o }")


_sparql("q_path_sequence", "SELECT ?c ?name WHERE { ?c v:c_nation/v:n_region/v:r_name ?name }", f"select {_CUSTOMER} c, {_lit('r_name')} as name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
_sparql("q_path_alternative", "SELECT ?x ?n WHERE { ?x v:c_nation|v:s_nation ?n }", f"select {_CUSTOMER} x, {_iri('nation', 'c_nationkey')} n from customer union all select {_iri('supplier', 's_suppkey')}, {_iri('nation', 's_nationkey')} from supplier")
_sparql("q_path_inverse", "SELECT ?n ?s WHERE { ?n ^v:s_nation ?s ; v:n_region <urn:region:2> }", f"select {_NATION} n, {_iri('supplier', 's_suppkey')} s from nation join supplier on s_nationkey = n_nationkey where n_regionkey = 2")
_sparql(
    "q_path_repeated_to",
    "SELECT ?x WHERE { ?x (v:o_cust|v:c_nation|v:n_region)+ <urn:region:2> }",
    f"with n as (select * from nation where n_regionkey = 2), c as (select * from customer join n on c_nationkey = n_nationkey) select {_NATION} x from n union all select {_CUSTOMER} from c union all select {_ORDER} from orders join c on o_custkey = c_custkey",
)
_sparql(
    "q_path_repeated",
    "SELECT ?x ?y WHERE { ?x (v:c_nation|v:n_region)+ ?y }",
    f"select {_NATION} x, {_iri('region', 'n_regionkey')} y from nation union all select {_CUSTOMER}, {_iri('nation', 'c_nationkey')} from customer union all select {_CUSTOMER}, {_iri('region', 'n_regionkey')} from customer join nation on c_nationkey = n_nationkey",
)


@_direct("bgp_entity_star", f"select {_CUSTOMER} c, {_lit('c_name')} name, {_lit('c_mktsegment')} seg, {_iri('nation', 'c_nationkey')} n from customer")
def _(spark, sf_dir):
    """A star read from whole entities (predicate -> objects) with one scan."""
    return Graph.from_triples(triples_of(spark, sf_dir, "customer"), distinct=False).with_entities().query(PREFIX + "SELECT ?c ?name ?seg ?n WHERE { ?c v:c_name ?name ; v:c_segment ?seg ; v:c_nation ?n ; a c:Customer }")


def _server(spark: SparkSession, sf_dir: str, *names: str) -> TripleServer:
    return TripleServer(triples_of(spark, sf_dir, *names))


@_direct("api_get_preds", f"select distinct p from {_triples_sql('customer')} where s = '<urn:customer:5>'")
def _(spark, sf_dir):
    return _server(spark, sf_dir, "customer").predicates_of("<urn:customer:5>")


@_direct("api_get_objs", f"select o from {_triples_sql('customer')} where s = '<urn:customer:5>' and p = '<urn:v:c_name>'")
def _(spark, sf_dir):
    return _server(spark, sf_dir, "customer").objects("<urn:customer:5>", "<urn:v:c_name>")


@_direct("api_get_subjs", f"select s from {_triples_sql('customer')} where p = '<urn:v:c_nation>' and o = '<urn:nation:2>'")
def _(spark, sf_dir):
    return _server(spark, sf_dir, "customer").subjects("<urn:v:c_nation>", "<urn:nation:2>")


@_direct("api_all_out", f"select o from {_triples_sql('nation')} where s = '<urn:nation:2>'")
def _(spark, sf_dir):
    return _server(spark, sf_dir, "nation").neighbours_out("<urn:nation:2>")


@_direct("api_all_in", f"select s from {_triples_sql('nation', 'customer', 'supplier')} where o = '<urn:nation:2>'")
def _(spark, sf_dir):
    return _server(spark, sf_dir, "nation", "customer", "supplier").neighbours_in("<urn:nation:2>")


@_direct("api_subjects_having", f"select s from {_triples_sql('documents', 'labels')} where p in ('<urn:v:d_lang>', '<urn:v:d_toxic>') group by s having count(distinct p) = 2")
def _(spark, sf_dir):
    return _server(spark, sf_dir, "documents", "labels").subjects_having(["<urn:v:d_lang>", "<urn:v:d_toxic>"])


_SET_SQL = "select s, string_agg(distinct p, ' ' order by p) preds from {t} group by s"


@_direct("schema_char_sets", f"select preds, count(*) n from ({_SET_SQL.format(t=_triples_sql())}) group by preds")
def _(spark, sf_dir):
    return schema.characteristic_sets(rows_of(spark, sf_dir)).select(F.array_join("preds", " ").alias("preds"), "n")


_FOLD_SQL = f"(select s, case when p = '{RDF_TYPE}' then p || ' ' || o else p end p, o from {_triples_sql()})"


@_direct("schema_folded_sets", f"select preds, count(*) n from ({_SET_SQL.format(t=_FOLD_SQL)}) group by preds")
def _(spark, sf_dir):
    return schema.characteristic_sets(rows_of(spark, sf_dir), fold=True).select(F.array_join("preds", " ").alias("preds"), "n")


_TYPED = _triples_sql()
_TYPES_SQL = f"with sets as ({_SET_SQL.format(t=_TYPED)}), types as (select preds, count(*) n, row_number() over (order by count(*) desc, preds) tid from sets group by preds)"


@_direct("schema_entity_types", f"{_TYPES_SQL} select s, cast(tid as integer) tid from sets join types using (preds)")
def _(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return schema.entity_types(rows, schema.type_table(rows))


@_direct("schema_predicates", f"select p pred, cast(row_number() over (order by p) as integer) pid from (select distinct p from {_triples_sql()})")
def _(spark, sf_dir):
    return schema.predicate_ids(rows_of(spark, sf_dir))


@_direct("limit_topk_types", f"{_TYPES_SQL} select preds, n from types order by n desc, preds limit 2")
def _(spark, sf_dir):
    return schema.characteristic_sets(rows_of(spark, sf_dir), top=2).select(F.array_join("preds", " ").alias("preds"), "n")


@_direct("select_by_type", f"{_TYPES_SQL} select s, p, o from {_triples_sql()} t join sets using (s) join types using (preds) where tid in (1, 3)")
def _(spark, sf_dir):
    return tables_graph(spark, sf_dir).encoded().of_types([1, 3])


@_direct("stats_selectivity", f"{_TYPES_SQL}, typed as (select s, tid from sets join types using (preds)) select cast(tid as integer) tid, p, count(distinct s) n, count(distinct o) n_objects, round(count(distinct o) / count(distinct s), 6) sel from {_TYPED} join typed using (s) group by tid, p")
def _(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    found = schema.selectivity(rows, schema.type_table(rows))
    return found.withColumn("sel", F.round("sel", 6))


@_direct("stats_twig_size", f"select count(*) n_roots, cast(sum(a * b) as bigint) n_rows from (select s, count(*) filter (p = '_<urn:v:c_nation>') a, count(*) filter (p = '_<urn:v:s_nation>') b from (select o s, '_' || p p from {_triples_sql('customer', 'supplier')}) group by s) where a * b > 0")
def _(spark, sf_dir):
    inverse = ntriples.reversed_triples(triples_of(spark, sf_dir, "customer", "supplier"))
    return schema.twig_size(inverse, ["_<urn:v:c_nation>", "_<urn:v:s_nation>"])


@_direct("ingest_reverse_pairs", f"with t as {_triples_sql()} select s, p, o from t union all select o, '_' || p, s from t")
def _(spark, sf_dir):
    return ntriples.paired(triples_of(spark, sf_dir))


@_direct("ingest_dedup", f"select distinct s, p, o from {_triples_sql()}")
def _(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return ntriples.merge(rows, rows)


@_direct("dict_encode_decode", f"select s, p, o from {_triples_sql()}")
def _(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    terms, predicates = schema.dictionary(rows, schema.type_table(rows)), schema.predicate_ids(rows)
    return schema.decode(schema.encoded_parts(rows, terms, predicates), terms, predicates)


@_direct("dict_terms", f"""with t as {_triples_sql()}, sets as ({_SET_SQL.format(t="t")}), types as (select preds, row_number() over (order by count(*) desc, preds) tid from sets group by preds),
terms as (select s term, tid from sets join types using (preds) union all select distinct o, 0 from t where o not in (select s from t))
select term, cast(tid as integer) tid, cast(tid * 281474976710656 + row_number() over (partition by tid order by term) as bigint) eid from terms""")
def _(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return schema.dictionary(rows, schema.type_table(rows))


@_direct("dict_decode_solutions", f"select {_NATION} n, {_iri('region', 'n_regionkey')} r from nation")
def _(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    terms, predicates = schema.dictionary(rows, schema.type_table(rows)), schema.predicate_ids(rows)
    # Triples of other predicates need no ids here.
    ids = schema.encode(rows.only(["<urn:v:n_region>"]), terms, predicates).join(predicates.filter("pred = '<urn:v:n_region>'"), "pid").select(F.col("sid").alias("n"), F.col("oid").alias("r"))
    return decode_columns(ids, ["n", "r"], terms).select("n", "r")


@_direct("entities_by_subject", f"select s, p, string_agg(o, ' ' order by o) os from {_triples_sql()} group by s, p")
def _(spark, sf_dir):
    return by_entity(rows_of(spark, sf_dir)).select("s", "p", F.array_join("os", " ").alias("os"))


def _nations(spark: SparkSession, sf_dir: str) -> Solutions:
    return tables_graph(spark, sf_dir).solutions(PREFIX + "SELECT ?n ?name ?r WHERE { ?n v:n_name ?name ; v:n_region ?r }")


_SOL_SQL = f"select {_NATION} n, {_lit('n_name')} name, {_iri('region', 'n_regionkey')} r from nation"


@_direct("sol_filter", f"select * from ({_SOL_SQL}) where r = '<urn:region:2>' and length(name) > 7")
def _(spark, sf_dir):
    return _nations(spark, sf_dir).filter(lambda r, name: (r == "<urn:region:2>") & (F.length(name) > 7), "r", "name").df


@_direct("sol_expand", f"select n, name, r, unnest(string_split(name, 'A')) part from ({_SOL_SQL})")
def _(spark, sf_dir):
    return _nations(spark, sf_dir).expand("name", "part", lambda c: F.split(c, "A")).df


@_direct("sol_product", f"select n, name, r, k from ({_SOL_SQL}), (values ('x'), ('y')) v(k)")
def _(spark, sf_dir):
    return _nations(spark, sf_dir).product("k", ["x", "y"]).df


@_direct("sol_join", f"select n, name, r, {_lit('r_name')} rname from ({_SOL_SQL}) join region on r = {_iri('region', 'r_regionkey')}")
def _(spark, sf_dir):
    regions = tables_graph(spark, sf_dir).solutions(PREFIX + "SELECT ?r ?rname WHERE { ?r v:r_name ?rname }")
    return _nations(spark, sf_dir).join(regions).df


@_direct("sol_select", f"select r, n from ({_SOL_SQL})")
def _(spark, sf_dir):
    return _nations(spark, sf_dir).select("r", "n").df


@_direct("sol_distinct", f"select distinct r from ({_SOL_SQL})")
def _(spark, sf_dir):
    return _nations(spark, sf_dir).distinct_values("r")


@_direct("sol_distinct_all", f"select distinct 'n' head, n as value from ({_SOL_SQL}) union all select distinct 'name', name from ({_SOL_SQL}) union all select distinct 'r', r from ({_SOL_SQL})")
def _(spark, sf_dir):
    return _nations(spark, sf_dir).all_distinct_values()


@_direct("update_add", f"select s, p, o from {_triples_sql()} union select '<urn:nation:99>', '<urn:v:n_name>', '\"ATLANTIS\"'")
def _(spark, sf_dir):
    new = spark.createDataFrame([("<urn:nation:99>", "<urn:v:n_name>", '"ATLANTIS"'), ("<urn:nation:99>", "<urn:v:n_name>", '"ATLANTIS"')], "s string, p string, o string")
    return add_triples(rows_of(spark, sf_dir), new)


@_direct("update_remove", f"select s, p, o from {_triples_sql()} where p <> '<urn:v:n_name>'")
def _(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return remove_triples(rows.triples(), rows.only(["<urn:v:n_name>"]).triples())


# A query whose two edges lead from one subject to one value: rows where both agree.
_QUERIES["bgp_parallel_edges"] = lambda spark, sf_dir: Graph.from_triples(triples_of(spark, sf_dir, "nation", "region").union(triples_of(spark, sf_dir, "nation").filter("p = '<urn:v:n_region>'").withColumn("p", F.lit("<urn:v:near>"))), distinct=False).query(PREFIX + "SELECT ?n ?r WHERE { ?n v:n_region ?r . ?n v:near ?r }")
_SQL["bgp_parallel_edges"] = f"select {_NATION} n, {_iri('region', 'n_regionkey')} r from nation"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
