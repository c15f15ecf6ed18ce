"""Entity rows against the same triples: subjects that repeat, in one table or over several."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE
from graphloom.operators import schema
from graphloom.operators.match import TableStore
from graphloom.sources.tables import EntityTable


def tables(spark):
    people = spark.createDataFrame([(1, "x", None), (2, None, "q"), (1, "x", "r"), (3, "y", "q"), (4, "z", "s"), (3, "y", "q")], "k int, a string, b string")
    extra = spark.createDataFrame([(2, "u"), (5, "v"), (6, None)], "k int, c string")
    things = spark.createDataFrame([(1, "<p:1>"), (2, None), (3, "<p:9>")], "k int, d string")
    key = lambda t: F.concat(F.lit(f"<{t}:"), F.col("k").cast("string"), F.lit(">"))
    return [
        EntityTable("people", lambda: people, key("p"), {"<a>": F.col("a"), "<b>": F.col("b")}, "<P>", "<p:"),
        EntityTable("extra", lambda: extra, key("p"), {"<c>": F.col("c")}, None, "<p:"),
        EntityTable("things", lambda: things, key("t"), {"<d>": F.col("d")}, "<T>", "<t:"),
    ]


@pytest.fixture(params=[[0, 1, 2], [0, 2], [1, 2]])
def rows(spark, request):
    found = tables(spark)
    return TableStore(spark, [found[k] for k in request.param]).entity_rows()


def bag(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("fold", [False, True])
def test_schema_of_rows_is_that_of_their_triples(rows, fold):
    triples = rows.triples()
    assert bag(schema.characteristic_sets(rows, fold)) == bag(schema.characteristic_sets(triples, fold))
    assert bag(schema.type_table(rows, fold)) == bag(schema.type_table(triples, fold))
    types = schema.type_table(triples, fold, top=1)
    assert bag(schema.entity_types(rows, types, fold)) == bag(schema.entity_types(triples, types, fold))
    assert bag(schema.dictionary(rows, types, fold)) == bag(schema.dictionary(triples, types, fold))
    assert bag(schema.predicate_ids(rows)) == bag(schema.predicate_ids(triples))


def test_rows_of_single_subjects_are_not_exchanged(spark):
    """Only hashes of subjects are: no exchange by subject, before or after the adaptive plan."""
    rows = TableStore(spark, [tables(spark)[2]]).entity_rows()
    plan = schema.characteristic_sets(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s#" not in plan and "hashpartitioning(m0#" in plan


def test_many_predicates_take_more_mask_columns(spark):
    wide = spark.createDataFrame([(1, "x"), (2, None)], "k int, a string")
    values = {f"<p{k:03}>": F.col("a") if k % 2 else F.lit("c") for k in range(130)}
    rows = TableStore(spark, [EntityTable("w", lambda: wide, F.col("k").cast("string"), values, None, "")]).entity_rows()
    assert bag(schema.characteristic_sets(rows)) == bag(schema.characteristic_sets(rows.triples()))
    assert RDF_TYPE not in rows.names()


def test_numbers_go_on_over_tasks(spark):
    from graphloom.functions.numbering import number_in_groups

    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("t"), F.lpad("id", 5, "0")).alias("s"))
    found = number_in_groups(df.repartition(7), "g", "s", "n").orderBy("g", "s").collect()
    assert [(r.g, r.n) for r in found] == [(g, n) for g in range(3) for n in range(1, len(range(g, 5000, 3)) + 1)]


def test_updates_and_merge_of_rows(spark, rows):
    from graphloom.operators import updates
    from graphloom.sources import ntriples

    triples = rows.triples()
    new = spark.createDataFrame([("<p:1>", "<a>", "x"), ("<t:1>", "<d>", "<new>"), ("<n>", "<a>", "v"), ("<n>", "<a>", "v")], "s string, p string, o string")
    assert bag(updates.add_triples(rows, new)) == bag(updates.add_triples(triples, new))
    assert bag(ntriples.merge(rows, rows)) == bag(triples.distinct())
    assert bag(updates.by_entity(rows)) == bag(updates.by_entity(triples))


def test_small_removals_leave_triples_where_they_are(spark):
    from graphloom.operators import updates

    rows = TableStore(spark, tables(spark)[2:]).entity_rows()
    left = updates.remove_triples(rows.triples(), rows.only(["<d>"]).triples())
    assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
    assert {r.p for r in left.collect()} == {RDF_TYPE}


def test_encoded_rows_are_those_of_their_triples(spark, rows):
    from graphloom.graph import Graph

    triples = rows.triples().distinct()
    types = schema.type_table(triples)
    assert bag(schema.selectivity(rows, types)) == bag(schema.selectivity(triples, schema.entity_types(triples, types)))
    terms, predicates = schema.dictionary(rows, types), schema.predicate_ids(rows)
    assert bag(schema.decode(schema.encode(rows, terms, predicates), terms, predicates)) == bag(rows.triples())
    assert bag(schema.triples_of_types(rows, types, [1, 3])) == bag(Graph.from_triples(triples).of_types([1, 3]))


def test_pairs_of_one_value_are_spread_over_tasks(spark, monkeypatch):
    from graphloom.graph import Graph
    from graphloom.operators import match

    monkeypatch.setattr(match, "GROUP", 64)

    rows = spark.range(2500).select(F.concat(F.lit("<s"), F.col("id").cast("string"), F.lit(">")).alias("s"), F.lit("<p>").alias("p"), F.when(F.col("id") < 3, "<few>").otherwise("<one>").alias("o"))
    found = Graph.from_triples(rows, distinct=False).query("SELECT ?a ?b ?n WHERE { ?a <p> ?n . ?b <p> ?n }")
    counts = [r["count"] for r in found.withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()]
    assert sum(counts) == 2497**2 + 9 and len(counts) == 4 and max(counts) < 2497**2 / 2
    assert found.distinct().count() == sum(counts)


def test_types_are_selected_without_ids(spark, monkeypatch):
    """Triples of types need the types of subjects, found once; no dictionary."""
    from graphloom.graph import Graph
    from graphloom.sources.rows import EntityRows

    calls = []
    repeated = EntityRows.repeated
    monkeypatch.setattr(schema, "dictionary", lambda *_: calls.append("dictionary"))
    monkeypatch.setattr(EntityRows, "repeated", lambda *a: calls.append("hashes") or repeated(*a))
    graph = Graph.from_tables(spark, tables(spark)[::2])
    found = bag(graph.encoded().of_types([1, 3]))
    assert calls == ["hashes"]
    triples = graph.triples().distinct()
    assert found == bag(Graph.from_triples(triples).of_types([1, 3]))


def test_one_subject_leaves_the_dictionary_where_it_is(spark, monkeypatch):
    """What is said of one subject is looked up without an exchange of all terms."""
    from graphloom.graph import Graph
    from graphloom.operators import match

    plans, kept = [], getattr(match, "stored", None)
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(match, "stored", lambda df, name: plan(df) or kept(df, name), raising=False)
    many = spark.range(30000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("a"))
    graph = Graph.from_tables(spark, [*tables(spark)[:2], EntityTable("many", lambda: many, F.concat(F.lit("<m:"), F.col("k").cast("string"), F.lit(">")), {"<a>": F.col("a")}, "<M>", "<m:")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        found = graph.encoded().query("SELECT ?p ?o WHERE { <p:1> ?p ?o }")
        plan(found)
        assert bag(found) == bag(Graph.from_triples(graph.triples()).query("SELECT ?p ?o WHERE { <p:1> ?p ?o }"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Plans that read the dictionary know it by its places.
    assert any("_at#" in p for p in plans) and not any("SortMergeJoin" in p and "_at#" in p for p in plans)


@pytest.mark.parametrize("few", [0, 4, 1000])
def test_round_trip_with_few_and_many_objects(spark, rows, monkeypatch, few):
    """Objects looked up by broadcast, by exchange or both: the same triples; few objects are not exchanged."""
    monkeypatch.setattr(schema, "FEW", few)
    types = schema.type_table(rows)
    terms, predicates = schema.dictionary(rows, types), schema.predicate_ids(rows)
    parts = schema.encoded_parts(rows, terms, predicates)
    assert len(parts) == (2 if few == 4 else 1)
    assert bag(schema.decode(parts, terms, predicates)) == bag(rows.triples())
    whole = schema.encode(rows, terms, predicates)
    assert bag(whole) == bag(schema.encode(rows.triples(), terms, predicates))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = schema.encoded_parts(rows, terms, predicates)[0][0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in plan) == (few == 0)
