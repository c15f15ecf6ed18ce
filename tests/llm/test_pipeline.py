"""The whole pipeline against plain Python on the smallest tables; the SQL of the operators that have one."""

import os
import re
from collections import defaultdict

import duckdb
import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from graphloom.llm import quality, queries, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.score(docs).filter("kept").collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect() if r.doc_id in kept}
    groups = defaultdict(set)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a == b or both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                groups[a].add(b)
    stay = set()
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in groups[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        if a == min(seen):
            stay.add(a)
    texts = {r.doc_id: r.text for r in secrets.redact(docs, count="n_chars").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == stay
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    for d, pieces in parts.items():
        ids = b"".join(p for _, p in sorted(pieces))
        assert ids[-4:] == b"\0\0\0\0"
        assert memoryview(ids[:-4]).cast("I").tolist() == t.encode(texts[d], add_special_tokens=False).ids


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in found.description)
    want = found.df()[names]
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == names
    by = ["doc_id"] if "doc_id" in names else ["query_id", "rank"]
    assert got[names].sort_values(by).astype(object).values.tolist() == want.sort_values(by).astype(object).values.tolist()
