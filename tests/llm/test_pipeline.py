"""The pipeline's stages against brute force on a small table, and the queries with SQL on the smallest tables."""

import hashlib
import os
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from causeway.llm import mixing, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def _plain(rows):
    return sorted(repr(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = queries.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    want = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    at = [names.index(x) for x in columns]
    assert _plain([tuple(r[x] for x in columns) for r in got.collect()]) == _plain([tuple(r[i] for i in at) for r in want.fetchall()])


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, DIR).cache()
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "byte_bpe":
            assert now.columns == corpus_pipeline.COLUMNS
        if name == "exact_dedup":
            groups = defaultdict(list)
            for r in before.collect():
                groups["".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)].append(r.doc_id)
            assert kept[name] == {max(g) for g in groups.values()}
        if name == "near_dedup":
            from tests.llm.test_llm import brute_classes

            classes = brute_classes([(r.doc_id, r.text) for r in before.collect()])
            assert kept[name] == set(classes.values())
        if name == "source_mix":
            c = duckdb.connect()
            c.register("before_mix", before.toPandas())
            assert kept[name] == {r[0] for r in c.execute(mixing.mix_sql("before_mix", "doc_id", only_kept=True)).fetchall()}
        if name == "byte_bpe":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in now.collect())
    assert len(kept["language_id"]) >= 0.95 * docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).select("doc_id").collect()} == kept["byte_bpe"]


def test_stages_on_odd_documents(spark):
    """Nulls in any column, empty texts, repeated rows, further columns and an empty table."""
    text = "the quick brown fox jumps over the lazy dog and runs away from all the other animals"
    rows = [(1, text, "en", "src1", 5, "x"), (1, text, "en", "src1", 5, "x"), (2, None, None, None, None, None), (3, "", "en", "src0", 0, "x"), (None, text.upper(), None, "src2", None, "x"), (4, "12 34", "de", "src1", 2, "x"), (5, f"der {text} und", "de", None, 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, DIR).cache()
            assert now.count() <= start.count()
    kept = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert {r.doc_id for r in kept["language_id"](spark, docs, DIR).collect()} <= {1, 5, None}
    assert sorted(str(r.doc_id) for r in kept["exact_dedup"](spark, docs, DIR).collect()) == ["1", "1", "3", "4", "5"]


def test_entry_has_all_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} | set(queries.queries()) <= names and set(e.oracle_sql()) <= names
    assert sum(n.startswith("op") for n in queries.queries()) == 10
