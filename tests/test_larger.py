"""Queries against their SQL on made-up tables: what the smallest tables do not hold."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.operators import sketch
from spanloom.plans import registry


def same_as_sql(spark, folder, name, **tables):
    """The rows of query ``name`` over (DataFrames by table name), held against its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    result = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    rows = got.collect()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == want
    return rows


def test_html_to_text_of_cut_references(spark, tmp_path):
    rows = [(1, "<title>the&amp;&amp</title><p>a &quot b &amp;lt; &lt;i&gt; &copy;</p>"), (2, "<h1>x&quot;&quo</h1>y&am"), (3, "&amp;amp;&nbsp;")]
    same_as_sql(spark, tmp_path, "html_to_text", pages=spark.createDataFrame(rows, "page_id long, html string"))


def test_bloom_estimate_of_a_full_filter(spark, tmp_path):
    texts = spark.range(3000).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), (F.col("id") * 1000 + i).cast("string"))), " ").alias("text"))
    (row,) = same_as_sql(spark, tmp_path, "bloom_estimate", documents=texts)
    assert tuple(row) == (sketch.BLOOM_BITS, float("inf"))


def test_distill_validation_makes_no_row_for_each_cell_of_a_document(spark, tmp_path):
    rows = [(1, "a b c d e f g"), (2, "h i j a a"), (2, "k l"), (3, None), (4, "--"), (5, "x y z"), (None, "a")]
    vectors = [(1, [0.5, -1.0, 2.0]), (2, [1.0, 0.25, -0.5]), (3, [1.0, 1.0, 1.0]), (4, [1.0, 1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    documents, embeddings = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    same_as_sql(spark, tmp_path, "distill_validation", documents=documents, embeddings=embeddings)
    plan = registry.queries()["distill_validation"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # words, buckets and dimensions stay inside rows


@pytest.mark.parametrize("name", ["adaptive_budget", "cortical_head", "multihead_search", "rrf_fusion"])
def test_heads_read_each_chunk_once(spark, tmp_path, name):
    words = "anes oner edst thou not refund billed approved Été x_1 of the denied 503".split()
    rows = [(i, "s", "\n".join(" ".join(words[(i * 7 + j * j + k) % (5 + i % 9)] for k in range(14)) + "." for j in range(10 + 9 * (i % 11)))) for i in range(60)]
    rows += [(90, "s", None), (91, "s", ""), (92, "s", " \t\n"), (93, "s", " anes\x0boner \u00a0 edst thou")]
    same_as_sql(spark, tmp_path, name, documents=spark.createDataFrame(rows, "doc_id long, source string, text string"))
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # no lambda hashes each word and pair of the chunks (the sentences of the ten best hits alone are scored that way)
    assert name == "multihead_search" or "md5(" not in plan and "zip_with" not in plan


def test_keep_one_compares_every_holder_of_a_rare_shingle(spark):
    """Two near texts whose shared shingles all have other first and last holders, none of them near."""
    simhash = pytest.importorskip("spanloom.llm.simhash")
    rnd = random.Random(3)
    base = ["w%d" % i for i in range(300)]
    near = [*base[:150], base[151], base[150], *base[152:]]
    rows = [(0, sorted(base)), (1000, base), (1001, near)]
    for at in (10, 2000):  # the first and the last holders: one half in order, the other shuffled
        for i in range(40):
            cut = 120 if i % 2 else 180
            head, tail = base[:cut], base[cut:]
            rnd.shuffle(head if i % 2 else tail)
            rows.append((at + i, head + tail))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i, _ in rows} - {1001}
