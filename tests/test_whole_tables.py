"""Queries over whole tables: rows that the older queries' filters leave out count."""

from ferrule.plans import catalogue


def test_requirement_gap_reads_every_document(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(10, "alpha"), (11, "beta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.id for r in catalogue.QUERIES["requirement_gap"](spark, str(tmp_path)).collect()] == ["gamma"]


def test_references_come_from_every_line(spark, tmp_path):
    spark.createDataFrame([(7,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    rows = [(3, 7, 1, 10.0, "2024-01-01"), (4, 7, 2, 40.0, "2024-01-02")]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r.file_id, r.refs) for r in run("history_refcounts")] == [(7, 2)]
    assert sorted((r.src, r.dst, r.sites) for r in run("edge_sites")) == [("p7", "s4", 1), ("p7", "s5", 1), ("s3", "p7", 1), ("s4", "p7", 1)]


def test_term_counts_shuffle_no_texts(spark, tmp_path):
    """Texts are counted where they are read; rows of one id, a null one too, are one document; rows without terms count as documents."""
    rows = [(1, "alpha beta alpha\nbeta"), (1, "beta gammaRay"), (2, "alpha 中文"), (None, "beta"), (None, "beta delta_x"), (3, ""), (4, None)]
    data = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    data.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.term: r.df for r in catalogue.QUERIES["term_df_idf"](spark, str(tmp_path)).collect()}
    assert got == {"alpha": 2, "beta": 2, "gamma": 1, "ray": 1, "gammaray": 1, "delta": 1, "x": 1, "deltax": 1, "中文": 1, "文": 1}
    apart = f"{tmp_path}/apart"
    spark.range(4).selectExpr("id doc_id", "concat('word', id) text", "'en' lang", "'s' source").repartition(40).write.option("maxRecordsPerFile", 1).parquet(f"{apart}/documents.parquet")
    plan = catalogue.QUERIES["term_df_idf"](spark, apart)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term#" in plan and "hashpartitioning(doc#" not in plan
