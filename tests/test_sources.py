"""File readers on temp files: multi-line fields, doubled quotes, extra
fields, unclosed quotes, header cleanup and the column resolver."""
import pytest
from pyspark.sql import functions as F

from namespotter.sources.files import (clean_header, load_dictionary_csv, load_dictionary_lines,
                                       load_documents_csv, load_text_files, require_rows, resolve_text_column)

CSV = ('"publishedDate","sequenceId","title","content"\n'
       '"2024-01-01T00:00:00Z","1","A","line one\nline two with ""quotes"""\n'
       '"2024-01-02T00:00:00Z","2","B","plain"\n'
       '"2024-01-03T00:00:00Z","3","C","x","extra"\n'
       '"2024-01-04T00:00:00Z","4","D","never closed\n')


def test_documents_csv_good_and_rejects(spark, tmp_path):
    p = tmp_path / "doc.csv"
    p.write_text(CSV)
    good, rejects = load_documents_csv(spark, str(p))
    rows = {r.sequenceId: r.content for r in good.collect()}
    assert rows["1"] == 'line one\nline two with "quotes"'
    assert rows["2"] == "plain"
    assert "3" not in rows
    assert rejects.count() >= 1
    assert resolve_text_column(good) == "content"


def test_resolver_is_case_sensitive(spark):
    df = spark.createDataFrame([("x",)], "TEXT string")
    with pytest.raises(ValueError):
        resolve_text_column(df)
    assert resolve_text_column(spark.createDataFrame([("x", "y")], "text string, Text string")) == "Text"


def test_clean_header(spark):
    df = spark.createDataFrame([(1,)], '`"a"` int')
    assert clean_header(df).columns == ["a"]


def test_dictionary_readers(spark, tmp_path):
    p = tmp_path / "companies.csv"
    p.write_text('Acme Inc.,US\n"Foo, Bar",X\nAcme Inc.,US\n\n  Spaced   Name  \n')
    first = [r.name for r in load_dictionary_csv(spark, str(p)).orderBy("entity_id").collect()]
    assert first[:3] == ["Acme Inc.", "Foo, Bar", "Acme Inc."]      # duplicates kept, field 0
    lines = [r.name for r in load_dictionary_lines(spark, str(p)).orderBy("entity_id").collect()]
    assert lines == ["Acme Inc.,US", '"Foo, Bar",X', "Acme Inc.,US", "Spaced Name"]


def test_whole_text_and_empty(spark, tmp_path):
    p = tmp_path / "doc.txt"
    p.write_text("one two\nthree")
    t = load_text_files(spark, str(p)).collect()
    assert len(t) == 1 and t[0].text == "one two\nthree"
    with pytest.raises(ValueError):
        require_rows(spark.createDataFrame([], "text string"))


def test_a_single_row_group_of_many_splits_is_spread(spark, tmp_path):
    from namespotter.sources.tables import documents
    rows = spark.range(4000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 256) AS text").coalesce(1)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        cores = spark.sparkContext.defaultParallelism
        assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() >= cores
        sizes = documents(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert 2 * len(sizes) >= cores and sum(r["count"] for r in sizes) == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
