"""The index that stays: one build, many searches, documents replaced and taken out."""

from pyspark.sql import functions as F

from weftline.operators.fulltext import Index


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_build_once_search_replace_compact(spark, tmp_path):
    index = Index(spark, str(tmp_path / "a"), 8)
    docs = spark.createDataFrame([(1, 10, "The signed renewal"), (2, 10, "renewal of the renewal"), (3, 20, "signed, SIGNED"), (4, 20, None), (5, None, "the 日本 end")], "id long, scope long, text string")
    index.write(docs, 0)
    assert ids(index.search(["renewal"])) == [1, 2] and ids(index.search(["Signed", "the"])) == [1] and ids(index.search(["the"])) == [1, 2, 5]
    assert ids(index.search(["signed"], scope=20)) == [3] and ids(index.search(["renewal"], scope=20)) == [] and ids(index.search(["nowhere"])) == [] and ids(index.search([])) == []
    scores = {r["id"]: r["relevance"] for r in index.search(["renewal"]).collect()}
    assert scores[2] > scores[1]
    index.write(docs.where("id = 1").selectExpr("id", "20 as scope", "'a penalty' as text"), 1)  # replaced, and moved
    index.write(spark.createDataFrame([(3, 20, None)], "id long, scope long, text string"), 2)  # taken out
    index.write(spark.createDataFrame([(3, 20, None)], "id long, scope long, text string"), 2)  # the write runs again
    assert ids(index.search(["renewal"])) == [2] and ids(index.search(["penalty"], scope=20)) == [1] and ids(index.search(["signed"])) == []
    small = index.compact(3, str(tmp_path / "b"))
    assert ids(small.search(["renewal"])) == [2] and ids(small.search(["penalty"])) == [1] and ids(small.search(["signed"])) == []
    assert spark.read.parquet(str(tmp_path / "b/postings")).where("token = 'signed'").isEmpty()
    small.write(docs.where("id = 3"), 4)
    assert ids(small.search(["signed"])) == [3]


def test_a_search_reads_its_buckets_alone(spark, tmp_path):
    index = Index(spark, str(tmp_path), 16)
    index.write(spark.createDataFrame([(i, 0, " ".join(chr(97 + (i + k) % 26) * 3 for k in range(9))) for i in range(60)], "id long, scope long, text string"), 0)
    plan = index.postings(["aaa"])._jdf.queryExecution().executedPlan().toString()
    partitions, pushed = plan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "bucket" in partitions and "EqualTo(token,aaa)" in pushed
    assert index.postings(["aaa"]).select(F.input_file_name()).distinct().count() == 1 < len(spark.read.parquet(str(tmp_path / "postings")).inputFiles())
