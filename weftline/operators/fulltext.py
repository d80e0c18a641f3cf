"""A full-text index that stays: postings in buckets by token, written once, searched many times, replaced by document.

A write is a generation: its documents and their postings, each in a folder of its number, over what a failed try left
there. A document's newest generation counts, and the postings of older ones are passed over until `compact` removes
them. A search reads only the buckets of its words, and of those only the words' rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.plans.views import view, work_dir

TOKEN = "([a-z]+)"
POSTING, DOCUMENT = "token string, id long, tf long, generation long, bucket int", "id long, scope long, generation long"


class Index:
    """The index in a folder that all executors reach. `buckets` is fixed when the first generation is written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, token):
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def write(self, docs: DataFrame, generation: int) -> None:
        """Index (id, scope, text) rows; those whose id is there already are replaced. Null texts take a document out. Ids are unique in a write."""
        docs.select("id", F.col("scope").cast("long").alias("scope")).write.mode("overwrite").parquet(f"{self.path}/documents/generation={generation}")
        tokens = docs.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 1)).alias("token"))
        counted = tokens.groupBy("token", "id").agg(F.count("*").alias("tf")).withColumn("bucket", self._bucket("token"))
        counted.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/generation={generation}")

    def documents(self) -> DataFrame:
        """The newest generation of each document."""
        seen = self.spark.read.schema(DOCUMENT).parquet(f"{self.path}/documents")
        return seen.groupBy("id").agg(F.max_by("scope", "generation").alias("scope"), F.max("generation").alias("generation"))

    def postings(self, words: list[str]) -> DataFrame:
        """The rows of the words, from their buckets alone."""
        wanted = sorted({r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(self._bucket("w")).collect()})
        found = self.spark.read.schema(POSTING).parquet(f"{self.path}/postings")
        return found.where(F.col("bucket").isin(wanted) & F.col("token").isin(words))

    def search(self, words: list[str], scope: int | None = None) -> DataFrame:
        """id, relevance of the documents (of one scope) that hold all the words. Words are lower-cased; without words, nothing is found.

        How rare a word is counts over all documents that hold text or not, whatever the scope.
        """
        words = sorted({w.lower() for w in words if w})
        if not words:
            return self.spark.createDataFrame([], "id long, relevance double")
        now = self.documents()
        hits = self.postings(words).join(now, ["id", "generation"])
        spread = hits.groupBy("token").agg(F.count("*").alias("df"))
        n = now.count()
        hits = hits if scope is None else hits.where(F.col("scope") == scope)
        rare = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        scored = hits.join(spread, "token").groupBy("id").agg(F.round(F.sum(F.col("tf") / (F.col("tf") + 1.2) * rare), 6).alias("relevance"), F.count("*").alias("held"))
        return scored.where(F.col("held") == len(words)).drop("held")

    def compact(self, generation: int, into: str) -> Index:
        """A new index without what was replaced, as one generation in another folder."""
        out = Index(self.spark, into, self.buckets)
        now = self.documents()
        now.select("id", "scope").write.mode("overwrite").parquet(f"{into}/documents/generation={generation}")
        kept = self.spark.read.schema(POSTING).parquet(f"{self.path}/postings").join(now.select("id", "generation"), ["id", "generation"], "left_semi").drop("generation")
        kept.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/postings/generation={generation}")
        return out


@query("j30b_indexed_search", """
    with hits as (select id, w, count(*) as tf from (select id, UNNEST(FILTER(EXTRACT_ALL(lower(text), '([a-z]+)', 1), w, w in ('the', 'and', 'that'))) as w from documents_) x group by id, w),
    sizes as (select count(*) as n from documents_), spread as (select w, count(*) as df from hits group by w)
    select h.id, round(sum(h.tf / (h.tf + 1.2e0) * ln(1e0 + (s.n - p.df + 0.5e0) / (p.df + 0.5e0))), 6) as relevance from hits h join spread p on p.w = h.w cross join sizes s group by h.id having count(*) = 3""")
def indexed_search(spark, sf_dir):
    """All documents, indexed with wrong texts for some, which the next write puts right, then searched."""
    docs = view(spark, sf_dir, "documents_").select("id", F.lit(0).alias("scope"), "text")
    index = Index(spark, work_dir(spark))
    index.write(docs.withColumn("text", F.when(F.col("id") % 7 == 0, F.lit("the and that the")).otherwise(F.col("text"))), 0)
    index.write(docs.where("id % 7 = 0"), 1)
    return index.search(["the", "and", "that"])
