"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fold

#: Rows of labels used for fitting at most, and the longest text used for it (characters).
ROWS, LONGEST = 6000, 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int = ROWS, longest: int = LONGEST) -> pd.DataFrame:
    """text, label of at most `rows` labelled documents outside the held-out fold (crc32(doc_id) mod 5 = 0).

    The rows are those with the smallest hashes of doc_id, whatever their class. A document labelled both ways
    counts as 1; one that is null, or longer than `longest`, is left out of the fit.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where((fold("doc_id", 5) != 0) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= longest)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).toPandas()
    return found.sort_values(["doc_id"]).drop_duplicates("text").reset_index(drop=True)[["text", "label"]]
