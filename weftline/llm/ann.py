"""Approximate nearest neighbours by learned partitions.

A bounded sample gets its exact neighbour graph, which is cut into balanced parts: recursive halving along
principal directions, then moves of vertices to the part most of their neighbours are in while sizes stay within
a few per cent. A softmax classifier learns the parts of a vector's neighbours. Every row is indexed in its most
probable part; a query is routed to as many of its most probable parts as reach the target recall on sample
queries, and all rows there are reranked exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from weftline.llm.common import Scratch
from weftline.llm.vectors import matrix, usable

#: Vectors that the graph and the classifier are fitted on; with many parts, 32 a part.
SAMPLE = 6000
#: Vector sizes that have an index; parts of size d are numbered from d * STEP on.
ROUTED, STEP = 4, 1 << 20
NEIGHBOURS = 12
#: Candidates and queries that meet in one task at a time.
BLOCK, QUERY_BLOCK = 8192, 2048


@dataclass
class Router:
    weights: np.ndarray  # size x parts
    bias: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.bias)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """The parts of each vector, most probable first."""
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 15, slack: float = 1.05) -> np.ndarray:
    """A part for each vertex, none with more than slack times its share."""
    part = np.zeros(len(x), np.int64)
    queue = [(np.arange(len(x)), 0, parts)]
    while queue:
        own, first, n = queue.pop()
        if n == 1:
            part[own] = first
            continue
        centred = x[own] - x[own].mean(axis=0)
        direction = np.linalg.svd(centred, full_matrices=False)[2][0] if len(own) > 1 else np.ones(x.shape[1])
        order = own[np.argsort(centred @ direction, kind="stable")]
        cut = len(own) * (n // 2) // n
        queue += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        for k in range(graph.shape[1]):
            votes[np.arange(len(x)), part[graph[:, k]]] += 1
            np.add.at(votes, (graph[:, k], part), 1)
        target = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), target] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[target[v]] < room:
                size[part[v]] -= 1
                size[target[v]] += 1
                part[v] = target[v]
                moved += 1
        if not moved:
            break
    return part


def fit(x: np.ndarray, parts: int, recall: float = 0.97, depth: int = 20, steps: int = 300) -> Router:
    x = np.unique(x, axis=0)
    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 2.0)
    for k in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(x)), part[graph[:, k]]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    scale = float(np.sqrt((x**2).mean())) or 1.0
    z = x / scale
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        logit = z @ w + b
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target) / len(x)
        for v, g, i in ((w, z.T @ d + 1e-5 * w, 0), (b, d.sum(axis=0), 2)):
            m[i] = 0.9 * m[i] + 0.1 * g
            m[i + 1] = 0.99 * m[i + 1] + 0.01 * g * g
            v -= 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(m[i + 1] / (1 - 0.99**t)) + 1e-9)
    router = Router(w / scale, b, parts)
    ranked = router.ranked(x)
    home = ranked[:, 0]
    test = np.arange(0, len(x), max(1, len(x) // 500))
    s = x[test] @ x.T
    s[np.arange(len(test)), test] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(depth, len(x) - 1)]
    place = np.argsort(ranked[test], axis=1)  # the rank of each part for each query
    rank = np.take_along_axis(place, home[near], axis=1)
    found = np.array([(rank < n).mean() for n in range(1, parts + 1)])
    router.probes = int(np.argmax(found >= recall)) + 1
    return router


def best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of `rows` for each of `queries`, by inner product, ties to the smaller id."""
    rows = rows.sort_values("vec_id", kind="stable").drop_duplicates("vec_id")
    queries = queries.drop_duplicates("vec_id")
    ids, q_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    c, q = matrix(rows["embedding"]), matrix(queries["embedding"])
    out = []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ c.T
        s[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        n = min(k, len(ids))
        least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        for r in range(len(s)):
            near = np.flatnonzero((s[r] >= least[r]) & (s[r] > -np.inf))
            near = near[np.argsort(-s[r][near], kind="stable")[:n]]
            out.append((np.full(len(near), q_ids[at + r]), ids[near], s[r][near]))
    a, b, v = (np.concatenate([o[j] for o in out]) if out else np.empty(0) for j in range(3))
    return pd.DataFrame({"query_id": a.astype(np.int64), "vec_id": b.astype(np.int64), "score": v})


def routers(rows: DataFrame, sizes: dict[int, int], parts: int | None, recall: float) -> dict[int, Router]:
    """A router for each of the ROUTED most common vector sizes, fitted on a sample of its rows with the smallest hash of vec_id."""
    out = {}
    for size in sorted(sizes, key=lambda d: (-sizes[d], d))[:ROUTED]:
        wanted = parts or int(np.clip(np.sqrt(sizes[size]) / 8, 4, 1024))
        sample = rows.where(F.size("embedding") == size).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, 32 * wanted))
        out[size] = fit(matrix(sample.select("embedding").toPandas()["embedding"]), wanted, recall)
    return out


def search(vectors: DataFrame, modulus: int = 20, k: int = 20, parts: int | None = None, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every usable row whose vec_id is divisible by `modulus`.

    Every usable row is indexed, and only vectors of one size are compared. Parts grow with the square root of the rows, and
    with them the sample that they are fitted on: max(SAMPLE, 32 a part) rows, 32,768 at most; `recall` is reached on it.
    Sizes beyond the ROUTED most common have one part each, which is searched whole. A query goes on to further parts until
    those it was routed to hold k candidates. Vectors that are null, zero or not finite take no part, nor do rows without an
    id. Repeated rows of one id count once, with the best score. A part that many rows fall into is dealt out in blocks.
    Other columns are ignored, whatever their names; an empty table has an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("embedding"))
    common = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(ROUTED).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    work = Scratch(spark, "ann")
    shipped = spark.sparkContext.broadcast(routers(rows, {r["d"]: r["n"] for r in common}, parts, recall))
    is_query = F.pmod("vec_id", F.lit(modulus)) == 0

    def by_size(x: pd.Series, of) -> pd.Series:
        """`of` (router, vectors) over each size among the vectors."""
        size, out = x.map(len).to_numpy(), pd.Series([None] * len(x), dtype=object)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            for i, v in zip(at, of(int(d), matrix(x.iloc[at])), strict=True):
                out[i] = v
        return out

    def home(x: pd.Series) -> pd.Series:
        own = shipped.value
        return by_size(x, lambda d, v: own[d].ranked(v)[:, 0] + d * STEP if d in own else np.full(len(v), d * STEP)).astype(np.int64)

    indexed = work.stored(rows.withColumn("part", F.pandas_udf(home, LongType())("embedding")), "indexed")
    held = indexed.groupBy("part").agg(F.countDistinct("vec_id").alias("n"))
    held = {r["part"]: r["n"] for r in held.where(F.col("part").isin([d["d"] * STEP + j for d in common for j in range(shipped.value[d["d"]].parts)])).collect()}  # at most ROUTED x 1,024 rows

    def probed(x: pd.Series) -> pd.Series:
        own = shipped.value

        def of(d, v):
            if d not in own:
                return [[d * STEP]] * len(v)
            ranked = own[d].ranked(v) + d * STEP
            enough = np.cumsum(np.vectorize(lambda p: held.get(p, 0))(ranked), axis=1) > k
            need = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, ranked.shape[1])
            return [r[: max(own[d].probes, n)].tolist() for r, n in zip(ranked, need, strict=True)]

        return by_size(x, of)

    asked = work.stored(indexed.where(is_query).withColumn("part", F.explode(F.pandas_udf(probed, ArrayType(LongType()))("embedding"))), "asked")
    blocks = held_blocks(indexed, BLOCK).join(held_blocks(asked, QUERY_BLOCK).withColumnRenamed("blocks", "query_blocks"), "part")

    def spread(df, own, other):
        """A row's own block by hash, once for each block of the other side."""
        df = df.join(blocks, "part").withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        return df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    c = spread(indexed, "blocks", "query_blocks").select("part", F.col("_own").alias("cb"), F.col("_other").alias("qb"), "vec_id", "embedding")
    q = spread(asked, "query_blocks", "blocks").select("part", F.col("_other").alias("cb"), F.col("_own").alias("qb"), "vec_id", "embedding")

    def rerank(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return best(queries, candidates, k)

    cell = ["part", "cb", "qb"]
    found = q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return work.keep(spark.sql(
        "select query_id, rank, vec_id, score from (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank "
        f"from {{found}}) where rank <= {int(k)}", found=found
    ))


def held_blocks(rows: DataFrame, most: int) -> DataFrame:
    """part, blocks: how many blocks of `most` rows the rows of a part make."""
    return rows.groupBy("part").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks"))
