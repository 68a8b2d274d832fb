"""Approximate nearest neighbours by a forest of hash prefixes (op 9)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import table
from storyloom.tables import lookup, written

TREES = 20
BITS = 64
TOP = 20
EVERY = 20
# Planes and their offsets are fitted to at most so many vectors; all are indexed.
SAMPLE_ROWS = 4_096
# A query climbs until its trees offer so many candidates, repeats counted.
LEAST_CANDIDATES = 20_000
SHARE = 1.0
# Vectors, and queries, that one task multiplies at a time.
POINTS = 4_096
QUERIES = 2_048
SEED = 11


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null or zero, has finite components only, and the usual length."""
    v = F.col(vector).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = rows.select(F.mode(F.size(vector), deterministic=True)).first()[0]
    # 0.0 turns -0.0 into 0.0: equal vectors get equal bytes.
    plain = F.transform(v, lambda x: x + F.lit(0.0)).alias("vector")
    return rows.filter(F.size(vector) == (size or 0)).select(F.col("vec_id"), plain)


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """One row per different vector: class_id (its smallest id), vector, its ``keep`` smallest ids."""
    first = Window.partitionBy("hash", "vector").orderBy("vec_id")
    few = rows.withColumn("hash", F.xxhash64("vector")).withColumn("place", F.row_number().over(first))
    few = few.filter(F.col("place") <= keep)
    found = few.groupBy("hash", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    return found.select("hash", F.col("members")[0].alias("class_id"), "vector", "members")


class Forest:
    """Random hyperplanes; a vector gets one long hash string per tree.

    Inner products become angles by one more component, which brings every
    stored vector to the length of the longest; for a query it is zero.
    """

    def __init__(self, sample: np.ndarray, longest: float, trees: int, bits: int = BITS):
        draw = np.random.default_rng(SEED)
        self.trees, self.bits, self.longest = trees, bits, longest
        self.planes = draw.normal(size=(sample.shape[1] + 1, trees * bits))
        self.offsets = np.median(self.lift(sample, True) @ self.planes, axis=0)

    def lift(self, vectors: np.ndarray, stored: bool) -> np.ndarray:
        lengths = np.sqrt((vectors**2).sum(axis=1))
        if stored:
            extra = np.sqrt(np.maximum(self.longest**2 - lengths**2, 0.0))
            return np.column_stack([vectors, extra])
        return np.column_stack([vectors * (self.longest / lengths)[:, None], np.zeros(len(vectors))])

    def hashes(self, vectors: np.ndarray, stored: bool) -> np.ndarray:
        """One unsigned number per vector and tree; its highest bit comes first."""
        above = self.lift(vectors, stored) @ self.planes > self.offsets
        packed = np.packbits(above.reshape(len(vectors), self.trees, self.bits), axis=2)
        return packed.view(">u8")[:, :, 0].astype(np.uint64)


def _matrix(lists: pa.Array) -> np.ndarray:
    if not len(lists):
        return np.zeros((0, 1))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def hashed(forest: Forest, stored: bool):
    """Column function: the hash strings of a vector, signed."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def hash_strings(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int64()))
        flat = forest.hashes(_matrix(vectors), stored).view(np.int64)
        ends = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(flat).ravel()))

    return hash_strings


def with_prefix(rows: DataFrame) -> DataFrame:
    """Add the first ``depth`` bits of ``string``; at depth 0 nothing is left."""
    kept = F.expr(f"shiftrightunsigned(string, {BITS} - depth)")
    return rows.withColumn("prefix", F.when(F.col("depth") == 0, F.lit(0)).otherwise(kept))


def best_of(top: int):
    """Scores the queries of a node against its points; the best ``top`` of each."""

    def score(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "class_id": [], "score": []})
        if points.empty or queries.empty:
            return empty
        p, q = np.stack(points["vector"]), np.stack(queries["vector"])
        ids = points["class_id"].to_numpy()
        rough = q @ p.T
        count = min(top, len(ids))
        # A few more than wanted: exact sums may order near-equal ones differently.
        few = min(count + 4, len(ids))
        near = np.argpartition(-rough, few - 1, axis=1)[:, :few]
        found = [(p[n] * v).sum(axis=1) for n, v in zip(near, q)]
        return pd.DataFrame(
            {
                "query": np.repeat(queries["class_id"].to_numpy(), few),
                "class_id": ids[near].ravel(),
                "score": np.concatenate(found),
            }
        )

    return score


def nearest(
    rows: DataFrame,
    is_query,
    top: int = TOP,
    vector: str = "embedding",
    trees: int = TREES,
    least_candidates: int = LEAST_CANDIDATES,
    share: float = SHARE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` largest inner products found for each query.

    Equal vectors form one class with its smallest ids, so a vector that is
    everywhere is searched and scored once.  Each tree sorts the classes by a
    long hash string; the runs that share a prefix are its nodes.  A query
    descends to its longest prefixes and ascends in all trees at once, a bit at a
    time, until the nodes it is in hold ``least_candidates`` classes and
    ``share`` times their number, repeats counted.  All points of those nodes are
    scored; large nodes are cut into blocks of points and of queries.

    Vectors without any structure need ``share`` near 1 for a recall over 0.9; a
    smaller one is enough where neighbours are closer than chance.
    """
    valid = written(usable(rows, vector), "ann-vectors")
    classes = written(classes_of(valid, top + 1), "ann-classes")
    total, longest = classes.agg(
        F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    ).first()
    sample = classes.orderBy("hash", "class_id").limit(SAMPLE_ROWS).select("vector").collect()
    vectors = np.array([r.vector for r in sample]) if sample else np.ones((1, 1))
    forest = Forest(vectors, longest or 1.0, trees)

    asking = valid.filter(is_query).withColumn("hash", F.xxhash64("vector"))
    asking = asking.join(classes.select("hash", "vector", "class_id"), ["hash", "vector"])
    asking = written(asking.select(F.col("vec_id").alias("query_id"), "class_id"), "ann-queries")
    queries = lookup(classes, asking.select("class_id").distinct(), "class_id").select("class_id", "vector")

    depths = max(1, math.ceil(math.log2(max(total, 2) / 64)))
    wanted = max(least_candidates, math.ceil(share * total))
    strings = {}
    for name, source, stored in (("points", classes, True), ("queries", queries, False)):
        made = source.select("class_id", hashed(forest, stored)("vector").alias("strings"))
        strings[name] = written(made.select("class_id", F.posexplode("strings").alias("tree", "string")), f"ann-{name}")
    depth = F.explode(F.sequence(F.lit(0), F.lit(min(depths, BITS - 1)))).alias("depth")
    node = ["tree", "depth", "prefix"]

    runs = with_prefix(strings["points"].select("tree", "string", depth)).groupBy(*node)
    runs = written(runs.agg(F.count("*").alias("points")), "ann-runs")
    paths = with_prefix(strings["queries"].select("class_id", "tree", "string", depth))
    paths = written(paths.drop("string"), "ann-paths")
    offered = lookup(paths, runs, node, "inner").groupBy("class_id", "depth").agg(F.sum("points").alias("offered"))
    enough = F.when((F.col("offered") >= wanted) | (F.col("depth") == 0), F.col("depth"))
    stop = offered.groupBy("class_id").agg(F.max(enough).alias("depth"))
    visits = written(paths.join(stop, ["class_id", "depth"]), "ann-visits")

    # Nodes that are visited, with the number of blocks each side is cut into.
    used = visits.groupBy(*node).agg(F.count("*").alias("asked"))
    used = used.join(runs, node).select(
        *node,
        F.ceil(F.col("points") / POINTS).cast("int").alias("point_blocks"),
        F.ceil(F.col("asked") / QUERIES).cast("int").alias("query_blocks"),
    )
    used = written(used, "ann-nodes")
    levels = [r.depth for r in used.select("depth").distinct().collect()]
    level = F.explode(F.array(*(F.lit(d) for d in sorted(levels)) or [F.lit(0)])).alias("depth")
    block = [*node, "point_block", "query_block"]

    def cut(side: str, other: str) -> tuple:
        own = F.pmod(F.xxhash64("class_id"), F.col(f"{side}_blocks")).cast("int").alias(f"{side}_block")
        rest = F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)
        return own, F.explode(rest).alias(f"{other}_block")

    at = with_prefix(strings["points"].select("class_id", "tree", "string", level)).drop("string")
    points = lookup(at, used, node, "inner").select("class_id", *node, *cut("point", "query"))
    points = points.join(classes.select("class_id", "vector"), "class_id")
    asks = lookup(visits, used, node, "inner").select("class_id", *node, *cut("query", "point"))
    asks = written(asks.join(classes.select("class_id", "vector"), "class_id"), "ann-asks")
    kind = valid.schema["vec_id"].dataType.simpleString()
    found = points.groupBy(*block).cogroup(asks.groupBy(*block)).applyInPandas(
        best_of(top + 1), f"query {kind}, class_id {kind}, score double"
    )

    # Trees may offer a class more than once.
    found = found.groupBy("query", "class_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top + 1)
    members = found.join(classes.select("class_id", "members"), "class_id")
    members = members.select("query", "score", F.explode("members").alias("vec_id"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= top + 1)
    listed = members.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    answers = lookup(asking, listed.withColumnRenamed("query", "class_id"), "class_id", "inner")
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, top)
    each = answers.select("query_id", F.posexplode(others).alias("rank", "one"))
    return each.select("query_id", (F.col("rank") + 1).alias("rank"), "one.vec_id", "one.score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every query of ``embeddings``."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % EVERY == 0)
