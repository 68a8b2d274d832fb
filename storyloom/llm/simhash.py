"""SimHash near-duplicates by the generalised pigeonhole rule (op 10)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import table
from storyloom.llm.components import components
from storyloom.tables import lookup, written

BITS = 64
WORDS = 3
SEED = 42
DISTANCE = 2
# Fingerprints from which candidate counts are estimated.
PLAN_ROWS = 8_192
# A key under which more pairs than this would meet is refined.
PAIRS_PER_KEY = 4_096
# Hashes whose bits are counted together.
HASHES = 65_536


def fingerprint_of(words: list[bytes], size: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all shingles; no words give 0."""
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    ones, count, ends = np.zeros(BITS, np.int64), len(starts), ends[size - 1 :]
    for at in range(0, count, HASHES):
        spans = zip(starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist())
        hashes = np.array([digest(line[s:e], seed) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    value = np.packbits(2 * ones > count, bitorder="little").view(np.uint64)
    return int(value[0])


def fingerprint(text: Column, size: int = WORDS) -> Column:
    """Signed 64-bit fingerprint; bytes.lower and bytes.split know ASCII only, as the rule wants."""

    @F.arrow_udf(T.LongType())
    def made(texts: pa.Array) -> pa.Array:
        found = (fingerprint_of(t.encode().lower().split(), size) for t in texts.fill_null("").to_pylist())
        return pa.array(np.fromiter(found, np.uint64).view(np.int64))

    return made(text)


def groups_of_bits(values: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into equal parts, correlated bits together."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    spread = np.sqrt((bits**2).sum(axis=0))
    spread[spread == 0] = 1.0
    tie = np.abs(bits.T @ bits / np.outer(spread, spread))
    np.fill_diagonal(tie, 0.0)
    free, found = set(range(BITS)), []
    for part in range(parts):
        size = (BITS - sum(map(len, found))) // (parts - part)
        own = [max(sorted(free), key=lambda b: tie[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < size:
            own.append(max(sorted(free), key=lambda b: tie[b, own].sum()))
            free.discard(own[-1])
        found.append(own)
    return found


def flips(bits: list[int], radius: int) -> list[int]:
    """All patterns of at most ``radius`` set bits out of ``bits``."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]


def estimated_cost(values: np.ndarray, total: int, bits: list[int], radius: int) -> float:
    """Rows to probe with plus candidate pairs expected within ``radius`` on ``bits``.

    Pairs are counted in the sample and scaled up; a sample that shows none falls
    back on what independent bits would give.
    """
    if radius < 0:
        return 0.0
    mask = np.uint64(sum(1 << b for b in bits))
    own, counts = np.unique(values & mask, return_counts=True)
    pairs = 0
    for flip in flips(bits, radius):
        other = own ^ np.uint64(flip)
        place = np.minimum(np.searchsorted(own, other), len(own) - 1)
        pairs += int((counts * np.where(own[place] == other, counts[place], 0)).sum())
    pairs -= len(values)
    unpacked = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, bits]
    ones = unpacked.mean(axis=0)
    chance = float(np.prod(ones**2 + (1 - ones) ** 2)) * len(flips(bits, radius))
    scale = (total / max(len(values), 1)) ** 2
    return max(pairs * scale, chance * total * total) + total * len(flips(bits, radius))


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 of least total cost.

    If two values differ in more than t_i bits on every part, they differ in at
    least sum(t_i + 1) bits; so a pair within ``distance`` is found on some part.
    ``costs[i][t + 1]`` is the cost of threshold t on part i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (so_far, chosen) in best.items():
            for more in range(distance + 2 - spent):
                new = (so_far + cost[more], [*chosen, more - 1])
                if spent + more not in step or new[0] < step[spent + more][0]:
                    step[spent + more] = new
        best = step
    return best[distance + 1]


def plan(values: np.ndarray, total: int, distance: int) -> list[tuple[int, list[int]]]:
    """(mask, flips to probe with) of each part used, for the cheapest number of parts."""
    choices = []
    for parts in range(2, distance + 3):
        bits = groups_of_bits(values, parts)
        costs = [[estimated_cost(values, total, b, t) for t in range(-1, distance + 1)] for b in bits]
        cost, thresholds = allocate(costs, distance)
        choices.append((cost, parts, bits, thresholds))
    _, _, bits, thresholds = min(choices, key=lambda c: c[:2])
    return [(sum(1 << x for x in b), flips(b, t)) for b, t in zip(bits, thresholds) if t >= 0]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _and(column: Column, mask: int) -> Column:
    return column.bitwiseAND(F.lit(_signed(mask)))


def _parts_left(mask: int, distance: int) -> list[int]:
    """The bits outside ``mask`` in distance + 1 parts."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    parts = distance + 1
    return [m for m in (sum(1 << b for b in rest[i::parts]) for i in range(parts)) if m]


def near_links(distinct: DataFrame, distance: int = DISTANCE, pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """Pairs a < b of the distinct fingerprints ``value`` at most ``distance`` bits apart.

    Every value is indexed under its bits on each part and probes with all
    patterns within the part's threshold; candidates are verified where they
    meet.  A key under which many pairs would meet is refined: those values also
    have to agree on one of distance + 1 parts of the other bits, by the same
    rule.  That ends, at the latest, when all bits are used; no link is lost and
    no task pairs a large group.
    """
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("value"), "value").limit(PLAN_ROWS).collect()
    values = np.array([r.value for r in sample], np.int64).view(np.uint64)
    made = []
    for mask, patterns in plan(values, total, distance) if total else []:
        own = _and(F.col("value"), mask)
        flip = F.explode(F.array(*(F.lit(_signed(p)) for p in patterns)))
        index = distinct.select("value", own.alias("key"), F.lit(False).alias("probe"))
        probe = distinct.select("value", flip.alias("flip")).select(
            "value", own.bitwiseXOR(F.col("flip")).alias("key"), F.lit(True).alias("probe")
        )
        made += [rows.withColumn("mask", F.lit(_signed(mask))) for rows in (index, probe)]
    found = []
    while made:
        keyed = written(reduce(DataFrame.unionByName, made), "simhash-keys")
        counts = keyed.groupBy("mask", "key").agg(
            F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("indexed")
        )
        crowded = counts.filter((F.col("probes") * F.col("indexed") > pairs_per_key) & (F.col("mask") != -1))
        crowded = written(crowded.select("mask", "key"), "simhash-crowded")
        plain = keyed.join(crowded, ["mask", "key"], "left_anti")
        index = plain.filter(~F.col("probe")).select(
            F.col("mask").alias("index_mask"), F.col("key").alias("index_key"), F.col("value").alias("b")
        )
        probe = plain.filter("probe").select("mask", "key", F.col("value").alias("a"))
        same = (F.col("mask") == F.col("index_mask")) & (F.col("key") == F.col("index_key"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
        found.append(probe.join(index, same & (F.col("a") < F.col("b")) & near).select("a", "b"))
        made = []
        # One mask per choice of parts so far; a plan of one size refines them all.
        masks = [r.mask for r in crowded.select("mask").distinct().collect()]
        if masks:
            parts = [(m, _signed(p)) for m in masks for p in _parts_left(m % (1 << BITS), distance)]
            parts = F.broadcast(distinct.sparkSession.createDataFrame(parts, "mask long, part long"))
            again = lookup(keyed, crowded, ["mask", "key"]).join(parts, "mask")
            key = F.col("key").bitwiseOR(F.col("value").bitwiseAND(F.col("part")))
            mask = F.col("mask").bitwiseOR(F.col("part"))
            made = [again.select("value", key.alias("key"), "probe", mask.alias("mask"))]
    if not found:
        return distinct.select(F.col("value").alias("a"), F.col("value").alias("b")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def grouped(marked: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, value, component_id of every row of the written table ``marked`` (doc_id, value)."""
    distinct = written(marked.groupBy("value").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links_of(distinct.select("value")))
    members = distinct.join(written(roots, "simhash-roots"), F.col("value") == F.col("node"), "left")
    members = written(members.select("value", "least", F.coalesce("root", "value").alias("root")), "simhash-members")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_value = lookup(members.select("value", "root"), least, "root", "inner").select("value", "component_id")
    return lookup(marked, of_value, "value", "inner").select("doc_id", "value", "component_id")


def kept_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = written(kept.select("doc_id").distinct(), "simhash-kept")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def near_groups(
    docs: DataFrame, document_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, words: int = WORDS
) -> DataFrame:
    """doc_id, fingerprint (signed), component_id of every row.

    Null counts as empty, and texts without words have fingerprint 0, linked like
    any other.  ``component_id`` is the smallest id that links reach, null only
    if no row reached has an id.
    """
    marked = docs.select(F.col(document_id).alias("doc_id"), fingerprint(F.col(text), words).alias("value"))
    marked = written(marked, "simhash-marked")
    return grouped(marked, lambda values: near_links(values, distance)).withColumnRenamed("value", "fingerprint")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their group; of repeated rows all stay."""
    return kept_of_groups(docs, near_groups(docs, **options))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
