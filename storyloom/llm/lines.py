"""Line dedup within one edit by a deletion-neighbourhood join (op 2).

Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import table
from storyloom.tables import lookup, written

# Shorter lines are compared for equality only: one edit would be much of them.
NEAR_CHARS = 20
# Deletion variants are emitted for windows up to this length.
WINDOW = 48
# Below this size the near lines are sent to every executor rather than all lines shuffled.
SMALL_ROWS = 100_000

LINE = ["hash", "check"]


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: doc_id, text_hash, place, line (trimmed) and its two hashes."""
    split = F.posexplode(F.split("text", "\n", -1)).alias("place", "raw")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), split)
    rows = rows.select("doc_id", "text_hash", "place", F.trim("raw").alias("line")).filter("line != ''")
    return rows.withColumns({"hash": F.xxhash64("line"), "check": F.crc32("line")})


def halves(window: Column, context: Column) -> Column:
    """Structs (context, window): what is left of a window once one of its halves is agreed on.

    Of two strings one edit apart, the shorter of length m, the first m / 2
    characters agree or the last do.  A window may be the shorter or the longer,
    so it looks for partners under its own length and the one below.
    """
    size = F.length(window)
    found = []
    for shorter in (size, size - 1):
        half = F.floor(shorter / 2).cast("int")
        left, right = F.substring(window, F.lit(1), half), F.substring(window, size - half + 1, half)
        for side, agreed, rest in (
            (0, left, F.substring(window, half + 1, size)),
            (1, right, F.substring(window, F.lit(1), size - half)),
        ):
            key = F.xxhash64(context, shorter, F.lit(side), agreed)
            found.append(F.struct(key.alias("context"), rest.alias("window")))
    return F.array(*found)


def shared(states: DataFrame) -> DataFrame:
    """States whose context another line has as well."""
    states = written(states.distinct(), "line-states")
    contexts = states.groupBy("context").count().filter("count > 1").select("context")
    return lookup(states, contexts, "context")


def variants(states: DataFrame) -> DataFrame:
    """Hashed keys of all windows ``n`` within one deletion; neither line nor window goes along.

    ``key`` with ``role``: two windows with the same place deleted to the same
    rest are one substitution apart (role 0); a window (role 1) that another
    becomes by one deletion (role 2) is one insertion apart.
    """
    size = F.length("window")

    def without(i: Column) -> Column:
        return F.concat(F.substring("window", F.lit(1), i - 1), F.substring("window", i + 1, size))

    def keys(i: Column) -> Column:
        rest = without(i)
        return F.array(
            F.struct(F.xxhash64("context", F.lit("same"), size, i, rest).alias("key"), F.lit(0).alias("role")),
            F.struct(F.xxhash64("context", F.lit("less"), rest).alias("key"), F.lit(2).alias("role")),
        )

    whole = F.struct(F.xxhash64("context", F.lit("less"), "window").alias("key"), F.lit(1).alias("role"))
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    each = F.explode(F.concat(F.array(whole), F.flatten(F.transform(places, keys)))).alias("variant")
    return states.select("n", each).select("n", "variant.*")


def near_lines(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """Lines, out of ``distinct``, that have an earlier line within one edit: hash, check.

    A line first looks for others that share one of its halves, which few do;
    those repeat this on the half that differs, until a short window is left.
    Its deletion variants are joined as hashed keys.  Per key only the earliest
    line of each role counts, so no pairs are formed, and each line is verified
    against that earliest one by edit distance.
    """
    twice = written(distinct.select("context").groupBy("context").count().filter("count > 1"), "line-halves")
    some = lookup(distinct, twice.select("context"), "context").select(*LINE, "first").distinct()
    some = written(some, "line-candidates")
    where = some.select(*LINE, "first", "first.doc_id", "first.text_hash", "first.place")
    if where.count() <= SMALL_ROWS:
        where = F.broadcast(where)
    # The place is part of the key, so a line that is everywhere meets its first copy only.
    text = lines_of(docs).alias("l").join(
        where.alias("w"),
        (F.col("l.hash") == F.col("w.hash"))
        & (F.col("l.check") == F.col("w.check"))
        & F.col("l.doc_id").eqNullSafe(F.col("w.doc_id"))
        & (F.col("l.text_hash") == F.col("w.text_hash"))
        & (F.col("l.place") == F.col("w.place")),
    )
    text = text.select("l.hash", "l.check", "w.first", "l.line").distinct()
    halved = F.explode(halves(F.col("line"), F.lit(0).cast("bigint"))).alias("state")
    states = written(shared(text.select(*LINE, "first", halved).select(*LINE, "first", "state.*")), "line-windows")
    short = []
    while True:
        # One character more belongs to both: its partner may be short or long.
        short.append(states.filter(F.length("window") <= WINDOW + 1))
        long = states.filter(F.length("window") > WINDOW)
        if long.isEmpty():
            break
        halved = F.explode(halves(F.col("window"), F.col("context"))).alias("state")
        states = written(shared(long.select(*LINE, "first", halved).select(*LINE, "first", "state.*")), "line-windows")
    windows = short[0]
    for more in short[1:]:
        windows = windows.unionByName(more)
    # Numbers rise with the first place of the line, so the least number is the earliest line.
    ordered = windows.repartitionByRange("first").sortWithinPartitions("first")
    windows = written(ordered.withColumn("n", F.monotonically_increasing_id()), "line-numbered")
    rows = written(variants(windows), "line-variants")
    least = [F.min(F.when(F.col("role") == r, F.col("n"))).alias(f"least{r}") for r in (0, 1, 2)]
    alike = F.count_if(F.col("role") == 0).alias("alike")
    # Most keys belong to one window; only the others are looked up.
    earliest = rows.groupBy("key").agg(*least, alike).filter("alike > 1 or (least1 is not null and least2 is not null)")
    met = lookup(rows, earliest.drop("alike"), "key", "inner")
    other = F.when(F.col("role") == 0, F.col("least0")).when(F.col("role") == 1, F.col("least2"))
    met = met.select("n", other.otherwise(F.col("least1")).alias("other")).filter("other < n").distinct()
    mine = windows.select("n", *LINE, "first", "window")
    theirs = windows.select(F.col("n").alias("other"), F.col("first").alias("other_first"), F.col("window").alias("other_window"))
    found = written(met, "line-met").join(mine, "n").join(theirs, "other")
    near = F.levenshtein(F.col("window"), F.col("other_window"), 1) >= 0
    return found.filter((F.col("other_first") < F.col("first")) & near).select(*LINE).distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, dropped: places of the lines of a text that have an earlier match.

    A line is dropped if an equal line comes earlier, by (doc_id, hash of the
    text, place), or if it has ``NEAR_CHARS`` characters or more and such a line
    within one edit comes earlier.  White space around lines does not count, and
    blank lines stay.  Rows equal in id and text are one document; null ids come
    first.
    """
    lines = lines_of(docs)
    near = F.when(F.length("line") >= NEAR_CHARS, F.transform(halves(F.col("line"), F.lit(0).cast("bigint")), lambda s: s["context"]))
    own = F.struct("doc_id", "text_hash", "place")
    keyed = lines.select(*LINE, own.alias("own"), near.alias("contexts"))
    distinct = keyed.groupBy(*LINE).agg(
        F.min("own").alias("first"), F.count("*").alias("copies"), F.any_value("contexts").alias("contexts")
    )
    distinct = written(distinct, "lines-distinct")
    halved = distinct.select(*LINE, "first", F.explode(F.array_distinct("contexts")).alias("context"))
    close = near_lines(halved, docs).withColumn("near", F.lit(True))
    marks = distinct.select(*LINE, "first", "copies").join(written(close, "lines-near"), LINE, "left")
    marks = marks.filter((F.col("copies") > 1) | F.col("near")).select(*LINE, "first", "near")
    found = lookup(lines.select(*LINE, own.alias("own")), marks, LINE, "inner")
    gone = found.filter(F.col("near") | (F.col("own") != F.col("first")))
    return gone.groupBy("own.doc_id", "own.text_hash").agg(F.collect_set("own.place").alias("dropped"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """row, text, n_lines, n_dropped of every row of ``docs``.

    ``row`` holds the columns of ``docs``; ``text`` lacks the dropped lines and
    is unchanged where none is, null included.
    """
    found = written(dropped_lines(docs.select("doc_id", "text")), "lines-dropped")
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_hash"))
    joined = rows.join(found, same, "left").withColumn("lines", F.split("row.text", "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(places, lambda i: F.col("lines")[i]), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(kept)
    return joined.select(
        "row",
        text.alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole text that repeat, or nearly repeat, an earlier one; see the operator above."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    found = line_dedup(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("text_sha256"))
    return found


ORACLE = """
WITH split AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM documents
), lines AS (SELECT *, trim(raw, ' ') AS line FROM split),
firsts AS (
    SELECT line, min((doc_id, place)) AS first, length(line) AS size FROM lines WHERE line <> '' GROUP BY line
), near AS (
    SELECT DISTINCT a.line FROM firsts a JOIN firsts b ON b.size BETWEEN a.size - 1 AND a.size + 1
    WHERE a.size >= 20 AND b.size >= 20 AND b.first < a.first
      AND (a.line[1:least(a.size, b.size) // 2] = b.line[1:least(a.size, b.size) // 2]
           OR a.line[-(least(a.size, b.size) // 2):] = b.line[-(least(a.size, b.size) // 2):])
      AND levenshtein(a.line, b.line) <= 1
), marked AS (
    SELECT l.*, line <> '' AND ((doc_id, place) <> first OR line IN (SELECT line FROM near)) AS dropped
    FROM lines l LEFT JOIN firsts USING (line)
), cleaned AS (
    SELECT doc_id, count(*) AS n_lines, count_if(dropped) AS n_dropped,
           coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT coalesce(dropped, false)), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       sha256(coalesce(c.text, '')) AS text_sha256
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""
