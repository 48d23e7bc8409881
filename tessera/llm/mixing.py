"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times all words;
a target stops at ``most`` times its source's words and the excess is dealt out again by weight until none is
above.  Schedule: slot t of the mix has the golden-ratio point frac(t * phi); the cumulative weights map it to
a source, and its rank among that source's slots is the number of the source's block it takes.  Blocks: each
source's documents in a hashed order, end to end and round again, cut into blocks of ``block_words`` words.
The last slot a source needs is cut to the words that are still due, so each source gives its target to the
word, and no word is taken more than ``most`` times.

The order within a source is cut into buckets of the hash, so no task sorts a whole source, and the ranks of
slots come from counts of chunks of the schedule, so no task ranks a whole source's slots.  What is collected
to the driver is one number at a time; the sources themselves stay in a DataFrame.

Null text: size 0.  Null source: a source of its own, last.  Repeated rows count as documents of their own.
Empty table: empty result.  A source without words has target 0.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._store import quoted, written

WEIGHTS = (5, 2, 1)
#: The golden ratio's fraction as a multiple of 2**-31 (odd): frac(t * phi) is then exact in integers.
PHI = 1327217885
POINTS = 1 << 31
#: Documents of a bucket of the hashed order, at most about; there are 1024 buckets at least.
BUCKET_ROWS = 1 << 14
CHUNK = 1 << 16
#: Up to so many sources (rows of a few numbers) are sent to every task.
FEW = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than space and 0x09 to 0x0D."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "a")
    return F.length(F.translate(squeezed, " \t\n\u000b\f\r", "")).cast("long")


def source_targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, size): water-filling by weight under the caps."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((place - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight), "sources")  # one row a source
    due = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * F.lit(most)
    capped = F.lit(False)
    level = 0.0
    while True:  # as many rounds as there are turns of the filling: each caps at least one more source
        row = sources.agg(F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, cap))).first()
        free, full = row[0] or 0.0, row[1] or 0.0
        if not free:
            break
        level, before = (due - full) / free, level
        if level <= before:
            break
        capped = cap <= F.col("weight") * F.lit(level)
    return sources.select("source", "source_size", "weight", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(source, slot, block, words): the slots of the mix, each with the block it takes and how many words of it."""
    spark = targets.sparkSession
    whole = targets.select("source", F.floor(F.col("target") + F.lit(0.5)).cast("long").alias("due")).where("due > 0")
    total, count = whole.agg(F.sum("due"), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "source string, slot long, block long, words long")
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    upper = F.sum("due").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edges = whole.select(
        "source",
        "due",
        F.floor((upper - F.col("due")) / F.lit(total) * F.lit(POINTS)).cast("long").alias("low"),
        F.floor(upper / F.lit(total) * F.lit(POINTS)).cast("long").alias("high"),
        F.ceil(F.col("due") / F.lit(block_words)).cast("long").alias("need"),
    )
    # Points of t < n in an interval of length x are n x up to O(log n): a few more slots than needed give nearly
    # every source its last; what is then still due comes at the end.
    slots = math.ceil(total / block_words) + count
    slots = math.ceil(slots * 1.01) + 8 * slots.bit_length()
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * F.lit(PHI), F.lit(POINTS)).alias("point"))
    # The interval of a point: both are cut at multiples of a cell, so the search is an equality join on the cell.
    cells = 4096
    width = POINTS // cells
    cut = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.greatest(F.col("low"), F.col("high") - 1) / width))))
    hit = points.withColumn("cell", F.floor(F.col("point") / F.lit(width)))
    hit = hit.join(F.broadcast(cut) if count <= FEW else cut, "cell").where("point >= low and point < high").select("source", "slot", "due", "need")
    hit = hit.withColumn("chunk", F.floor(F.col("slot") / F.lit(CHUNK)))
    counts = hit.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("within", rank).alias("h").join(before.alias("b"), F.col("h.source").eqNullSafe(F.col("b.source")) & (F.col("h.chunk") == F.col("b.chunk")))
    ranked = ranked.select("h.source", "slot", "due", "need", (F.col("within") + F.col("before")).alias("block")).where("block < need")
    have = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("have"))
    short = edges.alias("e").join(have.alias("h"), F.col("e.source").eqNullSafe(F.col("h.source")), "left").select("e.source", "due", "need", F.coalesce("have", F.lit(0)).alias("have")).where("have < need")
    late = short.select("source", F.lit(slots).cast("long").alias("slot"), "due", "need", F.explode(F.sequence("have", F.col("need") - 1)).alias("block"))
    ranked = ranked.unionByName(late)
    words = F.least(F.lit(block_words), F.col("due") - F.col("block") * F.lit(block_words))
    return ranked.select("source", "slot", "block", words.cast("long").alias("words"))


def placed(sizes: DataFrame) -> DataFrame:
    """(row, source, size, begin): documents with their place in their source's hashed order."""
    # By what a row says, not by where it stands, so reruns agree; equal rows may change places.
    bits = max(10, (sizes.count() // BUCKET_ROWS).bit_length())
    keyed = sizes.where("size > 0").withColumn("h", F.xxhash64("doc_id", "size")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = totals.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row")) - F.col("size")
    both = keyed.withColumn("inner", inner).alias("k").join(before.alias("b"), F.col("k.source").eqNullSafe(F.col("b.source")) & (F.col("k.bucket") == F.col("b.bucket")))
    return both.select("row", "k.source", "size", (F.col("inner") + F.col("before")).alias("begin"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, block_words: int = 128) -> DataFrame:
    """(doc_id, size, source_size, target, taken): what the mix takes of each document."""
    sizes = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            quoted(docs, id_col).cast("long").alias("doc_id"),
            quoted(docs, source_col).cast("string").alias("source"),
            word_count(quoted(docs, text_col).cast("string")).alias("size"),
        ),
        "sizes",
    )
    targets = written(source_targets(sizes, share, most), "targets")
    slots = schedule(targets, block_words)
    at = placed(sizes).alias("p").join(F.broadcast(targets).alias("t") if _few(targets) else targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    at = at.select("row", "p.source", "size", "begin", "source_size")
    # Lap 0, 1, ...: the source's words come round again, as often as a target can ask for.
    laps = math.ceil(most) + 1
    lapped = at.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(laps - 1)))).withColumn("begin", F.col("begin") + F.col("lap") * F.col("source_size"))
    lapped = lapped.withColumn("end", F.col("begin") + F.col("size"))
    pieces = lapped.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))))
    taken = pieces.alias("p").join(slots.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block")))
    low, high = F.greatest(F.col("begin"), F.col("p.block") * block_words), F.least(F.col("end"), F.col("p.block") * block_words + F.col("words"))
    taken = taken.select("row", F.greatest(F.lit(0).cast("long"), high - low).alias("words")).groupBy("row").agg(F.sum("words").alias("taken"))
    result = sizes.alias("d").join(F.broadcast(targets).alias("t") if _few(targets) else targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("row", "doc_id", "size", "source_size", "target")
    return result.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _few(targets: DataFrame) -> bool:
    """Whether the sources can be sent to every task; otherwise Spark joins them by shuffle."""
    return targets.count() <= FEW


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
