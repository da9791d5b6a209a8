"""Mixing sources to target weights by systematic sampling.

Targets: the sources, by code point with null last, weigh 1, 2, 3, 1, ... and
share ``total`` (all sizes unless given).  A target stops at ``most`` times
its source's size; what is cut off is shared again by weight until none is
above, which is the level L with target = min(most * size, L * weight).

Sampling: within a source every document is expected ``target / size`` times.
Documents are put in order of size, so that each stretch of the order carries
its share of words; the expected copies are prefix-summed along the order (the
rate times the place, so sums are exact), one offset per source is added, and
a document is emitted once for each integer boundary its interval crosses.
The offset is a hash of the seed and the source's name, so reruns agree.

Places in the order come from one range exchange over (source, size, key): a
hot source spans many partitions, whose counts are added up per source.  The
table that goes through the exchange is written to the checkpoint folder.

Defined cases: null text has size 0; a source without words has target 0, and
its documents are not taken; null is a source of its own; repeated rows are
separate documents; an empty table gives an empty result; columns pass through,
except that result columns replace those of their name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, let_go, partitions, word_count


@dataclass(frozen=True)
class Mix:
    weights: tuple = (1, 2, 3)
    most: int = 3
    total: float | None = None
    seed: int = 17


def _ranked(df: DataFrame, key: list[str], n: int, place: str) -> DataFrame:
    """df with columns place (from 0, within _src) and _total-free parts: one range exchange, no single task for all rows or for a source."""

    def local(batches):
        let_go()
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            src = b.column(b.schema.get_field_index("_src")).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(src[1:] != src[:-1]) + 1
            starts = np.concatenate([[0], change]).astype(int)
            at = np.arange(len(src)) - np.repeat(starts, np.diff(np.append(starts, len(src))))
            if src[0] == last:
                at[: change[0] if len(change) else len(src)] += seen
            last, seen = src[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "_at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _at long"
    dealt = df.repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(local, schema).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    counts = dealt.groupBy("_src", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return dealt.join(offsets, ["_src", "_part"]).withColumn(place, F.col("_at") + F.col("_before")).drop("_at", "_before", "_part")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """sizes(_src, source_size) with column target.  One row per source; ranks and levels are windows over sources, the only thing a single task sees."""
    order = Window.orderBy("_src")
    s = sizes.withColumn("_n", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("_n") % len(mix.weights) + 1).cast("int"))
    s = s.withColumn("_weight", weight).withColumn("_cap", (F.col("source_size") * mix.most).cast("double"))
    everything = Window.partitionBy()
    s = s.withColumn("_all", F.lit(float(mix.total)) if mix.total is not None else F.sum("source_size").over(everything).cast("double"))
    # In order of cap / weight, the first so many sources are full; the level is what is left over the weights that are left.
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), "_src")
    left = s.withColumn("_filled", F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_open", F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("_all") - F.coalesce(F.col("_filled"), F.lit(0.0))) / F.col("_open")
    left = left.withColumn("_level", F.when(level * F.col("_weight") <= F.col("_cap"), level))
    found = left.withColumn("_level", F.max("_level").over(everything))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_weight")))
    return found.withColumn("target", target).select("_src", "source_size", "target")


def mix_sources(docs: DataFrame, text: str | None = "text", source: str = "source", doc_id: str = "doc_id", mix: Mix = Mix()) -> DataFrame:
    """docs with size, source_size (long), target (double, its source's), copies (long) and taken = copies * size (long).

    text None: docs has a column size already.
    """
    made = ["source_size", "target", "copies", "taken"] + ([] if text is None else ["size"])
    df = docs.drop(*[c for c in docs.columns if c.lower() in made])
    if text is not None:
        df = df.withColumn("size", word_count(F.col(f"`{text}`")))
    df = df.withColumn("_src", F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))))
    df = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c in {doc_id, "size", "source", "lang"}]))
    ranked = _ranked(df, ["_src", "size", doc_id, "_tie"], partitions(docs.sparkSession), "_place").drop("_tie")
    sizes = targets(ranked.groupBy("_src").agg(F.sum("size").alias("source_size")), mix)
    out = ranked.join(sizes, "_src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(mix.seed), F.col("_src")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    out = out.withColumns({"_rate": rate, "_offset": offset})
    upto = lambda i: F.floor(F.col("_offset") + F.col("_rate") * i)
    out = out.withColumn("copies", (upto(F.col("_place") + 1) - upto(F.col("_place"))).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_src", "_place", "_rate", "_offset")


def emitted(mixed: DataFrame) -> DataFrame:
    """One row per copy."""
    return mixed.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy")
