"""Batches of preference pairs and rollouts as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.operators.packing import boundaries, flat_labels, position_ids, sequence_ids


def flatten_pairs(df: DataFrame, batch: str, order: str, sides: tuple[str, str] = ("chosen", "rejected")) -> DataFrame:
    """One padding-free row a batch: the ids of all chosen, then of all rejected, with labels, positions,
    sequence numbers (the rejected go on after the chosen) and cumulative lengths."""
    fields = [f"{s}_{c}" for s in sides for c in ("input_ids", "labels")]
    rows = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("r"))
    both = lambda c: F.concat(*[F.col(f"r.{s}_{c}") for s in sides])
    ids, labels = both("input_ids"), both("labels")
    lengths = F.transform(ids, lambda a: F.size(a))
    return rows.select(
        batch, F.flatten(ids).alias("input_ids"), flat_labels(labels).alias("labels"), position_ids(lengths).alias("position_ids"),
        sequence_ids(lengths).alias("seq_idx"), boundaries(lengths).alias("cu_seq_lens"), F.size("r").alias("pairs"),
    )


def unpack(values: Column, cu_seq_lens: Column) -> Column:
    """The parts of a packed list, by its cumulative lengths."""
    ends = F.slice(cu_seq_lens, F.lit(2), F.greatest(F.lit(0), F.size(cu_seq_lens) - 1))
    return F.transform(ends, lambda e, i: F.slice(values, (F.element_at(cu_seq_lens, i + 1) + 1).cast("int"), (e - F.element_at(cu_seq_lens, i + 1)).cast("int")))


def sequence_counts(cu_seq_lens: Column, ids: Column, pad: int) -> Column:
    """{tokens, pads, sequences} of a packed row."""
    pads = F.size(F.filter(ids, lambda x: x == pad))
    return F.struct((F.size(ids) - pads).alias("tokens"), pads.alias("pads"), (F.size(cu_seq_lens) - 1).alias("sequences"))


def repeat_prompts(df: DataFrame, n: int, name: str = "sample_no") -> DataFrame:
    """Every prompt's fields once for each of its n samples."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def by_index(results: DataFrame, rows: DataFrame, index: str) -> DataFrame:
    """Results with the dataset's row of their index."""
    return results.join(rows, index)


def length_batches(df: DataFrame, length: str, order: str, size: int, by: str) -> DataFrame:
    """Rows numbered by length within each part, with their batch; ``order`` restores the given order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last(length), order)) - 1
    return df.withColumn("place", rank).withColumn("batch", F.floor(rank / size))


def missing_reference(cache: DataFrame, rows: DataFrame, index: str) -> DataFrame:
    """Indices of the dataset that a cache of reference log-probabilities lacks; none if it is complete."""
    return rows.select(index).join(cache.select(index), index, "left_anti")
