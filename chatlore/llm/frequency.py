"""Frequency of every term or n-gram, by a distributed suffix array.

A record's suffixes (its tokens from each position on, cut to the longest n-gram asked for) are
sorted within the record. Neighbours that share n tokens are within-record duplicates of that
n-gram: what is left of its occurrences without them is the number of records. Equal suffixes are
merged before the shuffle, with their counts of duplicates at each depth. The distinct suffixes are
then range-partitioned and sorted, which is the suffix array, and one pass over each batch finds
the common-prefix intervals: the prefix shared with the suffix before ends all deeper intervals.
Only intervals at the ends of a batch are merged again. It is the same for every ``max_n``, single
words included; ``max_n`` says how long n-grams are wanted, no shorter one is left out.

Defined cases: null records, null or empty token lists and null tokens count nothing; a record
delivered several times counts once if the caller has reduced it to one row (``once`` does that
without moving the texts of other rows); an empty table has no terms; columns beyond the named ones
are ignored.

Scale: a hot term is one row of each map task's partial aggregate. The range partitioning is of
distinct suffixes, so no task holds the occurrences of a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlore.shared import cut

WORD_CHARS = r"0-9a-z\u0080-\x{10FFFF}"
WORD = rf"[{WORD_CHARS}]+(?:'+[{WORD_CHARS}]+)*"
RARE = 2
COMMON_SHARE = 20


def words(text: Column) -> Column:
    """Words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def record_suffixes(tokens: str, max_n: int) -> Column:
    """Array of (suffix, shared) in sorted order; ``shared``: tokens in common with the one before."""
    sfx = f"array_sort(transform(sequence(1, size({tokens})), i -> slice({tokens}, i, {max_n})))"
    shared = " + ".join(
        f"if(size(s) >= {n} and i > 0 and slice(s, 1, {n}) = slice(a[i - 1], 1, {n}), 1, 0)" for n in range(1, max_n + 1))
    # the sorted array is bound once, as the only element of another array
    return F.expr(
        f"flatten(transform(filter(array({sfx}), x -> size({tokens}) > 0), a -> transform(a, (s, i) -> "
        f"named_struct('suffix', s, 'shared', {shared}))))")


def suffix_array(records: DataFrame, field: str, tokens: str, max_n: int) -> DataFrame:
    """Distinct suffixes (``t1`` ... ``tN``) with their occurrences and duplicates at each depth, sorted in ranges."""
    clean = F.filter(F.col(tokens), lambda t: t.isNotNull())
    rows = records.select(F.col(field).alias("field"), clean.alias("tokens")).filter(F.size("tokens") > 0)
    rows = rows.select("field", F.explode(record_suffixes("tokens", max_n)).alias("s")).select("field", "s.*")
    keys = ["field", *[f"t{n}" for n in range(1, max_n + 1)]]
    at = [F.try_element_at("suffix", F.lit(n)).alias(f"t{n}") for n in range(1, max_n + 1)]
    dups = [F.sum((F.col("shared") >= n).cast("long")).alias(f"d{n}") for n in range(1, max_n + 1)]
    merged = rows.select("field", "shared", *at).groupBy(*keys).agg(F.count("*").alias("occ"), *dups)
    return merged.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before (null is a value of its own)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    return pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False) & ~pc.and_(
        pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)


def intervals(batch: pa.RecordBatch, max_n: int) -> Iterator[pa.RecordBatch]:
    """Common-prefix intervals of each depth in a sorted batch of suffixes."""
    new = np.ones(len(batch), bool)
    field, occ = batch.column("field"), batch.column("occ").to_numpy()
    changed = _changes(field)
    for n in range(1, max_n + 1):
        t = batch.column(f"t{n}")
        changed = changed | _changes(t)
        new[1:] = changed
        start = np.flatnonzero(new)
        keep = t.is_valid().to_numpy(zero_copy_only=False)[start]
        ends = np.zeros(len(start), bool)
        ends[0] = ends[-1] = True
        count = np.add.reduceat(occ, start)
        again = np.add.reduceat(batch.column(f"d{n}").to_numpy(), start)
        first = pa.array(start[keep])
        m = len(first)
        parts = np.empty((m, n), object)
        for k in range(1, n + 1):
            parts[:, k - 1] = batch.column(f"t{k}").take(first).to_numpy(zero_copy_only=False)
        gram = pa.ListArray.from_arrays(pa.array(np.arange(0, m * n + 1, n), pa.int32()), pa.array(parts.ravel(), pa.string()))
        yield pa.RecordBatch.from_arrays(
            [field.take(first), pa.array(np.full(m, n), pa.int32()), gram, pa.array(count[keep]), pa.array((count - again)[keep]), pa.array(ends[keep])],
            ["field", "n", "gram", "occurrences", "records", "at_end"])


def ngram_counts(records: DataFrame, field: str = "field", tokens: str = "tokens", max_n: int = 1) -> DataFrame:
    """(field, n, gram, occurrences, records) of all n-grams up to ``max_n`` tokens."""
    array = suffix_array(records, field, tokens, max_n)
    schema = "field string, n int, gram array<string>, occurrences long, records long, at_end boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield from intervals(b, max_n)

    parts = cut(array.mapInArrow(run, schema), "intervals")
    merged = parts.filter("at_end").groupBy("field", "n", "gram").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return parts.filter("not at_end").drop("at_end").unionByName(merged)


def mark(counts: DataFrame, total_records: int, rare: int = RARE, common_share: int = COMMON_SHARE) -> DataFrame:
    """Add ``mark``: ``rare`` (at most ``rare`` records), ``common`` (more than 1/``common_share`` of all) or null."""
    r = F.col("records")
    # where all records are few, common wins over rare only if the term isn't rare
    return counts.withColumn("mark", F.when(r <= rare, "rare").when(r * common_share > total_records, "common"))


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key (null keys left out). Only rows whose key comes again are moved with their texts."""
    rows = rows.filter(F.col(key).isNotNull())
    again = cut(rows.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_again"), "again")
    on = rows[key] == again["_again"]
    return rows.join(again, on, "left_anti").unionByName(rows.join(again, on, "left_semi").dropDuplicates([key]))


def message_records(zgrams: DataFrame) -> DataFrame:
    """(field, tokens) of each message's body words, instance and sender."""
    def value(c: str) -> Column:
        return F.when(F.col(c) != "", F.array(c))
    pairs = F.array(
        F.struct(F.lit("body").alias("field"), words(F.col("body")).alias("tokens")),
        F.struct(F.lit("instance").alias("field"), value("instance").alias("tokens")),
        F.struct(F.lit("sender").alias("field"), value("sender").alias("tokens")),
    )
    one = once(zgrams.select("zgram_id", "body", "instance", "sender"), "zgram_id")
    return one.select(F.explode(pairs).alias("p")).select("p.*")
