"""Occurrence and record counts of every n-gram by a suffix array with common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import slots, stage

#: A term is rare with at most so many occurrences, common from this share of the records on.
RARE_MOST, COMMON_SHARE = 2, 0.25
#: Sorts before every character of a token, so that equal leading tokens are neighbours; no token holds it.
SEP = "\u0001"
#: Token places of a block in which the tokens of a record are put side by side.
BLOCK = 4096


def text_tokens(df: DataFrame, record: str, tokens: str) -> DataFrame:
    """(rec, pos, term): the tokens of an array column with their places; null and empty arrays have none."""
    return df.select(F.col(record).alias("rec"), F.posexplode(tokens).alias("pos", "term"))


def _record(df: DataFrame) -> list[str]:
    """The columns that tell a record: rec, or rec0, rec1 and so on."""
    return [c for c in df.columns if c.startswith("rec")]


def posting_tokens(postings: DataFrame, *record: str) -> DataFrame:
    """(rec0, ..., pos, term): the token sequence an index was made from, out of postings (term, tf, positions).

    The record's columns stay apart, so postings that lie by term and record need no shuffle for
    the order within the record.

    A posting has tf occurrences, or as many as positions where tf is null; null tf and positions are
    none. Of more positions than occurrences the first count. Occurrences beyond the positions have
    negative places, each two apart: they are next to no other token.
    """
    n = F.coalesce(F.col("tf").cast("int"), F.size("positions"), F.lit(0))
    at = F.slice(F.coalesce("positions", F.array().cast("array<int>")), 1, F.greatest(n, F.lit(0)))
    lost = F.when(n > F.size("at"), F.transform(F.sequence(F.lit(1), n - F.size("at")), lambda i: -2 * i)).otherwise(F.array().cast("array<int>"))
    recs = [F.col(c).alias(f"rec{i}") for i, c in enumerate(record)]
    known = postings.where(n > 0).select(*recs, "term", "tf", "positions").withColumn("at", at)
    return known.select(*_record(known), F.explode(F.concat("at", lost)).alias("pos"), "term")


def suffixes(tokens: DataFrame, max_n: int) -> DataFrame:
    """(rec..., head, sfx, len): the suffix that begins at each token, as far as ``max_n`` tokens.

    ``head`` is its first token. A gap in the places ends a suffix. The tokens of a record are put
    side by side in blocks of BLOCK places, each with the first max_n - 1 of the next, so a record
    of any length is many small groups.
    """
    rec = _record(tokens)
    t = tokens.select(*rec, "pos", "term")
    if max_n == 1:
        return t.select(*rec, F.col("term").alias("head"), F.col("term").alias("sfx"), F.lit(1).alias("len"))
    block = F.floor(F.col("pos") / BLOCK)
    both = F.when(F.pmod("pos", F.lit(BLOCK)) < max_n - 1, F.array(block, block - 1)).otherwise(F.array(block))
    t = t.withColumn("block", F.explode(both))
    w = Window.partitionBy(*rec, "block").orderBy("pos")
    follows = [F.when(F.lead("pos", i).over(w) == F.col("pos") + i, F.lead("term", i).over(w)).alias(f"t{i}") for i in range(1, max_n)]
    t = t.select("*", *follows).where(F.col("block") == block)
    # a null ends the suffix: what stands behind a gap is no part of it
    known, run = [F.col("term")], F.lit(True)
    for i in range(1, max_n):
        run = run & F.col(f"t{i}").isNotNull()
        known.append(F.when(run, F.col(f"t{i}")))
    return t.select(*rec, F.col("term").alias("head"), F.concat_ws(SEP, *known).alias("sfx"), sum((c.isNotNull().cast("int") for c in known[1:]), F.lit(1)).alias("len"))


def record_order(sfx: DataFrame, max_n: int) -> DataFrame:
    """(sfx, len, dup, w): the suffixes of all records, counted, with their place in their own record.

    ``dup`` is the number of leading tokens a suffix shares with its predecessor in the sorted
    suffixes of its own record: for n-grams up to that length it is a further occurrence in a
    record that has been counted. Suffixes of different first tokens share none, so each first
    token of a record is sorted for itself. Equal suffixes are counted before the global sort.
    """
    w = Window.partitionBy(*_record(sfx), "head").orderBy("sfx")
    s = sfx.withColumn("prev", F.lag("sfx").over(w))
    if max_n == 1:
        dup = F.col("prev").isNotNull().cast("int")
    else:
        own, prev = F.split("sfx", SEP), F.split("prev", SEP)
        # the first place where the two differ, in the shorter one's length
        same = F.array_position(F.zip_with(F.slice(own, 1, F.least(F.size(own), F.size(prev))), F.slice(prev, 1, F.least(F.size(own), F.size(prev))), lambda a, b: a == b), False)
        dup = F.when(F.col("prev").isNull(), 0).when(F.col("sfx") == F.col("prev"), F.col("len")).when(same == 0, F.least(F.size(own), F.size(prev))).otherwise(same - 1).cast("int")
    return s.select("sfx", "len", dup.alias("dup")).groupBy("sfx", "len", "dup").agg(F.count("*").alias("w"))


def _intervals(max_n: int):
    """Over the suffixes of a partition in order: for each depth n the runs of suffixes with n common leading tokens.

    The last run of a batch goes on in the next one. ``edge`` marks the first and the last run of
    each depth, which may go on in another partition.
    """
    names = ["ngram", "n", "occurrences", "records", "edge"]

    def rows(grams: list, n: int, occ, rec, edge) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()) if isinstance(grams, list) else grams, pa.array(np.full(len(occ), n, np.int32)), pa.array(occ, pa.int64()), pa.array(rec, pa.int64()), pa.array(edge, pa.bool_())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # depth -> (n-gram, occurrences, records, whether it is the first run)
        for b in batches:
            w, dup, sfx, size = b.column("w").to_numpy(), b.column("dup").to_numpy(), b.column("sfx"), b.column("len").to_numpy()
            for n in range(1, max_n + 1):
                keep = size >= n
                if not keep.any():
                    continue
                at = pa.array(np.flatnonzero(keep))
                p = sfx.take(at)
                if n < max_n:
                    p = pc.binary_join(pc.list_slice(pc.split_pattern(p, SEP), 0, n), SEP)
                wn, dn = w[keep], dup[keep]
                starts = np.r_[0, 1 + np.flatnonzero(pc.not_equal(p[1:], p[:-1]).to_numpy(zero_copy_only=False))].astype(np.int64)
                occ, rec = np.add.reduceat(wn, starts), np.add.reduceat(np.where(dn < n, wn, 0), starts)
                grams, first = p.take(pa.array(starts)), n not in held
                if not first:
                    if grams[0].as_py() == held[n][0]:
                        occ[0] += held[n][1]
                        rec[0] += held[n][2]
                        first = held[n][3]
                    else:
                        yield rows([held[n][0]], n, [held[n][1]], [held[n][2]], [held[n][3]])
                last = len(starts) - 1
                if last:
                    edge = np.zeros(last, bool)
                    edge[0] = first
                    yield rows(grams[:last], n, occ[:last], rec[:last], edge)
                held[n] = (grams[last].as_py(), int(occ[last]), int(rec[last]), first and not last)
        for n, (g, occ, rec, _) in held.items():
            yield rows([g], n, [occ], [rec], [True])

    return run


def interval_counts(ordered: DataFrame, max_n: int) -> DataFrame:
    """(ngram, n, occurrences, records) of every n-gram of the suffixes (sfx, len, dup, w).

    The suffixes are range-partitioned and sorted: a distributed suffix array. Adjacent suffixes
    with n common leading tokens form the interval of an n-gram; its weight is the number of
    occurrences, the weight of suffixes with ``dup`` < n the number of records. Only the first and
    the last interval of a partition can go on in another, and only these, 2 * max_n of each
    partition, are merged.
    """
    s = ordered.select("sfx", F.col("len").cast("int").alias("len"), F.col("dup").cast("int").alias("dup"), F.col("w").cast("long").alias("w"))
    s = s.repartitionByRange(slots(s.sparkSession), "sfx", "dup").sortWithinPartitions("sfx", "dup")
    parts = stage(s.mapInArrow(_intervals(max_n), "ngram string, n int, occurrences long, records long, edge boolean"))
    edges = parts.where("edge").groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return parts.where("not edge").drop("edge").unionByName(edges).withColumn("ngram", F.replace("ngram", F.lit(SEP), F.lit(" ")))


def ngram_counts(tokens: DataFrame, max_n: int = 3) -> DataFrame:
    """Counts of all n-grams up to ``max_n`` tokens over tokens (rec..., pos, term), one row per n-gram.

    ``max_n`` has no upper limit; each n-gram is a row, so long ones are worth asking for only where
    records are short. A record with no token has no n-gram, an empty table gives no row, and rows
    of one record id are one record. No place is taken twice in a record. Tokens hold no SEP.
    """
    if max_n < 1:
        raise ValueError("n-grams have one token at least")
    return interval_counts(record_order(suffixes(tokens, max_n), max_n), max_n)


def marked(counts: DataFrame, n_records: int, rare_most: int = RARE_MOST, common_share: float = COMMON_SHARE) -> DataFrame:
    """Adds ``marks``: rare and common, either, both or none, for a collection of ``n_records`` records."""
    rare = F.when(F.col("occurrences") <= rare_most, F.lit("rare"))
    common = F.when(F.col("records") >= F.lit(common_share * n_records), F.lit("common"))
    return counts.withColumn("marks", F.array_compact(F.array(rare, common)))
