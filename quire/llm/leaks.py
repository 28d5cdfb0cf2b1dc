"""Evaluation passages in training texts: winnowed fingerprints, joined and extended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.skew import checked_join
from ..session import fits, small, stage

#: Words of a shared passage that must be found, and words of a fingerprint.
SPAN, GRAM = 10, 7
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fingerprints(span: int, gram: int):
    """Words (k, w) to (k, v, h, pos): winnowing, the least hash in each window of span - gram + 1 gram hashes.

    Of equal hashes in a window the last counts. Any ``span`` consecutive words hold a chosen one.
    ``pos`` counts words from 1, ``v`` is a number of the whole text. Each word is hashed once a
    batch, and the hash of a gram is mixed from those of its words.
    """
    width = span - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("w")
            size = pc.list_value_length(w).to_numpy().astype(np.int64)
            words = w.flatten().dictionary_encode()
            of = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in words.dictionary.to_pylist()], np.uint64)
            tok, row, start = of[words.indices.to_numpy()], np.repeat(np.arange(len(size)), size), np.r_[0, np.cumsum(size)]
            at, h, v = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(size), np.uint64)
            if len(tok):
                v = np.r_[np.uint64(0), np.cumsum(_mixed(tok + _mixed(np.arange(len(tok)).astype(np.uint64) - start[row].astype(np.uint64))))]
                v = v[start[1:]] - v[start[:-1]]
            if len(tok) >= span:
                grams = np.zeros(len(tok) - gram + 1, np.uint64)
                for j in range(gram):
                    grams = _mixed(grams + tok[j : j + len(grams)])
                n = len(tok) - span + 1
                first = np.flatnonzero(row[:n] == row[span - 1 :])
                best, at = grams[first], first
                for j in range(1, width):
                    less = grams[first + j] <= best
                    best, at = np.where(less, grams[first + j], best), np.where(less, first + j, at)
                at = np.unique(at)
                h = grams[at]
            r = row[at]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(r)), pa.array(v[r].view(np.int64)), pa.array(h.view(np.int64)), pa.array((at - start[r] + 1).astype(np.int32))], ["k", "v", "h", "pos"])

    return run


def fingerprints(words: DataFrame, span: int, gram: int) -> DataFrame:
    """(k, v, h, pos) of the texts (k, w); texts of fewer than ``span`` words have none."""
    kind = dict(words.dtypes)["k"]
    return words.mapInArrow(_fingerprints(span, gram), f"k {kind}, v long, h long, pos int")


def leaks(train: DataFrame, test: DataFrame, train_id: str, train_text: str, test_id: str, test_text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(train_id, test_id, words, share): texts with at least ``span`` consecutive words in common.

    Words are maximal runs of a-z and 0-9 in the lower-cased text. ``words`` counts the words of
    the test text that lie in common runs of ``span`` words, ``share`` is their share. Null, empty
    and short texts share nothing. Rows repeated under one id are as one: what any of them shares
    counts. Hits are extended by comparing the words around them, so a hash collision gives none.
    """
    a = stage(train.select(F.col(train_id).alias("k"), F.col(train_text).alias("t")).select("k", tokens("t").alias("w")).where(F.size("w") >= span))
    b = stage(test.select(F.col(test_id).alias("k"), F.col(test_text).alias("t")).select("k", tokens("t").alias("w")).where(F.size("w") >= span).distinct())
    fb = stage(fingerprints(b.select("k", "w"), span, gram).select("h", F.col("k").alias("b"), F.col("pos").alias("pos_b")).distinct())
    # the fingerprints of test texts that occur in training texts; common ones meet only as hits
    fa = fingerprints(a.select("k", "w"), span, gram).select(F.col("k").alias("a"), "v", "h", "pos")
    fb, few = fits(fb, BROADCAST_ROWS)
    hits = stage(fa.join(F.broadcast(fb), "h").distinct()) if few else stage(checked_join(stage(fa), fb, "h", "a", 0).distinct())
    wanted = hits.select(F.col("a").alias("k")).distinct()
    texts = checked_join(a, wanted, "k", "k", BROADCAST_ROWS, "left_semi")
    texts = texts.select(F.col("k").alias("a"), F.col("w").alias("wa")).distinct()
    met = hits.select("a", "b", "pos", "pos_b").distinct().join(texts, "a").join(small(b.select(F.col("k").alias("b"), F.col("w").alias("wb")), 10_000), "b")
    off = F.sequence(F.lit(0), F.lit(span - gram))
    whole = F.filter(off, lambda s: (F.col("pos") > s) & (F.col("pos_b") > s) & (F.size(F.slice("wa", F.greatest(F.col("pos") - s, F.lit(1)), span)) == span) & (F.slice("wa", F.greatest(F.col("pos") - s, F.lit(1)), span) == F.slice("wb", F.greatest(F.col("pos_b") - s, F.lit(1)), span)))
    found = met.withColumn("s", whole).where(F.size("s") > 0).select("a", "b", F.size("wb").alias("n"), F.explode(F.flatten(F.transform("s", lambda s: F.sequence(F.col("pos_b") - s, F.col("pos_b") - s + span - 1)))).alias("at"))
    return found.distinct().groupBy("a", "b", "n").agg(F.count("*").alias("words")).groupBy("a", "b").agg(F.max("words").alias("words"), F.max(F.col("words") / F.col("n")).alias("share")).select(F.col("a").alias(train_id), F.col("b").alias(test_id), "words", "share")
