"""Encoding a corpus with a public byte-level BPE: each distinct pre-token is encoded once."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import HEAVY_PARTS, salted_join
from ..session import stage

#: Where the public vocabularies lie and the rank file in use; both are parameters.
FOLDER, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: The published pattern of this vocabulary, \s as Unicode white space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most frequent words, at most so many, are broadcast with their ids; all others are joined by a shuffle.
HEAD = 20_000
#: Characters of a word in that broadcast at most.
LONG = 64


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    # the words are cut by the caller: the pattern takes each whole
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("w"), pa.array(ids, pa.list_(pa.int32())), b.column("n")], ["w", "ids", "n"])

    return run


def pre_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, pos, w): the pre-tokens of each text with positions; (k, null, null) where there are none."""
    words = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(PATTERN), F.lit(0))
    one = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return one.select("k", F.posexplode_outer(words).alias("pos", "w"))


def dictionary(words: DataFrame, path: str) -> DataFrame:
    """(w, ids, n) of the distinct words, each encoded once, with the number of its occurrences."""
    return words.where("w is not null").groupBy("w").agg(F.count("*").alias("n")).mapInArrow(_encode(path), "w string, ids array<int>, n long")


def encode(df: DataFrame, key: str, text: str, folder: str = FOLDER, file: str = RANKS) -> DataFrame:
    """(key, ids): the token ids of every text, an empty list for an empty and for a null one.

    Texts are neither trimmed nor normalised and special tokens' strings are ordinary text. ``key``
    must be unique and not null. The pre-tokens are exploded with their positions, the distinct
    words encoded once and joined back: the HEAD most frequent ones, which hold most occurrences,
    by a broadcast of bounded size, all others by a shuffle on the word. A hot word of more than LONG
    characters, which the broadcast leaves out, is salted, so no task gets a hot word.
    """
    path = f"{folder}/{file}"
    toks = pre_tokens(df, key, text)
    words = stage(dictionary(toks, path))
    head = words.where(F.length("w") <= LONG).orderBy(F.desc("n"), "w").limit(HEAD).select("w", "ids")
    met = toks.join(F.broadcast(head), "w", "left")
    here = met.where("w is null or ids is not null").select("k", "pos", "ids")
    rest = met.where("w is not null and ids is null").select("k", "pos", "w")
    others = words.join(F.broadcast(head.select("w")), "w", "left_anti").select("w", "ids")
    # words too long for the broadcast that are one in HEAVY_PARTS occurrences, at most as many, told by their hash
    total = words.agg(F.sum("n")).first()[0] or 0
    heavy = [r["h"] for r in words.where((F.length("w") > LONG) & (F.col("n") * HEAVY_PARTS >= total)).select(F.xxhash64("w").alias("h")).collect()]
    rest = salted_join(rest, others.hint("shuffle_hash"), ["w"], "k", heavy=heavy).select("k", "pos", "ids")
    whole = here.unionByName(rest).groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "ids")))).alias("p"))
    return whole.select(F.col("k").alias(key), F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def token_bytes(spark: SparkSession, folder: str = FOLDER, file: str = RANKS) -> DataFrame:
    """(id, bytes) of the vocabulary: as many rows as it has ids, whatever the corpus."""
    rows = [(i, bytearray(b)) for b, i in ranks(f"{folder}/{file}").items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(encoded: DataFrame, key: str, folder: str = FOLDER, file: str = RANKS) -> DataFrame:
    """(key, text): the bytes of the ids joined in order; an empty list gives the empty text."""
    table = token_bytes(encoded.sparkSession, folder, file)
    x = encoded.select(F.col(key).alias("k"), F.posexplode_outer("ids").alias("pos", "id"))
    # the vocabulary is of a fixed size
    x = x.join(F.broadcast(table), "id", "left").groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("bytes").alias("b"))))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda y: y["b"]), ""))
    return x.select(F.col("k").alias(key), F.decode(joined, "UTF-8").alias("text"))
