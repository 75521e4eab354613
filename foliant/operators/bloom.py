"""A Bloom filter of keys at any size, as a table of 64-bit words.

A key's hash names one word and BITS of its bits, so the filter is an aggregate (the OR of the keys of a word) and a probe is a
join on the word. Up to MAX_KEYS keys the table, whose size is bounded by the number of words, is broadcast; beyond it is
partitioned by word: each task owns a range of hashes, builds the words of that range and is sent the probes that fall into it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.staging import stage

#: Up to this many distinct keys the filter (at most MAX_KEYS / KEYS_PER_WORD rows of 16 bytes) is broadcast.
MAX_KEYS = 1_000_000
KEYS_PER_WORD, BITS = 4, 4


@dataclass
class Bloom:
    """words: (word, bits); n_words: how many there may be."""

    words: DataFrame
    n_words: int
    broadcast: bool


def _word(key: str, n_words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_words)).cast("long")


def _bits(key: str) -> Column:
    """The bits of a key in its word, from a second hash."""
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{key}`, 'bits'), {6 * i}) & 63 as int))" for i in range(BITS)))


def build(df: DataFrame, key: str, max_keys: int = MAX_KEYS) -> Bloom:
    """The filter of ``df[key]``; one pass, partial words are merged before they move."""
    n = df.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    n_words = int(n * 1.1 / KEYS_PER_WORD) + 64
    words = df.where(F.col(key).isNotNull()).select(_word(key, n_words).alias("word"), _bits(key).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return Bloom(stage(words, "bloom"), n_words, n * 1.1 <= max_keys)


def mark(df: DataFrame, bloom: Bloom, key: str, name: str = "maybe") -> DataFrame:
    """``df`` with a boolean column: False proves that the key was not added. Null keys are False."""
    words = bloom.words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    words = F.broadcast(words) if bloom.broadcast else words.hint("shuffle_hash")
    joined = df.withColumn("__word", _word(key, bloom.n_words)).join(words, "__word", "left")
    mask = _bits(key)
    return joined.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False)) & F.col(key).isNotNull()).drop("__word", "__bits")
