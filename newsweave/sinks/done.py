"""Ids that are done, beside a Bloom filter that keeps new rows out of the anti join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsweave.operators.corpus import not_yet
from newsweave.operators.joins import BROADCAST_BYTES
from newsweave.sinks.versions import path_exists

# Ids a word of 64 bits stands for, and bits an id sets in its word.
IDS_PER_WORD = 4
BITS_PER_ID = 4
# Bytes of a broadcast word with its number, as a hashed relation keeps it.
WORD_BYTES = 32


def words_for(ids: int) -> int:
    """The power of two of words that a filter of ``ids`` ids needs."""
    return 1 << max((-(-ids // IDS_PER_WORD) - 1).bit_length(), 10)


def _word(key: Column, words: int) -> Column:
    return F.xxhash64(key).bitwiseAND(words - 1)


def _mask(key: Column) -> Column:
    # A second hash names the bits, six of its own bits for each.
    spread = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(63).cast("int"))
            for i in range(BITS_PER_ID)]
    return reduce(Column.bitwiseOR, bits)


def filter_of(ids: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits): the Bloom filter of ``words`` words over the ids, by partial
    aggregates, so that a task sends each word once at most."""
    text = F.col(key).cast("string")
    return ids.where(text.isNotNull()).groupBy(_word(text, words).alias("word")).agg(F.bit_or(_mask(text)).alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of all ids of filters with as many words."""
    return reduce(DataFrame.unionByName, filters).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def with_guess(df: DataFrame, screen: DataFrame, key: str, words: int, out: str = "_maybe") -> DataFrame:
    """``df`` with whether the filter may hold the key; false is certain."""
    text = F.col(key).cast("string")
    named = F.broadcast(screen.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    mask = _mask(text)
    met = df.join(named, _word(text, words) == F.col("_word"), "left")
    held = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    return met.withColumn(out, held & text.isNotNull()).drop("_word", "_bits")


class DoneIds:
    """The done ids of ``key`` in a folder: ``ids`` and ``filter-<words>``.

    An append writes the filter's words first and then the ids, so a run that breaks
    off in between leaves a filter that holds too much, which costs a look and no row.
    Appended words are merged when they are read; a filter whose first write did not end
    is not used. Ids may be appended more than once;
    null ids are never done.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "news_id", expected: int = 1_000_000):
        self.spark, self.root, self.key, self.expected = spark, root, key, expected

    def _filter(self, words: int) -> str:
        return f"{self.root}/filter-{words}"

    def _complete(self, words: int) -> bool:
        # Spark's mark of a write that ended; a filter that lacks words must not be asked.
        return path_exists(self.spark, f"{self._filter(words)}/_SUCCESS")

    def words(self) -> int:
        """Words of the filter in use: the largest that was written."""
        words, found = words_for(1), 0
        while words <= 1 << 40:
            found = words if self._complete(words) else found
            words *= 2
        return found or words_for(self.expected)

    def ids(self) -> DataFrame | None:
        path = f"{self.root}/ids"
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    def append(self, done: DataFrame) -> None:
        """Add the ids of ``done``. A filter that has become too full is made anew
        from all ids, with room for twice as many."""
        rows, before, words = done.select(self.key).where(F.col(self.key).isNotNull()), self.ids(), self.words()
        held = before.count() if before is not None else 0
        if held > words * IDS_PER_WORD:
            words = words_for(2 * held)
            # All words are written at once, those of the new ids among them.
            filter_of(before.unionByName(rows), self.key, words).write.mode("append").parquet(self._filter(words))
        else:
            filter_of(rows, self.key, words).write.mode("append").parquet(self._filter(words))
        rows.write.mode("append").parquet(f"{self.root}/ids")

    def screen(self) -> DataFrame | None:
        words = self.words()
        return merged(self.spark.read.parquet(self._filter(words))) if self._complete(words) else None

    def not_yet(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose id is not done, rows with a null id among them. Rows
        that the filter rules out are done with; only possible hits are shuffled to
        the ids. ``df`` is read for both parts, so it should be a stored table. A filter beyond the
        broadcast bound is left out: the anti join alone gives the same rows."""
        ids, screen = self.ids(), self.screen()
        if ids is None:
            return df
        if screen is None or self.words() * WORD_BYTES > BROADCAST_BYTES:
            return not_yet(df, ids, self.key)
        guessed = with_guess(df, screen, self.key, self.words())
        possible = guessed.where("_maybe").drop("_maybe")
        return guessed.where("not _maybe").drop("_maybe").unionByName(not_yet(possible, ids, self.key))
