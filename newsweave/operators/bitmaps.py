"""Sets of items and of users as bitmaps, which merge by OR and are asked by a bit test.

Ids such as ``N12`` count by their number; an id of any other form keeps a row of its
own, so every set is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Bits of one of Spark's bitmaps, and of a word of an item set.
BITMAP_BITS = 32768
WORD_BITS = 64


def id_number(value: Column, prefix: str) -> Column:
    """12 for ``prefix`` followed by 12; null for every other spelling, so that no
    two ids share a number."""
    text = value.cast("string")
    number = F.substring(text, len(prefix) + 1, 20).try_cast("bigint")
    return F.when((number >= 0) & (F.concat(F.lit(prefix), number.cast("string")) == text), number)


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (number % WORD_BITS).cast("int"))


def _placed(df: DataFrame, item: str, prefix: str) -> DataFrame:
    """``df`` with the word, the bit and, for ids without a number, the id."""
    number = id_number(F.col(item), prefix)
    return df.withColumns({
        "_word": F.shiftright(number, WORD_BITS.bit_length() - 1), "_bit": _bit(number),
        "_other": F.when(number.isNull(), F.col(item).cast("string")),
    })


def item_words(pairs: DataFrame, user: str = "user_id", item: str = "news_id", prefix: str = "N") -> DataFrame:
    """(user, word, other, bits): the set of each user's items, 64 numbers a row.
    Word w holds the numbers from 64 w on, bit b of ``bits`` the number 64 w + b. Ids
    without a number have word null and the id in ``other``. Null items are left out.

    Words rather than Spark's bitmaps of 4 kB, as most users click few of many items;
    no row grows with a user, and a user with a third of all clicks is many keys.
    """
    placed = _placed(pairs.where(F.col(item).isNotNull()), item, prefix)
    return placed.groupBy(user, F.col("_word").alias("word"), F.col("_other").alias("other")).agg(
        F.bit_or("_bit").alias("bits"))


def merged_words(*sets: DataFrame, user: str = "user_id") -> DataFrame:
    """The union of item sets."""
    rows = reduce(DataFrame.unionByName, sets)
    return rows.groupBy(user, "word", "other").agg(F.bit_or("bits").alias("bits"))


def item_counts(words: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, items): the size of each user's set."""
    return words.groupBy(user).agg(F.sum(F.coalesce(F.bit_count("bits"), F.lit(1))).cast("bigint").alias("items"))


def items_of(words: DataFrame, item: str = "news_id", prefix: str = "N") -> DataFrame:
    """The sets as rows again, one per user and item."""
    numbers = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda b: F.call_function("getbit", F.col("bits"), b) == 1),
        lambda b: F.concat(F.lit(prefix), (F.col("word") * WORD_BITS + b).cast("string")))
    listed = F.when(F.col("word").isNull(), F.array("other")).otherwise(numbers)
    kept = [c for c in words.columns if c not in ("word", "other", "bits")]
    return words.select(*kept, F.explode(listed).alias(item))


def with_label(recommendations: DataFrame, words: DataFrame, user: str = "user_id", item: str = "news_id",
               prefix: str = "N") -> DataFrame:
    """Label 1 where the recommended item is in the user's set of ``words``, else 0.
    A null item is in no set."""
    placed = _placed(recommendations, item, prefix)
    sets = words.select(F.col(user).alias("_user"), F.col("word").alias("_w"), F.col("other").alias("_o"),
                        F.col("bits").alias("_bits"), F.lit(True).alias("_found"))
    met = placed.join(sets, (F.col(user) == F.col("_user")) & F.col("_word").eqNullSafe(F.col("_w"))
                      & F.col("_other").eqNullSafe(F.col("_o")), "left")
    inside = F.col("_found") & (F.col("_word").isNull() | (F.col("_bits").bitwiseAND(F.col("_bit")) != 0))
    return met.select(*recommendations.columns, F.when(inside, 1).otherwise(0).alias("label"))


def id_bitmaps(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """(bucket, other, bits): the set of all ids of a column, 32,768 numbers a bitmap.
    For ids that are numbered densely, as those of users are. Nulls are left out."""
    number = id_number(F.col(column), prefix)
    rows = df.where(F.col(column).isNotNull()).select(
        F.bitmap_bucket_number(number).alias("bucket"), F.when(number.isNull(), F.col(column).cast("string")).alias("other"),
        F.bitmap_bit_position(number).alias("_place"))
    numbered = rows.where("bucket is not null").groupBy("bucket").agg(F.bitmap_construct_agg("_place").alias("bits"))
    others = rows.where("bucket is null").select("other").distinct()
    return numbered.unionByName(others, allowMissingColumns=True).select("bucket", "other", "bits")


def merged_bitmaps(*sets: DataFrame) -> DataFrame:
    """The union of id sets, as of the days of a log."""
    return reduce(DataFrame.unionByName, sets).groupBy("bucket", "other").agg(
        F.when(F.col("bucket").isNotNull(), F.bitmap_or_agg("bits")).alias("bits"))


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """The ids of both sets: bitmaps of one bucket meet, not the rows behind them."""
    both = left.withColumnRenamed("bits", "_left").join(
        right.select(F.col("bucket").alias("_b"), F.col("other").alias("_o"), F.col("bits").alias("_right")),
        F.col("bucket").eqNullSafe(F.col("_b")) & F.col("other").eqNullSafe(F.col("_o")))
    pair = both.select("bucket", "other", F.explode(F.array("_left", "_right")).alias("bits"))
    return pair.groupBy("bucket", "other").agg(F.when(F.col("bucket").isNotNull(), F.bitmap_and_agg("bits")).alias("bits"))


def size_of(bitmaps: DataFrame, out: str = "ids") -> DataFrame:
    """How many ids a set holds; one row."""
    return bitmaps.agg(F.coalesce(F.sum(F.coalesce(F.bitmap_count("bits"), F.lit(1))), F.lit(0)).cast("bigint").alias(out))


def ids_of(bitmaps: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """The set as rows again, as strings, byte by byte."""
    numbered = bitmaps.where("bucket is not null").select("bucket", "bits", F.explode(
        F.sequence(F.lit(0), F.lit(BITMAP_BITS // 8 - 1))).alias("_byte"))
    value = F.conv(F.hex(F.expr("substring(bits, _byte + 1, 1)")), 16, 10).cast("int")
    held = numbered.select("bucket", "_byte", value.alias("_value")).where("_value > 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.call_function("getbit", F.col("_value"), b) == 1)
    rows = held.select("bucket", F.explode(F.transform(places, lambda b: F.col("_byte") * 8 + b)).alias("_place"))
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITMAP_BITS + F.col("_place") + 1).otherwise(F.col("_place"))
    others = bitmaps.where("bucket is null").select(F.col("other").alias(column))
    return rows.select(F.concat(F.lit(prefix), number.cast("string")).alias(column)).unionByName(others)
