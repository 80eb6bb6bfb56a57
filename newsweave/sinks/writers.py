"""Appends, guarded loads, keyed upserts and file outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from newsweave.operators.corpus import row_mark
from newsweave.operators.joins import BROADCAST_BYTES, row_bytes, salted_join
from newsweave.operators.recommendations import nested
from newsweave.session import cut_lineage
from newsweave.sinks.versions import BUCKET, current, path_exists, read_current, write_next

# Bytes of a bucket of a table that is upserted, its least number of them, and files of
# a bucket beyond which its rows are dealt anew.
BUCKET_BYTES = 64 << 20
MIN_BUCKETS = 8
MOST_FILES = 4


def append(df: DataFrame, path: str | None = None, format: str = "parquet", **options: str) -> None:
    """Add rows to a table. Options such as batch size or acknowledgement go
    through to the connector."""
    df.write.mode("append").format(format).options(**options).save(path)


def has_rows(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> bool:
    if format == "parquet" and not path_exists(spark, path):
        return False
    return not spark.read.format(format).options(**options).load(path).isEmpty()


def load_if_empty(df: DataFrame, path: str, format: str = "parquet", **options: str) -> bool:
    """Append only to a table without rows; tells whether it did."""
    if has_rows(df.sparkSession, path, format, **options):
        return False
    append(df, path, format, **options)
    return True


def load_plan(tables: dict[str, DataFrame], thresholds: dict[str, int]) -> DataFrame:
    """Rows, threshold and action per table: skip above the threshold, else
    load."""
    plan = None
    for name, threshold in thresholds.items():
        row = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(threshold).cast("bigint").alias("threshold"),
            F.when(F.col("rows") > threshold, "skip").otherwise("load").alias("action"),
        )
        plan = row if plan is None else plan.unionByName(row)
    return plan


def merged(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` after the source's columns were set for every key of the
    source. Other columns and other rows stay; new keys are added. Keys are
    unique on both sides."""
    set_columns = [c for c in source.columns if c != key]
    both = target.withColumn("_in_target", F.lit(True)).alias("t").join(
        source.withColumn("_in_source", F.lit(True)).alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full"
    )
    columns = [F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(key)]
    for name in target.columns:
        if name == key:
            continue
        if name in set_columns:
            columns.append(
                F.when(F.col("_in_source"), F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
            )
        else:
            columns.append(F.col(f"t.{name}").alias(name))
    columns += [F.col(f"s.{name}").alias(name) for name in set_columns if name not in target.columns]
    return both.select(*columns)


def _bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _wider(target: StructType, source: StructType) -> StructType:
    """The schema of a table after an upsert: all columns can be null."""
    fields = {f.name: StructField(f.name, f.dataType, True) for f in [*target.fields, *source.fields] if f.name != BUCKET}
    return StructType(list(fields.values()))


def upsert(source: DataFrame, root: str, key: str, budget: int = BROADCAST_BYTES) -> DataFrame:
    """:func:`merged` with the newest rows below ``root``. Gives the table back.

    Rows lie in buckets by a hash of the key, as many as the table's bytes want. The
    next version holds the buckets that the source touches and no others, whose files
    stay where they are. A key that the source holds twice, or null, is an error; so
    the table never gets one. A source within ``budget`` bytes is broadcast to the
    target's buckets, which are rewritten where they are read: no row of the target
    is shuffled. Only beyond that, when buckets have outgrown BUCKET_BYTES or fallen
    into many files, the rows are dealt anew.
    """
    spark = source.sparkSession
    now = current(spark, root)
    size = row_bytes(source)
    source = cut_lineage(source)
    per_key = source.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    worst = F.max(F.struct("n", F.col(key).alias("key"))).alias("worst")
    facts = per_key.agg(worst, F.coalesce(F.bool_or(F.col(key).isNull()), F.lit(False)).alias("nulls"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
                        F.collect_set(_bucket_of(key, now.buckets if now and now.buckets else 1)).alias("buckets")).first()
    if facts["nulls"] or (facts["worst"] is not None and facts["worst"]["n"] > 1):
        bad = None if facts["nulls"] else facts["worst"]["key"]
        raise ValueError(f"the source of an upsert needs one row per key, found {bad!r} more than once or null")
    if now is None:
        buckets = max(MIN_BUCKETS, -(-facts["bytes"] // BUCKET_BYTES))
        schema = _wider(StructType(), source.schema)
        rows = source.withColumn(BUCKET, _bucket_of(key, buckets)).repartition(BUCKET)
        write_next(rows, root, 0, schema, buckets)
        return read_current(spark, root)
    touched = set(facts["buckets"])
    if not touched:
        return read_current(spark, root)
    schema = _wider(now.schema, source.schema)
    stored = sum(size for size, _ in now.sizes.values())
    wanted = max(MIN_BUCKETS, -(-stored // BUCKET_BYTES))
    grown = wanted > 2 * now.buckets
    buckets = wanted if grown else now.buckets
    target = now.read(spark, None if grown else touched)
    scattered = sum(now.sizes[b][1] for b in touched if b in now.sizes) > MOST_FILES * max(len(touched), 1)
    in_place = facts["bytes"] <= budget and not grown and not scattered
    if target is None:
        rows = source
    elif in_place:
        keys = F.broadcast(source.select(key))
        # At most the source's keys, so this side is within the bound as well.
        known = target.select(key).join(keys, key, "left_semi")
        fresh = source.join(F.broadcast(known), key, "left_anti")
        set_columns = [c for c in source.columns if c != key]
        renamed = F.broadcast(source.select(key, *[F.col(c).alias(f"_set_{c}") for c in set_columns], F.lit(True).alias("_set")))
        changed = target.join(renamed, key, "left").select(*[
            F.when(F.col("_set"), F.col(f"_set_{f.name}")).otherwise(F.col(f.name) if f.name in target.columns else F.lit(None)).alias(f.name)
            if f.name in set_columns else F.col(f.name) for f in schema.fields])
        fresh = fresh.withColumn(BUCKET, _bucket_of(key, buckets)).repartition(BUCKET).drop(BUCKET)
        rows = changed.unionByName(fresh, allowMissingColumns=True)
    else:
        rows = merged(target, source, key)
    rows = rows.withColumn(BUCKET, _bucket_of(key, buckets))
    write_next(rows if in_place and target is not None else rows.repartition(BUCKET), root, now.version, schema, buckets, grown)
    return read_current(spark, root)


def upsert_recommendations(flat: DataFrame, root: str) -> DataFrame:
    """Replace each user's recommendations; users not in ``flat`` stay."""
    return upsert(nested(flat), root, "userId")


def append_recommendations(flat: DataFrame, path: str, format: str = "parquet", **options: str) -> None:
    append(nested(flat), path, format, **options)


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def split_insert(
    rows: DataFrame, key: str, order: list[str], existing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of an insert that goes on past bad rows. Exactly
    one row of a key is accepted: the first by ``order``, then by the hash of its
    values; identical rows are told apart by their place. Rejected rows say why: a
    null key, a repeated key, or a key the table already has. The rows are
    numbered and written out once, as both results read them."""
    numbered = cut_lineage(rows.withColumn("_place", F.monotonically_increasing_id()))
    keyed = numbered.filter(F.col(key).isNotNull())
    rejected = numbered.filter(F.col(key).isNull()).withColumn("reason", F.lit("null key"))
    first = F.min_by("_place", F.struct(*order, row_mark(rows.columns), "_place"))
    firsts = keyed.groupBy(key).agg(first.alias("_first"))
    if existing is not None:
        present = existing.select(key).distinct().withColumn("_present", F.lit(True))
        firsts = firsts.join(present, key, "left")
    else:
        firsts = firsts.withColumn("_present", F.lit(None).cast("boolean"))
    judged = salted_join(keyed, firsts, key).withColumn(
        "reason",
        F.when(F.col("_present"), "existing key").when(F.col("_place") != F.col("_first"), "repeated key"),
    )
    judged = cut_lineage(judged.select(*rows.columns, "reason"))
    accepted = judged.filter(F.col("reason").isNull()).select(*rows.columns)
    return accepted, rejected.select(*rows.columns, "reason").unionByName(judged.filter(F.col("reason").isNotNull()))


def insert_past_errors(rows: DataFrame, path: str, key: str, order: list[str]) -> DataFrame:
    """Append the accepted rows of :func:`split_insert` and return the rejected,
    which are written out first, as the append changes what they depend on."""
    spark = rows.sparkSession
    existing = spark.read.parquet(path) if path_exists(spark, path) else None
    accepted, rejected = split_insert(rows, key, order, existing)
    rejected = cut_lineage(rejected)
    append(accepted, path)
    return rejected


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, in as many files as there are partitions."""
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("errorifexists").csv(path, header=True)
