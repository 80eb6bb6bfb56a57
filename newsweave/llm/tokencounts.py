"""Token counts by source, language and tokenizer, kept up by signed deltas."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsweave.session import cut_lineage

# Fixed value: how a byte-level BPE of this family cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LEDGER = "doc_id long, source string, lang string, tokenizer string, tokens long, chars long, sign long"
_TOTALS = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def rank_bytes(path: str) -> bytes:
    """The ranks file, read on the driver and sent along with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def token_counts(docs: DataFrame, tokenizers: dict[str, bytes]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens, chars) for each row of ``docs``
    and each tokenizer version. Null texts have 0 tokens and characters."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    names = ["doc_id", "source", "lang", "tokenizer", "tokens", "chars"]

    def run(batches):
        import tiktoken

        encoders = {}
        for version, data in shared.value.items():
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            encoders[version] = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            if not batch.num_rows:
                continue
            chars = pa.array([len(t.as_py() or "") for t in batch.column(3)], pa.int64())
            for version, encoder in encoders.items():
                tokens = [len(encoder.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(3)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(3)), pa.array([version] * batch.num_rows), pa.array(tokens, pa.int64()), chars], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, source string, lang string, tokenizer string, tokens long, chars long")


@dataclass
class TokenRollup:
    """Totals below one folder. Each batch owns three folders: its signed ledger
    rows, the totals it adds, and last its commit. Only committed batches count.
    A batch that was committed changes nothing when it comes again, and one that
    broke off overwrites what it left."""

    spark: SparkSession
    path: str

    def committed(self) -> list[str]:
        """The ids of committed batches: one short row for each batch."""
        try:
            rows = self.spark.read.schema("id string").parquet(f"{self.path}/commits/*").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return sorted(r["id"] for r in rows)

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/{b}" for b in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """One row for each document and tokenizer that the ledger holds now."""
        keys = ["doc_id", "source", "lang", "tokenizer", "tokens", "chars"]
        return self._read("ledger", _LEDGER).groupBy(*keys).agg(F.sum("sign").alias("sign")).where("sign > 0")

    def apply(self, batch: str, docs: DataFrame | None, tokenizers: dict[str, bytes], deleted: DataFrame | None = None) -> None:
        """Take in new and revised documents ``docs`` (doc_id, source, lang, text)
        and the ids ``deleted`` (doc_id) as one batch.

        A document is its doc_id: of rows that repeat one in a batch, the one with
        the greatest (source, lang, tokens, chars) counts, once; a new revision
        takes back what the ledger holds of it. Rows without doc_id are documents
        of their own that cannot be revised. Deleting what isn't there does nothing;
        an id that is in both is deleted.
        """
        done = self.committed()
        if batch in done:
            return
        fresh = None
        if docs is not None:
            counted = cut_lineage(token_counts(docs, tokenizers))
            best = Window.partitionBy("doc_id", "tokenizer").orderBy(*[F.desc(c) for c in ("source", "lang", "tokens", "chars")])
            named = counted.where("doc_id is not null").withColumn("_row", F.row_number().over(best)).where("_row = 1").drop("_row")
            if deleted is not None:
                named = named.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")
            fresh = named.unionByName(counted.where("doc_id is null")).withColumn("sign", F.lit(1).cast("long"))
        gone = None
        if done:
            held, touched = self.current(), None
            if fresh is not None:
                touched = fresh.where("doc_id is not null").select("doc_id", "tokenizer").distinct()
                gone = held.join(touched, ["doc_id", "tokenizer"], "left_semi")
            if deleted is not None:
                out = held.join(deleted.select("doc_id").distinct(), "doc_id", "left_semi").select(*held.columns)
                gone = out if gone is None else gone.select(*held.columns).unionByName(out).distinct()
            if gone is not None:
                gone = gone.withColumn("sign", -F.col("sign"))
        rows = [x for x in (fresh, gone) if x is not None]
        empty = self.spark.createDataFrame([], _LEDGER)
        ledger = rows[0].unionByName(rows[1]) if len(rows) == 2 else rows[0] if rows else empty
        ledger.select(*empty.columns).write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        own = self.spark.read.schema(_LEDGER).parquet(f"{self.path}/ledger/{batch}")
        # Summed in each task first, so a source with a third of all rows is no burden.
        own.groupBy("source", "lang", "tokenizer").agg(
            F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
            F.sum(F.col("sign") * F.col("chars")).alias("chars"),
        ).write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        self.spark.createDataFrame([(batch,)], "id string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, chars) of all that is held;
        groups without documents are left out."""
        return self._read("totals", _TOTALS).groupBy("source", "lang", "tokenizer").agg(
            *[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")]).where("docs > 0")
