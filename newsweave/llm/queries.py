"""The queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweave.llm import (
    conversations, decontamination, linededup, neighbours, packing, pagetext, personal, secrets, sentencepieces, simhash,
    spellings, tokencounts, toxicity,
)
from newsweave.llm.common import read
from newsweave.session import new_folder

# Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


@query("op3_simhash_components")
def simhash_components(spark, folder):
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


_LINES = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) place
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key
  from lines),
common as (
  select key, max(doc_id) last_doc from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5),
judged as (
  select k.*, c.key is not null and k.doc_id <> c.last_doc gone from keyed k left join common c on k.key = c.key)
select doc_id, count(*) n_lines, sum(gone::int)::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) kept_sha256
from judged group by doc_id"""


@query("op4_line_dedup", _LINES)
def line_dedup(spark, folder):
    kept = linededup.deduplicated(read(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_toxicity")
def toxicity_scores(spark, folder):
    return toxicity.scored(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op1_benchmark_overlaps")
def benchmark_overlaps(spark, folder):
    return decontamination.overlaps(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op2_sentencepiece")
def sentencepiece_ids(spark, folder, tokenizers=TOKENIZERS):
    model = sentencepieces.model_bytes(f"{tokenizers}/piece_bpe_32k.model")
    docs = read(spark, folder, "documents").select("doc_id", "text")
    back = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    return back.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.col("text"), F.lit("")).eqNullSafe(F.col("decoded")).alias("round_trip"))


@query("op10_secrets")
def secret_spans(spark, folder):
    return secrets.report(secrets.scan(read(spark, folder, "documents")))


@query("op7_personal_data")
def personal_spans(spark, folder):
    return personal.report(personal.scan(read(spark, folder, "documents")))


def _rolled_up(spark, folder, tokenizers):
    """The table goes in; the French texts come again revised, the short texts are
    deleted, and the revision comes a second time, which changes nothing."""
    versions = {v: tokencounts.rank_bytes(f"{tokenizers}/{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    docs = read(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    revised = docs.where("lang = 'fr'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" (revised)")))
    rollup = tokencounts.TokenRollup(spark, new_folder(spark, "tokens"))
    rollup.apply("0", docs, versions)
    rollup.apply("1", revised, versions)
    rollup.apply("2", None, versions, deleted=docs.where("length(text) < 200").select("doc_id"))
    rollup.apply("1", revised, versions)
    return rollup.totals()


@query("op9_token_counts")
def token_totals(spark, folder, tokenizers=TOKENIZERS):
    return _rolled_up(spark, folder, tokenizers)


@query("op9_documents_and_characters", """
select source, lang, count(*) docs, sum(length(coalesce(t, '')))::bigint chars from (
  select doc_id, source, lang, case when lang = 'fr' then coalesce("text", '') || ' (revised)' else "text" end t from documents
  where doc_id not in (select doc_id from documents where length("text") < 200))
group by all""")
def document_totals(spark, folder, tokenizers=TOKENIZERS):
    return _rolled_up(spark, folder, tokenizers).where("tokenizer = 'byte_bpe_50k'").select("source", "lang", "docs", "chars")


@query("op6_page_text")
def page_text(spark, folder):
    found = pagetext.extract(read(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_nearest_vectors")
def nearest_vectors(spark, folder):
    return neighbours.nearest(read(spark, folder, "embeddings"))


@query("op11_packed_sequences")
def packed_sequences(spark, folder, tokenizers=TOKENIZERS):
    return packing.pack(read(spark, folder, "documents"), tokencounts.rank_bytes(f"{tokenizers}/byte_bpe_50k.tiktoken"))


@query("op12_repaired_conversations")
def repaired_conversations(spark, folder):
    return conversations.report(read(spark, folder, "conversations"))


@query("op13_spelling_variants")
def spelling_variants(spark, folder):
    return spellings.variants(read(spark, folder, "documents"))
