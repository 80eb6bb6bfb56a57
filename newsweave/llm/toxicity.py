"""Toxicity from two class-conditional Kneser-Ney models over the letters of words."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.llm.common import per_batch, pieces
from newsweave.operators.joins import lookup_join
from newsweave.session import cut_lineage

ORDER = 5
DISCOUNT = 0.75
# Words in a passage; a document counts as toxic as its worst passage is.
PASSAGE = 5
# n-grams that may be broadcast, 12 bytes each; beyond it words are joined with them.
MOST_GRAMS = 4_000_000
# Labels that may be broadcast; beyond it they are joined by shuffling.
BROADCAST_LABELS = 2_000_000
_FOLDS = 5
# Bins of a passage's log-likelihood ratio, in which the threshold is fitted.
_BINS = 50
_WORD = re.compile(r"[^\W_]+")
_START, _END = "\x02", "\x03"
_SLICE_BYTES = 4 << 20
_FLUSH_WORDS = 200_000


def fold(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % _FOLDS if isinstance(doc_id, str) else doc_id


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter and end of each word: the hashes of its n-gram and of the
    n-gram's context, the word's number, and where it is in the letter codes."""
    pad = _START * (ORDER - 1)
    codes = np.frombuffer("".join(pad + w + _END for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(codes != ord(_START))
    wide = codes.astype(np.uint64)
    context = np.zeros(len(at), np.uint64)
    for back in range(ORDER - 1, 0, -1):
        context = (context ^ wide[at - back]) * np.uint64(0x9E3779B97F4A7C15)
        context ^= context >> np.uint64(29)
    gram = (context ^ wide[at]) * np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    return codes, at, np.stack([gram, context])


def _gram_rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
    words = list(counts)
    weights = np.array(list(counts.values()), np.int64)
    codes, at, hashes = _gram_codes(words)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    _, first, inverse = np.unique(hashes[0], return_index=True, return_inverse=True)
    sums = [np.bincount(inverse, weights[owner, c], len(first)).astype(np.int64) for c in (0, 1)]
    letters = np.stack([codes[at[first] - back] for back in range(ORDER - 1, -1, -1)], axis=1)
    text = letters.tobytes().decode("utf-32-le", "surrogatepass")
    grams = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(sums[0]), pa.array(sums[1])], ["gram", "ordinary", "toxic"])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, ordinary, toxic): how often each n-gram stands in texts (text, toxic)
    of either class, over every word of every row. Words are summed in each task first."""

    def run(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                for word, n in Counter(words_of(text.as_py() or "")).items():
                    held.setdefault(word, [0, 0])[toxic.as_py()] += n
                if len(held) >= _FLUSH_WORDS:
                    yield _gram_rows(held)
                    held = {}
        if held:
            yield _gram_rows(held)

    rows = labelled.select(F.col("text").cast("string"), F.col("toxic").cast("int")).mapInArrow(
        run, "gram string, ordinary long, toxic long")
    return rows.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _shared(counts: DataFrame) -> DataFrame:
    """(gram, p) of order ORDER - 1: Kneser-Ney from both classes together. Each
    lower order counts the distinct letters before an n-gram, not its uses."""
    levels, current = {}, counts.select("gram")
    for order in range(ORDER - 1, 0, -1):
        current = current.groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[order] = current
    total = levels[1].agg(F.sum("n").alias("total"))
    p = levels[1].crossJoin(F.broadcast(total)).select("gram", (F.col("n") / F.col("total")).alias("p"))
    for order in range(2, ORDER):
        same = Window.partitionBy(F.substring("gram", 1, order - 1))
        level = levels[order].select(
            "gram", "n", F.sum("n").over(same).alias("total"), F.count(F.lit(1)).over(same).alias("kinds"),
            F.substring("gram", 2, order - 1).alias("rest"))
        p = level.join(p.withColumnRenamed("gram", "rest"), "rest").select("gram", (
            (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("total")).alias("p"))
    return p


def ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Natural logs of toxic over ordinary probability: (gram, ratio) for n-grams
    seen in either class, and (context, ratio) for any other letter after a seen
    context, where the shared backoff cancels out. Unseen contexts have 0."""
    context = F.substring("gram", 1, ORDER - 1)
    same = Window.partitionBy("context")
    rows = counts.withColumn("context", context)
    for c in ("ordinary", "toxic"):
        rows = rows.withColumn(f"{c}_total", F.sum(c).over(same)).withColumn(
            f"{c}_kinds", F.sum((F.col(c) > 0).cast("int")).over(same))
    rows = rows.withColumn("rest", F.substring("gram", 2, ORDER - 1)).join(
        _shared(counts).withColumnRenamed("gram", "rest"), "rest")

    def probability(c: str) -> Column:
        seen = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{c}_kinds") * F.col("p")) / F.col(f"{c}_total")
        return F.when(F.col(f"{c}_total") > 0, seen).otherwise(F.col("p"))

    def weight(c: str) -> Column:
        return F.when(F.max(f"{c}_total") > 0, DISCOUNT * F.max(f"{c}_kinds") / F.max(f"{c}_total")).otherwise(1.0)

    grams = rows.select("gram", (F.col("ordinary") + F.col("toxic")).alias("n"), F.log(probability("toxic") / probability("ordinary")).alias("ratio"))
    contexts = rows.groupBy("context").agg(F.log(weight("toxic") / weight("ordinary")).alias("ratio"))
    return grams, contexts


class Model:
    """The two tables of ratios as sorted hashes and single-precision values."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray]):
        self.grams, self.contexts = grams, contexts

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(hashes), np.float32), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return values[at], keys[at] == hashes

    def of_words(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        if not words:
            return np.zeros(0)
        _, _, hashes = _gram_codes(words)
        kinds, inverse = np.unique(hashes[0], return_inverse=True)
        one = np.zeros(len(kinds), np.int64)
        one[inverse] = np.arange(len(inverse))
        value, known = self._find(self.grams, kinds)
        other, seen = self._find(self.contexts, hashes[1][one])
        each = np.where(known, value, np.where(seen, other, 0))[inverse]
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        return np.add.reduceat(each.astype(np.float64), np.concatenate(([0], np.cumsum(lengths)[:-1])))


def _sorted_table(hashes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    return hashes[order], values[order].astype(np.float32)


def fit(labelled: DataFrame) -> Model | tuple[DataFrame, DataFrame]:
    """The model of labelled texts (text, toxic), with every n-gram: up to MOST_GRAMS
    as tables in memory, beyond it as the tables of :func:`ratios`."""
    counts = cut_lineage(gram_counts(labelled))
    grams, contexts = (cut_lineage(x) for x in ratios(counts))
    if grams.count() > MOST_GRAMS:
        return grams, contexts
    kept, around = grams.select("gram", "ratio").toArrow(), contexts.select("context", "ratio").toArrow()

    def hashed(texts: list[str], place: int) -> np.ndarray:
        # A context is hashed as the start of an n-gram with any last letter.
        if not texts:
            return np.zeros(0, np.uint64)
        wide = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), -1).astype(np.uint64)
        context = np.zeros(len(texts), np.uint64)
        for i in range(ORDER - 1):
            context = (context ^ wide[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            context ^= context >> np.uint64(29)
        if place:
            return context
        gram = (context ^ wide[:, ORDER - 1]) * np.uint64(0xBF58476D1CE4E5B9)
        return gram ^ (gram >> np.uint64(32))

    tables = [_sorted_table(hashed(t.column(0).to_pylist(), i), t.column(1).to_numpy()) for i, t in enumerate((kept, around))]
    return Model(*tables)


def worst_passage(values: np.ndarray, lengths: np.ndarray) -> float:
    """The largest log-likelihood ratio per letter of any PASSAGE words in a row
    (all words, if fewer); 0 without words."""
    n = len(values)
    if not n:
        return 0.0
    size = min(PASSAGE, n)
    sums = np.concatenate(([0.0], np.cumsum(values)))
    letters = np.concatenate(([0], np.cumsum(lengths)))
    return float(((sums[size:] - sums[:-size]) / (letters[size:] - letters[:-size])).max())


def _numbered(text: str, numbers: dict[str, int]) -> np.ndarray:
    own = words_of(text)
    row = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own))
    # A word repeated over and over is no more evidence than the word.
    return row[np.concatenate(([True], row[1:] != row[:-1]))] if len(row) else row


def _word_values(words: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """(word, value) per distinct word: its log-likelihood ratio, as :class:`Model` has it."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), "word", F.lit(_END))
    at = words.select("word", padded.alias("padded"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("at"))
    at = at.select("word", "at", F.expr(f"substring(padded, at, {ORDER})").alias("gram"))
    found = lookup_join(at, grams.select("gram", F.col("ratio").cast("float").alias("seen")), "gram", "left")
    found = found.withColumn("context", F.substring("gram", 1, ORDER - 1))
    found = lookup_join(found, contexts.select("context", F.col("ratio").cast("float").alias("other")), "context", "left")
    each = F.coalesce("seen", "other", F.lit(0.0).cast("float"))
    lists = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", each.alias("ratio"))))["ratio"].alias("each"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [np.add.reduceat(np.array(x.as_py(), np.float64), [0])[0] for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["word", "value"])

    return per_batch(lists, run, "word string, value double")


def _joined_passages(docs: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """What :func:`passages` gives, with the model left in Spark: the distinct words
    are joined with its n-grams, the distinct words of each text with their values."""
    docs = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = cut_lineage(docs.groupBy("key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text")))

    def split(batches):
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                words = list(dict.fromkeys(words_of(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(words), pa.string()), pa.array(words, pa.string())], ["key", "word"])

    words = cut_lineage(texts.mapInArrow(split, "key string, word string"))
    values = cut_lineage(_word_values(words.select("word").distinct(), grams, contexts))
    own = lookup_join(words, values, "word").groupBy("key").agg(F.collect_list(F.struct("word", "value")).alias("own"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        worst = []
        for text, pairs in zip(batch.column(1), batch.column(2)):
            numbers: dict[str, int] = {}
            row = _numbered(text.as_py(), numbers)
            known = {p["word"]: p["value"] for p in pairs.as_py() or ()}
            lengths = np.fromiter((len(w) + 1 for w in numbers), np.int64, len(numbers))
            worst.append(worst_passage(np.array([known[w] for w in numbers], np.float64)[row], lengths[row]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(worst, pa.float64())], ["key", "worst"])

    found = per_batch(texts.join(own, "key", "left").select("key", "text", "own"), run, "key string, worst double")
    return lookup_join(docs.select("doc_id", "key"), cut_lineage(found), "key").select("doc_id", "worst")


def passages(docs: DataFrame, model: Model | tuple[DataFrame, DataFrame]) -> DataFrame:
    """(doc_id, worst) for every row of ``docs``, from its whole text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not isinstance(model, Model):
        return _joined_passages(docs, *model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", _SLICE_BYTES) if batch.num_rows else ():
                numbers: dict[str, int] = {}
                rows = [_numbered(text.as_py() or "", numbers) for text in part.column(1)]
                known = list(numbers)
                values = shared.value.of_words(known)
                lengths = np.fromiter((len(w) + 1 for w in known), np.int64, len(known))
                worst = [worst_passage(values[r], lengths[r]) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(worst, pa.float64())], ["doc_id", "worst"])

    return docs.mapInArrow(run, "doc_id long, worst double")


def logistic(bins: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Slope and intercept of P(toxic) from (value, ordinary, toxic) bins, by
    Newton's method with a weak pull to 0; both classes weigh the same. Without
    rows of both classes nothing is known, and slope 0 and intercept -1 say no."""
    x, n0, n1 = (np.array(c, float) for c in zip(*bins)) if bins else (np.zeros(0),) * 3
    if not bins or not n0.sum() or not n1.sum():
        return 0.0, -1.0
    n0, n1 = n0 / n0.sum(), n1 / n1.sum()
    w = np.zeros(2)
    rows = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        slope = rows.T @ (n1 * (1 - p) - n0 * p) - 1e-3 * w * np.array([1, 0])
        curve = (rows * ((n0 + n1) * p * (1 - p))[:, None]).T @ rows + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text).

    Rows of ``labels`` (doc_id, toxic) teach; those whose crc32(doc_id) leaves 0 by
    five never do. Remainders 1 to 3 give the two models, over all their words;
    remainder 4 places the threshold, so that texts the models have seen don't. The
    score sees the text only. A document labelled more than once is toxic if any
    row says so; null labels and labels of no document teach nothing. Null and
    empty texts hold no passage and score like a neutral one. held_out is null
    where doc_id is.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").alias("toxic")).withColumn("part", fold("doc_id")).where("part > 0")
    known = cut_lineage(known)
    small = known.count() <= BROADCAST_LABELS
    side = F.broadcast(known) if small else known
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    model = fit(texts.join(side.where("part < 4"), "doc_id").select("text", "toxic"))
    found = cut_lineage(passages(docs, model))
    judged = found.join(side.where("part = 4"), "doc_id").groupBy(
        F.floor(F.col("worst") * _BINS).alias("bin")).agg(
        F.sum(1 - F.col("toxic")).alias("ordinary"), F.sum("toxic").alias("toxic"))
    # A ratio is bounded by the logs of counts, so there are a few hundred bins.
    slope, shift = logistic([((r["bin"] + 0.5) / _BINS, r["ordinary"], r["toxic"]) for r in judged.collect()])
    score = 1 / (1 + F.exp(-F.greatest(F.least(F.col("worst") * slope + shift, F.lit(40.0)), F.lit(-40.0))))
    return found.select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more. Rows that repeat a doc_id
    go if any of them does; a row without doc_id stays."""
    gone = scored(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
