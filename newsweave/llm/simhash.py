"""SimHash near-duplicates found through one-wildcard variants of two segments."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsweave.llm.common import connected_components, free_name, per_batch
from newsweave.session import cut_lineage, stored

# Two segments: of two differing bits, one segment holds at most one.
SEGMENT = 32
# Distinct fingerprints that share a variant are compared pair by pair up to here.
SMALL_GROUP = 16
# For near copies: bits of the SimHash, the most ids that are broadcast, bits of the
# table by which shingles are put in order, and how often crowds meet a head before
# those that are still apart meet each other, and in how many shingles these are seen
# to have met before. None of them changes what is found.
WIDE = 256
BROADCAST_IDS = 2_000_000
BROADCAST_CHANGES = 200_000
USAGE_BITS = 22
HEAD_ROUNDS = 3
FIRST_KEYS = 16
# Words whose hashes a task keeps from one text to the next.
KNOWN_WORDS = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """The SimHash of one text; 0 without words."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [joined[a:b] for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = counts * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) per row: fp is the 64-bit SimHash as a signed long. Texts are
    lower-cased in A-Z and cut at ASCII white space; a text with fewer words than
    a shingle is one shingle, and one without words (or null) has 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary())
        values = np.fromiter((fingerprint(t.as_py() or b"", words, seed) for t in texts), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _masked(fp: Column, place: Column) -> Column:
    """The variant of ``fp`` at ``place``: the segment it lies in without that bit."""
    low = fp.bitwiseAND(F.lit((1 << SEGMENT) - 1))
    segment = F.when(place < SEGMENT, low).otherwise(F.shiftrightunsigned(fp, SEGMENT))
    return segment.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, place % {SEGMENT})")))


def _first_shared(a: Column, b: Column) -> Column:
    """The lowest place at which both fingerprints have the same variant."""
    return F.expr(
        f"case when (({a} ^ {b}) & {(1 << SEGMENT) - 1}L) = 0 then 0 "
        f"when bit_count(({a} ^ {b}) & {(1 << SEGMENT) - 1}L) = 1 "
        f"then cast(round(log2(cast(({a} ^ {b}) & {(1 << SEGMENT) - 1}L as double))) as int) "
        f"when shiftrightunsigned({a} ^ {b}, {SEGMENT}) = 0 then {SEGMENT} "
        f"else {SEGMENT} + cast(round(log2(cast(shiftrightunsigned({a} ^ {b}, {SEGMENT}) as double))) as int) end")


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) that connect every two values of ``distinct`` (fp) with at
    most ``distance`` (1 or 2) differing bits, directly or through others linked alike.

    Each value stands in the index 64 times, once per bit left out of its segment.
    Values with an equal variant are joined and verified; a pair is taken at the
    first variant it shares. Where more than SMALL_GROUP values share a variant,
    pairs would grow with the square, so those values are linked another exact
    way: two values differ in at most two bits if and only if they have a value in
    common among themselves and their 64 one-bit changes, and in at most one bit if
    they are equal without one and the same bit. All that meet are tied to the
    smallest.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    placed = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT - 1))).alias("place"))
    keyed = placed.select("fp", F.expr("shiftleft(cast(place as long), 32)").bitwiseOR(
        _masked(F.col("fp"), F.col("place"))).alias("key"))
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    sized = cut_lineage(sized)
    small = sized.where(F.col("n") <= SMALL_GROUP)
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where(
        (F.col("a") < F.col("b")) & (F.expr("bit_count(a ^ b)") <= distance)
        & (F.shiftright("key", 32) == _first_shared("a", "b"))).select("a", "b")
    crowded = sized.where(F.col("n") > SMALL_GROUP).select("fp").distinct()
    changed = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit"))
    if distance == 2:
        meeting = changed.select("fp", F.lit(0).alias("bit"), F.expr("case when bit < 0 then fp else fp ^ shiftleft(1L, bit) end").alias("point"))
    else:
        meeting = changed.where("bit >= 0").select("fp", "bit", F.expr("fp & ~shiftleft(1L, bit)").alias("point"))
    tied = meeting.withColumn("low", F.min("fp").over(Window.partitionBy("bit", "point"))).where("fp > low")
    return pairs.unionByName(tied.select(F.col("low").alias("a"), F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own
    included. Rows of one doc_id stay, each with its own text's fingerprint; a null
    doc_id never names a component unless it holds nothing else (then null). Empty
    and null texts have fingerprint 0 and link like any other. Equal fingerprints
    are one value in the index, so copies cost one row each.
    """
    prints = cut_lineage(fingerprints(docs, words, seed))
    values = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    components = connected_components(links(values.select("fp"), distance))
    rooted = values.join(components.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def sketch(text: bytes) -> tuple[bytes, list[int]]:
    """What stands for a text when near copies are sought: 128 bits of its word
    sequence and a SimHash of WIDE bits over its distinct words."""
    tokens = text.translate(_LOWER).split()
    exact = xxhash.xxh3_128_digest(b" ".join(tokens))
    kinds = list(set(tokens))
    if not kinds:
        return exact, [0] * (WIDE // 64)
    digest = xxhash.xxh3_128_digest
    data = b"".join([digest(w, 1) + digest(w, 2) for w in kinds])
    bits = np.frombuffer(data, np.uint8).reshape(len(kinds), -1)
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(kinds), 1 << 14):
        counts += np.unpackbits(bits[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return exact, np.packbits(counts * 2 > len(kinds), bitorder="little").view(np.int64).tolist()


def _shingles(tokens: list[bytes], words: int) -> list[bytes]:
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    return [b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles."""
    tokens = text.translate(_LOWER).split()
    hashes = {xxhash.xxh64_intdigest(x, 42) for x in _shingles(tokens, words)}
    return np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, e1, e2, wide) per row that has a doc_id."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [sketch(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
        exact = np.frombuffer(b"".join(r[0] for r in rows), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(exact[:, 0]), pa.array(exact[:, 1]), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
            ["doc_id", "e1", "e2", "wide"])

    return per_batch(docs, run, "doc_id long, e1 long, e2 long, wide array<long>", "text")


def _rolled(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text, rolled from the
    hashes of its words."""
    known: dict[bytes, int] = {}
    for text in texts.cast(pa.binary()):
        tokens = (text.as_py() or b"").translate(_LOWER).split()
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(tokens):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 7)
        own = np.fromiter((known[w] for w in tokens), np.uint64, len(tokens))
        count = max(len(own) - words + 1, min(len(own), 1))
        rolled = np.zeros(count, np.uint64)
        for i in range(min(words, len(own))):
            rolled = (rolled ^ own[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
            rolled ^= rolled >> np.uint64(29)
        yield np.unique(rolled)


def _usage(texts: DataFrame, words: int) -> np.ndarray:
    """How many texts use the shingles of each of 2 ** USAGE_BITS buckets. It only
    orders shingles: those that share a bucket count as common as both are."""
    blocks = 1 << (USAGE_BITS - 12)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << USAGE_BITS, np.uint32)
        for batch in batches:
            for hashes in _rolled(batch.column(1), words):
                np.add.at(held, (hashes & np.uint64(len(held) - 1)).astype(np.int64), 1)
        if held.any():
            # Packed, as a task sees few of the buckets, and most of these once.
            parts = [zlib.compress(x.tobytes(), 1) for x in held.reshape(blocks, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    total = np.zeros((blocks, 1 << 12), np.uint32)
    for row in texts.mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toArrow().to_pylist():
        total[row["block"]] = np.frombuffer(row["counts"], np.uint32)
    return total.reshape(-1)


def _prefixes(texts: DataFrame, usage: Broadcast, words: int, similarity: float) -> DataFrame:
    """(low, comp, size, place, key, odd) for the rarest shingles of each text of
    ``texts`` (low, text, comp): so many that two texts which are similar enough
    have one of them in common. place is the shingle's place in the order. odd, on the
    first row of a text, are WIDE bits: which of so many shares of its shingles are odd."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, places, owners, sizes, odd = [], [], [], [], []
        for row, hashes in enumerate(_rolled(batch.column(1), words)):
            most = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
            common = usage.value[(hashes & np.uint64(len(usage.value) - 1)).astype(np.int64)]
            keys.append(hashes[np.argsort(common, kind="stable")[:most]])
            places.append(np.arange(most))
            owners.append(np.full(most, row))
            sizes.append(np.full(most, len(hashes)))
            share = (hashes >> np.uint64(40)).astype(np.int64) % WIDE
            bits = np.packbits(np.bincount(share, minlength=WIDE).astype(np.uint8) & 1, bitorder="little").view(np.int64).tolist()
            odd += [bits, *[None] * (most - 1)] if most else []
        owner = pa.array(np.concatenate(owners))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(owner), batch.column(2).take(owner), pa.array(np.concatenate(sizes), pa.int32()),
             pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(keys).view(np.int64)), pa.array(odd, pa.list_(pa.int64()))],
            ["low", "comp", "size", "place", "key", "odd"])

    return per_batch(texts, run, "low long, comp long, size int, place int, key long, odd array<long>", "text")


def _alike(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose whole shingle sets are similar."""
    pairs = stored(pairs)
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.as_py() or b"", words) for t in batch.column(1).cast(pa.binary())]
        ends = np.cumsum([0, *map(len, sets)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "set"])

    # Rows that repeat an id are one document, whose words are those of any of them.
    texts = docs.join(side, "doc_id").dropDuplicates(["doc_id"])
    sets = stored(per_batch(texts, run, "doc_id long, set array<long>", "text"))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return stored(both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that ``roots`` (node, root) does not put into one component."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    return pairs.where("ra is null or rb is null or ra <> rb").select("a", "b")


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (low, ...) with comp, the component of low over ``edges``."""
    components = connected_components(edges).select(F.col("node").alias("low"), "root")
    return rows.drop("comp").join(components, "low", "left").withColumn("comp", F.coalesce("root", "low")).drop("root")


def _moved(rows: DataFrame, more: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (low, comp, ...) with comp after the links ``more`` were added, which are
    among ``edges``. Few components change, so the changes are looked up where the
    rows are; where they are many, the rows are joined with all components."""
    # A link joins the components its two ends are in now.
    ends = more.select(F.explode(F.array("a", "b")).alias("low")).distinct()
    now = stored(rows.select("low", "comp").distinct().join(ends, "low"))
    comps = now.select("low", "comp")
    joined = more.join(comps.withColumnsRenamed({"low": "a", "comp": "ca"}), "a").join(comps.withColumnsRenamed({"low": "b", "comp": "cb"}), "b")
    complete = joined.count() == more.count()
    changed = connected_components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).where("node <> root")
    changed = stored(changed)
    if not complete or changed.count() > BROADCAST_CHANGES:
        return _rooted(rows, edges)
    table = changed.toArrow()
    order = np.argsort(table.column("node").to_numpy(), kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast(
        (table.column("node").to_numpy()[order], table.column("root").to_numpy()[order]))
    place, names = rows.columns.index("comp"), rows.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, root = shared.value
        own = batch.column(place).to_numpy()
        at = np.minimum(np.searchsorted(node, own), max(len(node) - 1, 0))
        columns = list(batch.columns)
        if len(node):
            columns[place] = pa.array(np.where(node[at] == own, root[at], own))
        return pa.RecordBatch.from_arrays(columns, names)

    return per_batch(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, n, head) per key that texts of several components share: how many
    rows, and one of them, the same in every run."""
    return rows.groupBy("key").agg(
        F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.xxhash64("low", "comp").alias("by"), "low", "comp", "size", "place")).alias("head"),
    ).where("least <> most").select("key", "n", "head")


def _meetings(rows: DataFrame, odd: DataFrame, possible: str, similarity: float) -> DataFrame:
    """(a, b) for texts of different components with a shingle in common, where
    ``possible`` holds for their rows (a..., b...). Two texts do not meet again in a
    shingle if they have met in one of the first FIRST_KEYS of both; and as every bit in
    which their ``odd`` (low, odd) differ is a shingle that only one of them has, those
    that differ in too many are left out. An id with several texts, whose odd is null,
    meets each time."""
    rows = rows.join(_mixed(rows).select("key"), "key", "left_semi")
    firsts = rows.groupBy("low").agg(F.expr(f"slice(array_sort(collect_list(struct(place, key))), 1, {FIRST_KEYS})").alias("firsts"))
    met = "if(odd is null, array(), transform(filter(firsts, x -> x.place < place), x -> x.key))"
    rows = stored(rows.join(firsts, "low").join(odd, "low").withColumn("met", F.expr(met).cast("array<long>")).drop("firsts"))
    names = ("low", "comp", "size", "place", "met", "odd")
    left, right = (rows.select("key", *[F.col(c).alias(f"{side}{c}") for c in names]) for side in "ab")
    differ = " + ".join(f"bit_count(aodd[{i}] ^ bodd[{i}])" for i in range(WIDE // 64))
    few = f"coalesce({differ} <= {(1 - similarity) / (1 + similarity)!r} * (asize + bsize) + 1e-6, true)"
    return left.join(right, "key").where(f"{possible} and {few} and not arrays_overlap(amet, bmet)").select(
        F.col("alow").alias("a"), F.col("blow").alias("b"))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) per row of ``docs`` (doc_id, text) that has a doc_id:
    component_id is the smallest doc_id reachable over texts whose sets of
    ``words``-word shingles have a Jaccard similarity of ``similarity`` or more, and over
    ``links`` (a, b) between doc_ids that are known already, which are not compared.

    Every such link counts; none is left to chance. Equal word sequences are one
    entry. Equal segments of a wide SimHash tie most members of a large group of
    copies to a head first, so that the group need not be compared in pairs. What
    that leaves is found by a prefix filter: with shingles in one order, the rarest
    first, two similar texts have one in common among the first 1 - ``similarity``
    of each. Texts of different components that share one are compared by their
    whole sets, in crowded shingles with one head first, which joins components,
    and then all that are still apart. Texts without words are copies of each other.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(_sketches(docs))
    kinds = stored(rows.groupBy("e1", "e2").agg(F.min("doc_id").alias("low"), F.min_by("wide", "doc_id").alias("wide")))
    segments = kinds.select("low", F.posexplode(F.expr(
        "flatten(transform(wide, x -> array(x & 4294967295L, shiftrightunsigned(x, 32))))")).alias("place", "segment"))
    heads = segments.groupBy("place", "segment").agg(F.min("low").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = segments.join(heads, ["place", "segment"]).where("low > a").select("a", F.col("low").alias("b")).distinct()
    if links is not None:
        links = links.select(F.col("a").cast("long"), F.col("b").cast("long"))
        roots = stored(connected_components(links))
        tied = _apart(tied, roots)
    edges = _alike(docs, tied, words, similarity)
    if links is not None:
        edges = edges.unionByName(links)
    known = stored(_rooted(kinds.select("low").distinct(), edges))
    side = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    texts = docs.join(side, docs["doc_id"] == side["low"]).select("low", "text", "comp")
    usage = docs.sparkSession.sparkContext.broadcast(_usage(docs, words))
    prefixes = stored(_prefixes(texts, usage, words, similarity))
    odd = prefixes.where("place = 0").groupBy("low").agg(F.expr("if(count(*) = 1, first(odd), null)").alias("odd"))
    prefixes = prefixes.drop("odd")
    open_rows = stored(prefixes.join(_mixed(prefixes).select("key"), "key", "left_semi"))
    least = similarity / (1 + similarity)

    def possible(a: str, b: str) -> str:
        # What two texts may share from their first common shingle on.
        return (f"{a}comp <> {b}comp and least({a}size - {a}place, {b}size - {b}place) >= "
                f"{least!r} * ({a}size + {b}size) - 1e-6 and least({a}size, {b}size) >= {similarity!r} * greatest({a}size, {b}size) - 1e-6")

    # Only rows of crowded shingles take part in the rounds; the others follow at their end.
    crowds, found = None, None
    for _ in range(HEAD_ROUNDS):
        crowded = stored(_mixed(open_rows if crowds is None else crowds).where(F.col("n") > SMALL_GROUP))
        if crowded.isEmpty():
            break
        crowds = stored((open_rows if crowds is None else crowds).join(crowded.select("key"), "key", "left_semi"))
        pairs = crowds.join(crowded, "key").where(possible("", "head.")).select(
            F.least("low", "head.low").alias("a"), F.greatest("low", "head.low").alias("b")).distinct()
        more = _alike(docs, pairs, words, similarity)
        if more.isEmpty():
            break
        edges = edges.unionByName(more)
        found = more if found is None else found.unionByName(more)
        crowds = stored(_moved(crowds, more, edges))
    if found is not None:
        open_rows = stored(_moved(open_rows, found, edges))
    apart = _meetings(open_rows, odd, f"alow < blow and {possible('a', 'b')}", similarity).distinct()
    known = _rooted(kinds.select("e1", "e2", "low"), edges.unionByName(_alike(docs, apart, words, similarity)))
    return rows.join(known, ["e1", "e2"]).select("doc_id", F.col("comp").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group of near duplicates,
    that with the smallest doc_id. Rows that repeat a doc_id stay or go together; a
    row without doc_id stays.

    The groups are those of :func:`near_duplicates`, SimHashes that differ in few bits,
    joined by the links between similar texts that a SimHash misses (:func:`near_copies`).
    """
    known = docs.where("doc_id is not null").select("doc_id", "text")
    prints = stored(near_duplicates(known).where("doc_id <> component_id").select(
        F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct())
    found = near_copies(known, words, similarity, prints)
    name = free_name(docs, "_gone_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def hexadecimal(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
