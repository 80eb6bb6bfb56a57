"""SimHash components, near copies, line dedup and the cuckoo filter."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsweave.llm import common, linededup, simhash
from newsweave.llm.common import connected_components
from newsweave.llm.cuckoo import CuckooFilter
from newsweave.session import new_folder

DOCS = "doc_id long, text string, fp long, component_id long, gone string, key string, n_lines string, set string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, "a", "b", "c", "d") for i, t in rows], DOCS)


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text, words=3):
    kept = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    shingles = [" ".join(kept[i : i + words]) for i in range(len(kept) - words + 1)] if len(kept) >= words else [" ".join(kept)] if kept else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_plain_rule(spark):
    generator = random.Random(3)
    texts = [None, "", " \t\n", "one", "One TWO", "a b c d", "É é x\x0by\x0cz", "w " * 5000, "ß x y z q"]
    texts += [" ".join(generator.choice("abcdeFGH") for _ in range(generator.randint(1, 30))) for _ in range(40)]
    found = simhash.fingerprints(docs(spark, enumerate(texts))).collect()
    assert {r.doc_id: r.fp % 2**64 for r in found} == {i: slow_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("distance", [1, 2])
def test_links_connect_what_comparing_all_pairs_connects(spark, distance):
    generator = random.Random(distance)
    values = {generator.getrandbits(64) for _ in range(60)}
    # A crowd around one value, a chain and the two ends of the range.
    centre = generator.getrandbits(64)
    for _ in range(80):
        values.add(centre ^ sum(1 << b for b in generator.sample(range(64), generator.randint(0, 5))))
    step = generator.getrandbits(64)
    for _ in range(20):
        step ^= 1 << generator.randrange(64)
        values.add(step)
    values |= {0, 1, 2**63, 2**64 - 1}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(frame, distance)
    rows = [(r.a, r.b) for r in edges.collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= distance for a, b in rows)
    wanted = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= distance]
    assert roots(rows, signed) == roots(wanted, signed)
    found = {r.node: r.root for r in connected_components(edges).collect()}
    expected = roots(wanted, signed)
    assert {n: found.get(n, n) for n in signed} == expected


def test_components_of_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away again"
    rows = [(9, base), (4, base.upper()), (7, ""), (3, None), (3, " "), (5, "something else entirely here"), (None, base), (8, base)]
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    by_id = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in found)
    assert by_id == [(-1, 4), (3, 3), (3, 3), (4, 4), (5, 5), (7, 3), (8, 4), (9, 4)]
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    alone = simhash.near_duplicates(docs(spark, [(None, "x y z")])).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


def near(generator, words, edits):
    words = list(words)
    for _ in range(edits):
        words[generator.randrange(len(words))] = f"new{generator.random()}"
    return " ".join(words)


def test_near_copies_equal_comparing_all_pairs(spark):
    generator = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [generator.choice(vocabulary) for _ in range(generator.randint(80, 300))]
        rows += [near(generator, base, e) for e in (0, 1, 1, 2, 3, 8)]
    crowd = [generator.choice(vocabulary) for _ in range(200)]
    rows += [near(generator, crowd, generator.randint(1, 3)) for _ in range(60)]
    rows += ["a b", "a b", "b a", "", "word " * 50, "word " * 70]
    numbered = list(enumerate(rows))
    generator.shuffle(numbered)
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, [*numbered, (None, rows[0])])).collect()}
    sets = {i: set(simhash.shingle_set(t.encode(), 5)) for i, t in numbered}
    alike = [(a, b) for a in sets for b in sets if a < b and (
        rows[a].split() == rows[b].split() or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)]
    assert found == roots(alike, sets)


def test_near_copies_of_ordinary_members_of_a_crowd(spark):
    generator = random.Random(8)
    template = [f"t{i}" for i in range(150)]
    # Many texts share a template and are no copies; each of some has one near copy.
    originals = [template + [f"own{generator.random()}" for _ in range(38)] for _ in range(1500)]
    copies = {i: near(generator, originals[i], 3) for i in range(0, 1500, 5)}
    rows = [(i, " ".join(x)) for i, x in enumerate(originals)] + [(10_000 + i, x) for i, x in copies.items()]
    sets = {i: set(simhash.shingle_set(x.encode(), 5)) for i, x in rows}
    wanted = [(i, 10_000 + i) for i in copies if len(sets[i] & sets[10_000 + i]) >= 0.8 * len(sets[i] | sets[10_000 + i])]
    assert len(wanted) > 200
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert found == roots(wanted, sets)


@pytest.mark.parametrize("case", ["added 5%", "added 10%", "added 15%", "added 23%", "cut", "moved", "edited"])
def test_near_copies_with_passages_changed(spark, case):
    generator = random.Random(case)
    vocabulary = [f"w{i}" for i in range(5000)]
    zipf = [1 / (i + 1) for i in range(5000)]
    draw = lambda n: generator.choices(vocabulary, zipf, k=n)
    rows = []
    for i in range(150):
        base = draw(generator.randint(100, 300))
        n, at = len(base), generator.randrange(len(base) * 2 // 3)
        if case.startswith("added"):
            other = base + draw(n * int(case[6:-1]) // 100)
        elif case == "cut":
            other = base[:at] + base[at + n // 7 :]
        elif case == "moved":
            other = base[:at] + base[at + n // 4 :] + base[at : at + n // 4]
        else:
            other = near(generator, base, max(1, n // 60)).split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    sets = {i: set(simhash.shingle_set(t.encode(), 5)) for i, t in rows}
    alike = [(i, i + 1) for i in range(0, 300, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(alike) > 50
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert found == roots(alike, sets)


def test_one_of_each_keeps_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2, text), (1, text), (1, text), (None, text), (5, "other words"), (6, None), (7, "")]
    kept = simhash.one_of_each(docs(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 1, 5, 6]
    assert simhash.one_of_each(docs(spark, [])).collect() == []


def test_one_of_each_goes_by_simhash_and_by_sets(spark):
    generator = random.Random(12)
    draw = lambda n: [f"w{generator.random()}" for _ in range(n)]
    rows, hashed, alike, number = [], [], [], 0
    key = lambda i, x: (i, " ".join(x))
    while len(hashed) < 3:
        # One passage over and over: the fingerprint follows it, the set of shingles the rest.
        passage = draw(4)
        one, two = passage * 40 + draw(8), passage * 40 + draw(8)
        prints = [simhash.fingerprint(" ".join(x).encode(), 3, 42) for x in (one, two)]
        sets = [set(simhash.shingle_set(" ".join(x).encode(), 5)) for x in (one, two)]
        if (prints[0] ^ prints[1]).bit_count() <= 2 and len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1]):
            rows += [key(number, one), key(number + 1, two)]
            hashed.append(number + 1)
            number += 2
    while len(alike) < 3:
        one = draw(150)
        two = one[:140]
        prints = [simhash.fingerprint(" ".join(x).encode(), 3, 42) for x in (one, two)]
        if (prints[0] ^ prints[1]).bit_count() > 2:
            rows += [key(number, one), key(number + 1, two)]
            alike.append(number + 1)
            number += 2
    # A chain of both kinds of links: its middle goes, and its end with it.
    chained = rows[1][1] + " " + " ".join(draw(1))
    rows.append((number, chained))
    kept = {r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect()}
    assert set(range(number + 1)) - kept == {*hashed, *alike, number}


def test_components_of_few_edges_need_one_shuffle(spark):
    generator = random.Random(3)
    edges = [(generator.randrange(400), generator.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 4), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(8)
    ends = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    found = connected_components(frame)
    assert {r.node: r.root for r in found.collect()} == roots([(a, b) for a, b in edges if a is not None], ends)
    assert "Exchange" not in found.select("node")._jdf.queryExecution().executedPlan().toString()


def slow_lines(rows, least=40, at_least=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < at_least or max(held[key(x)]) == i]
        out.append((i if i is not None else -1, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def line_rows():
    generator = random.Random(11)
    shared = [f"Line {n} that many of the documents share, É{n}" * (1 + n % 2) for n in range(12)] + ["short one", "é" * 39, "é" * 40]
    rows = []
    for i in range(40):
        lines = [generator.choice(shared) for _ in range(generator.randint(0, 8))]
        lines = [f" \t{x.upper()}\x0b" if generator.random() < 0.3 and x.isascii() else x for x in lines]
        rows.append((i, "\n".join(lines)))
    return [*rows, (None, shared[0]), (39, shared[1]), (50, None), (51, ""), (52, "\n\n"), (53, (shared[2] + "\n") * 3000)]


def test_line_dedup_equals_the_plain_rule(spark):
    rows = line_rows()
    found = linededup.deduplicated(docs(spark, rows)).select(
        F.coalesce("doc_id", F.lit(-1)), "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(tuple(r) for r in found) == slow_lines(rows)
    assert linededup.deduplicated(docs(spark, [])).collect() == []


def test_line_dedup_shuffles_no_text_unless_keys_are_many(spark, monkeypatch):
    rows = line_rows()
    found = linededup.deduplicated(docs(spark, rows))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(linededup, "EXACT_KEYS", 0)
    joined = linededup.deduplicated(docs(spark, rows))
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    for each in (found, joined):
        columns = each.select(F.coalesce("doc_id", F.lit(-1)), "n_lines", "n_dropped", F.sha2("text", 256))
        assert sorted(tuple(r) for r in columns.collect()) == slow_lines(rows)


def test_line_dedup_is_reversible_and_batches_repeat(spark):
    rows = [r for r in line_rows() if r[0] is not None]
    store = linededup.LineStore(spark, new_folder(spark, "lines"))
    store.insert(docs(spark, rows[:20]), "a")
    store.insert(docs(spark, rows[20:]), "b")
    store.insert(docs(spark, rows[20:]), "b")
    store.delete(docs(spark, [(i, "") for i in range(0, 40, 3)]), "c")
    left = [r for r in rows if r[0] >= 40 or r[0] % 3]
    fresh = linededup.LineStore(spark, new_folder(spark, "lines"))
    fresh.insert(docs(spark, left), "x")
    assert sorted(store.frequent().collect()) == sorted(fresh.frequent().collect())
    everything = linededup.without_lines(docs(spark, left), store.dropped(docs(spark, left)), 40)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in everything.collect()) == slow_lines(left)
    # What is in the filters now is exactly what the counts call frequent, or more.
    keys = np.array([r.k2 for r in store.frequent().collect()], np.int64).view(np.uint64)
    data = {r.shard: bytes(r.data) for r in store.filters().collect()}
    assert store.shards == 1 and CuckooFilter.from_bytes(data[0]).contains(keys).all()
    assert (CuckooFilter.from_bytes(data[0]).table > 0).sum() == len(keys)


def test_line_dedup_with_keys_sent_to_their_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    monkeypatch.setattr(linededup, "SHARD_ROWS", 7)
    rows = line_rows()
    found = linededup.deduplicated(docs(spark, rows)).select(F.coalesce("doc_id", F.lit(-1)), "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(tuple(r) for r in found) == slow_lines(rows)


def test_line_store_opens_again_and_grows_its_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 4)
    path = new_folder(spark, "lines")
    rows = [r for r in line_rows() if r[0] is not None]
    linededup.LineStore(spark, path).insert(docs(spark, rows[:6]), "a")
    again = linededup.LineStore(spark, path)
    few = again.shards
    again.insert(docs(spark, rows[6:]), "b")
    last = linededup.LineStore(spark, path)
    assert (last.version, last.shards) == (again.version, again.shards) and last.shards >= few
    everything = linededup.without_lines(docs(spark, rows), last.dropped(docs(spark, rows)), 40)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in everything.collect()) == slow_lines(rows)


def test_columns_with_the_names_used_inside(spark):
    rows = [(i, "a line that is long enough to be counted as one of many\nown") for i in range(6)]
    wide = docs(spark, rows).selectExpr("doc_id", "text", "1 as _gone_keys", "2 as _gone_id", "3 as n_lines")
    assert sorted(r.n_dropped for r in linededup.deduplicated(wide).collect()) == [0, 1, 1, 1, 1, 1]
    assert simhash.one_of_each(wide).count() == 1


def test_shards_agree_in_spark_and_numpy(spark):
    keys = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    frame = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k1 long")
    found = [(r.k1, r.shard) for r in linededup._with_shard(frame, 7).collect()]
    assert dict(found) == dict(zip(keys.view(np.int64).tolist(), linededup.shard_of(keys, 7).tolist()))


@pytest.mark.parametrize("count", [0, 1, 7, 5000])
def test_cuckoo_filter(count):
    keys = np.random.default_rng(count).integers(0, 2**63, count * 2).astype(np.uint64) * np.uint64(2)
    held, others = keys[:count], keys[count:]
    made = CuckooFilter.of(held)
    assert made.contains(held).all() and (made.table > 0).sum() == count
    assert made.contains(others).mean() < 0.01 if count > 1000 else True
    made.delete(held[::2])
    assert made.contains(held[1::2]).all() and (made.table > 0).sum() == count // 2
    again = CuckooFilter.from_bytes(made.to_bytes())
    assert again.insert(held[::2]) and again.contains(held).all()


def test_full_cuckoo_filter_says_so():
    made = CuckooFilter(np.zeros((2, 4), np.uint16))
    assert not made.insert(np.arange(1, 40, dtype=np.uint64) << np.uint64(48))


def test_few_edges_take_few_jobs_and_many_the_same_components(spark, monkeypatch):
    generator = random.Random(8)
    nodes = generator.sample(range(-500, 500), 300)
    pairs = [*zip(nodes[:100], nodes[1:100]), *((generator.choice(nodes[100:]), generator.choice(nodes[100:])) for _ in range(120)), (None, 1), (7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    spark.sparkContext.setJobGroup("few", "components")
    few = sorted(map(tuple, connected_components(edges).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(common, "FEW_EDGES", 0)
    assert few == sorted(map(tuple, connected_components(edges).collect()))
    assert dict(few)[nodes[50]] == min(nodes[:100]) and len(dict(few)) == len(few)
    # A chain of a hundred nodes took a few jobs in each of its rounds.
    assert jobs <= 8
    assert connected_components(edges.limit(0)).collect() == []


def test_texts_meet_once_and_only_if_their_sets_may_be_alike(spark):
    rows = [(low, low, 100, place, key) for low, keys in {1: "abc", 2: "abc", 3: "abd", 4: "ab"}.items() for place, key in enumerate(keys)]
    frame = spark.createDataFrame([(*r[:4], ord(r[4])) for r in rows], "low long, comp long, size int, place int, key long")
    odd = {1: [0, 0, 0, 0], 2: [0, 0, 0, (1 << 22) - 1], 3: [0, 0, -1, 0], 4: None}
    bits = spark.createDataFrame([*odd.items()], "low long, odd array<long>")
    found = sorted(tuple(r) for r in simhash._meetings(frame, bits, "alow < blow", 0.8).collect())
    # 200 shingles allow 22 that only one has; what is not known for an id with two texts is not asked.
    assert found == [(1, 2), *[(i, 4) for i in (1, 2, 3) for _ in "ab"]]


def test_unlike_texts_that_share_shingles_are_not_all_compared(spark, monkeypatch):
    generator = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = [base[:]]
    for i in range(60):
        text = base[:]
        for at in generator.sample(range(120), 6 if i % 2 else 1):
            text[at] = f"x{generator.randrange(3)}"
        texts.append(text)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [set(zip(*[t[j:] for j in range(5)])) for t in texts]
    links = [(a, b) for a in range(61) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, rows)).collect()}
    assert found == roots(links, range(61))
