"""Decontamination, SentencePiece, toxicity, personal data, token counts and secrets."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import time
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsweave.llm import decontamination, personal, secrets, sentencepieces, tokencounts, toxicity
from newsweave.llm.queries import TOKENIZERS
from newsweave.session import new_folder

DOCS = ("doc_id long, text string, lang string, source string, base string, item_id string, score string, "
        "predicted string, candidates string, piece_ids string, decoded string, tokens string")
ODD = [(100, None), (101, ""), (102, " \n\t"), (None, "a row without id"), (103, "\x00   é ﬁ 日本 😀"), (103, "again")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", *"abcdefgh") for i, t in rows], DOCS)


# Decontamination.

def slow_overlaps(docs_rows, items):
    found = set()
    for i, t in docs_rows:
        words = decontamination.words_of(t or "")
        for j, b in items:
            item = decontamination.words_of(b or "")
            size = min(13, len(item)) if len(item) >= decontamination.MIN_WORDS else 0
            for p in range(len(words) - size + 1 if size else 0):
                for q in range(len(item) - size + 1):
                    equal = sum(a == b for a, b in zip(words[p : p + size], item[q : q + size]))
                    if equal >= math.ceil(0.8 * size):
                        found.add((i, j))
    return found


def test_overlaps_equal_comparing_every_window(spark):
    generator = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(j, " ".join(generator.choice(vocabulary) for _ in range(n))) for j, n in enumerate([30, 13, 14, 40, 6, 1, 20, 12])]
    items += [(90, None), (91, " ,. "), (92, items[0][1].upper() + "!"), (None, items[3][1])]
    rows = list(ODD)
    for i in range(60):
        words = [generator.choice(vocabulary) for _ in range(generator.randint(0, 60))]
        if i % 3 == 0:
            piece = generator.choice(items[:8])[1].split()
            for _ in range(generator.randint(0, 4)):
                piece[generator.randrange(len(piece))] = "changed"
            at = generator.randint(0, len(words))
            words[at:at] = piece[generator.randint(0, 2):]
        rows.append((i, ", ".join(words)))
    bench = spark.createDataFrame([(j, b, 1) for j, b in items], "item_id long, text string, doc_id int")
    found = decontamination.overlaps(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == slow_overlaps(rows, items)
    kept = {r.doc_id for r in decontamination.decontaminated(docs(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - ({d for d, _ in slow_overlaps(rows, items)} - {None})
    none = bench.limit(0)
    assert decontamination.overlaps(docs(spark, rows), none).collect() == []
    assert decontamination.overlaps(docs(spark, []), bench).collect() == []


@pytest.mark.parametrize("n", range(6, 13))
def test_short_masks_meet_every_choice_of_substitutions(n):
    gone = n - math.ceil(0.8 * n)
    for places in itertools.combinations(range(n), gone):
        assert any(not set(mask) & set(places) for mask in decontamination.short_masks(n))


def test_an_everyday_word_is_no_benchmark_item(spark):
    bench = spark.createDataFrame([(1, "the"), (2, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows = [(1, "the cat"), (2, "so one two three four changed six seven eight nine ten it is"), (3, "one two three four five")]
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs(spark, rows), bench).collect()} == {(2, 2)}


def test_a_very_long_text_is_searched_whole(spark):
    item = " ".join(f"k{i}" for i in range(20))
    rows = [(1, "w " * 500_000 + item), (2, "x" * 1_000_000)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.doc_start) for r in decontamination.overlaps(docs(spark, rows), bench).collect()] == [(1, 500_000)]


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    items = [(j, " ".join(f"x{j}y{k}" for k in range(15 + j))) for j in range(9)]
    rows = [(j, f"before it {b} after it") for j, b in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontamination.overlaps(docs(spark, rows), bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 40)
    assert sorted(decontamination.overlaps(docs(spark, rows), bench).collect()) == whole
    assert [tuple(r)[2:] for r in whole] == [(2, 17 + j, 15 + j, 15 + j) for j in range(9)]


def test_one_mask_meets_every_window_with_two_substitutions():
    mask = decontamination.MASKS[0]
    for a in range(13):
        for b in range(a, 13):
            assert any(not {a - s, b - s} & set(mask) for s in range(13 - mask[-1]))


# SentencePiece.

@pytest.fixture(scope="module")
def model():
    return sentencepieces.model_bytes(f"{TOKENIZERS}/piece_bpe_32k.model")


TEXTS = ["a  b", " a", "a ", "\n", "\t\n x", "é é ﬁ ①", "😀" * 3, "x" * 5000, "abcdefgh" * 200, "ing" * 60, "日本語 " * 40, "▁a ▁",
         "Hello, world!", "a\x00b", "the " * 3000]


def test_ids_equal_the_library(spark, folder, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    rows = [*enumerate(texts), (None, "no id"), (500, None), (501, "")]
    encoded = sentencepieces.encode(docs(spark, rows), model)
    found = sentencepieces.decode(encoded, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.piece_ids == library.encode(r.text or "")
        assert r.decoded == library.decode(r.piece_ids)
    assert sentencepieces.encode(docs(spark, []), model).collect() == []


def test_suffix_array_finds_every_piece(model):
    matcher = sentencepieces.Matcher(sentencepieces.Vocabulary.parse(model))
    text = "▁the▁theory▁of▁everything\0" + "\0" * 20
    codes = matcher.numbers(text)
    at, piece = matcher.edges(codes, np.arange(26))
    found = {(int(a) // 32, matcher.vocabulary.pieces[p]) for a, p in zip(at, piece)}
    known = set(matcher.vocabulary.pieces)
    assert found == {(i, text[i : i + n]) for i in range(25) for n in range(1, 17) if text[i : i + n] in known}
    assert (np.diff(at) >= 0).all()


def test_chunks_that_are_met_often_are_encoded_once(model, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepieces, "_KEPT_CHUNKS", 6)
    monkeypatch.setattr(sentencepieces, "_SLICE_BYTES", 1)
    encoded, original = [], sentencepieces.Matcher.encode
    monkeypatch.setattr(sentencepieces.Matcher, "encode", lambda self, chunks: encoded.extend(chunks) or original(self, chunks))
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    given = SimpleNamespace(columns=["doc_id", "text"], schema=[], sparkSession=SimpleNamespace(sparkContext=context))
    given.drop, given.mapInArrow = lambda name: given, lambda run, schema: run
    texts = [f"the cat number{i} sat{i} the" for i in range(40)] + TEXTS
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = [ids for part in sentencepieces.encode(given, model)(iter([batch])) for ids in part.column(2).to_pylist()]
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert found == [library.encode(t) for t in texts]
    # Chunks that come once make room for others; one that comes in every text stays.
    assert encoded.count("▁cat") == 1 and encoded.count("▁the") <= 2


# Toxicity.

def toxic_corpus(generator, count=600):
    bad, good = ["grobble", "snarkit", "vilezip", "muckdor"], [f"{a}{b}{c}" for a in ("be", "lo", "ta", "ri") for b in ("na", "mi", "so", "lu") for c in ("r", "n", "st")]
    rows, labels = [], []
    for i in range(count):
        words = [generator.choice(good) for _ in range(generator.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(generator.randint(0, len(words)), generator.choice(bad))
            words.insert(generator.randint(0, len(words)), generator.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_toxicity(spark):
    rows, labels = toxic_corpus(random.Random(4))
    side = spark.createDataFrame([*labels, (None, 1), (7000, None), (7001, 1), (4, 1)], "doc_id long, toxic int")
    found = toxicity.scored(docs(spark, rows + ODD), side).collect()
    assert len(found) == len(rows) + len(ODD)
    truth = dict(labels)
    for r in found:
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    judged = [r for r in found if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in judged)
    assert len(judged) > 80 and right / len(judged) > 0.97
    assert all(r.predicted == 0 for r in found if r.doc_id is not None and 100 <= r.doc_id <= 102 and r.doc_id not in truth)
    kept = toxicity.without_toxic(docs(spark, rows + ODD), side)
    assert "_gone_id" not in kept.columns
    assert {None} | {i for i, t in labels if not t and zlib.crc32(str(i).encode()) % 5} <= {r.doc_id for r in kept.collect()}


def test_scores_do_not_depend_on_how_many_grams_may_be_broadcast(spark, monkeypatch):
    rows, labels = toxic_corpus(random.Random(6))
    side = spark.createDataFrame(labels, "doc_id long, toxic int")
    given = docs(spark, rows + ODD)
    scores = lambda: sorted((r.doc_id or -1, r.score) for r in toxicity.scored(given, side).collect())
    broadcast = scores()
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 50)
    assert scores() == broadcast


def test_nothing_learned_rejects_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.scored(docs(spark, ODD), empty).collect()} == {0}
    assert toxicity.scored(docs(spark, []), empty).collect() == []
    one = spark.createDataFrame([(103, 1), (101, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.scored(docs(spark, ODD), one).collect()} == {0}


def test_ratios_are_those_of_two_distributions(spark):
    texts = [("aab abb", 0), ("abc abc b", 1), ("a", 0), ("cab", 1)]
    labelled = spark.createDataFrame(texts, "text string, toxic int")
    counts = toxicity.gram_counts(labelled)
    plain = {}
    for text, toxic in texts:
        for word in text.split():
            padded = "\x02" * 4 + word + "\x03"
            for i in range(4, len(padded)):
                plain.setdefault(padded[i - 4 : i + 1], [0, 0])[toxic] += 1
    assert {r.gram: [r.ordinary, r.toxic] for r in counts.collect()} == plain
    # Over all letters that may follow a context, each class sums to one.
    shared = {r.gram: r.p for r in toxicity._shared(counts).collect()}
    assert all(0 < p <= 1 for p in shared.values())
    starts = [p for g, p in shared.items() if g.startswith("\x02\x02\x02")]
    assert math.isclose(sum(starts), 1, rel_tol=0.3)


# Personal data.

DISGUISED = [
    ("write to john.doe [at] mail [dot] example [dot] com now", "email", "john.doe [at] mail [dot] example [dot] com"),
    ("jane(at)example.org", "email", "jane(at)example.org"), ("see bob at example dot com ok", "email", "bob at example dot com"),
    ("ｊｏｈｎ＠example．com", "email", "ｊｏｈｎ＠example．com"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("plus one two one two five five five zero one two three", "phone", "plus one two one two five five five zero one two three"),
    ("4１11 1111 1111 1111", "card", "4１11 1111 1111 1111"), ("eins neun zwei punkt eins punkt zwei punkt drei", "ip", "eins neun zwei punkt eins punkt zwei punkt drei"),
    ("x john​.doe@example.com", "email", "john​.doe@example.com"),
]
CLEAN = ["look at example.com", "one of us, two of them", "he was at home (at last)", "un deux trois", "at the dot", "éèê naïve", "Привет мир"]


def plain_spans(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(map(int, str(2 * x))) for i, x in enumerate(reversed(d))) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in email.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in card.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def test_personal_data_equals_the_plain_rule(spark):
    generator = random.Random(9)
    parts = ["a@b.c", "x.y+z@mail-1.ex.org", "@", "a@b", "1.2.3.4", "300.1.1.1", "10.0.0.1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (415) 555-0100", "+12", "é", " ", ".", "-", "1", "00000000000000", "user@@host.com", "\n"]
    rows = [(i, "".join(generator.choice(parts) + generator.choice(["", " "]) for _ in range(generator.randint(0, 14)))) for i in range(300)]
    rows += [*ODD, (900, "9" * 20000), (901, "a" * 20000 + "@"), (902, "1." * 9000)]
    found = personal.report(personal.scan(docs(spark, rows)))
    wanted = []
    for i, t in rows:
        spans = plain_spans(t or "")
        text = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        wanted.append((-1 if i is None else i, *[sum(k == n for _, k, _ in spans) for n in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert sorted(tuple(r) for r in found.select(F.coalesce("doc_id", F.lit(-1)), *names).collect()) == sorted(wanted)
    assert personal.scan(docs(spark, [])).collect() == []


@pytest.mark.parametrize("text,kind,shown", DISGUISED)
def test_disguises_come_with_source_spans(text, kind, shown):
    assert [(personal.KINDS[k], text[s:e]) for s, k, e in personal.revealed(text)] == [(kind, shown)]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay_clean(text):
    assert personal.revealed(text) == [] and personal.spans_of(text) == []


# Token counts.

@pytest.mark.parametrize("text, kind, shown", [
    ("write to name[@]host[.]com now", 0, "name[@]host[.]com"), ("mail joe@host dot com", 0, "joe@host dot com"),
    ("joe(.)x (at) a.b.c dot d", 0, "joe(.)x (at) a.b.c dot d"), ("ip 192[.]168[.]0[.]1 is", 1, "192[.]168[.]0[.]1"),
    ("on 10 dot 0 dot 0 dot 1.", 1, "10 dot 0 dot 0 dot 1"),
])
def test_signs_in_brackets_and_points_between_digits(text, kind, shown):
    assert [(k, text[s:e]) for s, k, e in personal.revealed(text)] == [(kind, shown)]


@pytest.mark.parametrize("unit", ["a (dot) ", "a at b dot ", "at b dot c at ", "@", "1 dot ", "[at]", "one ", " ", "+1(", "a"])
def test_two_megabytes_of_signs_take_linear_time(unit):
    text = unit * (2_000_000 // len(unit))
    start = time.process_time()
    personal.spans_of(text)
    personal.revealed(text)
    assert time.process_time() - start < 60


def test_token_rollup_follows_inserts_revisions_and_deletes(spark):
    import tiktoken

    versions = {v: tokencounts.rank_bytes(f"{TOKENIZERS}/{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, text string, tokens string")
    first = [(1, "a", "en", "hello there"), (2, "a", None, "bonjour"), (3, None, "de", ""), (4, "b", "en", None), (None, "b", "en", "no id"), (None, "b", "en", "no id")]
    second = [(1, "b", "en", "hello again and again"), (5, "a", "en", "new one"), (5, "a", "en", "new one"), (None, "b", "en", "no id")]
    rollup = tokencounts.TokenRollup(spark, new_folder(spark, "tokens"))
    assert rollup.totals().collect() == []
    rollup.apply("one", frame(first), versions)
    once = sorted(map(str, rollup.totals().collect()))
    rollup.apply("one", frame(first), versions)
    assert sorted(map(str, rollup.totals().collect())) == once
    rollup.apply("two", frame(second), versions, deleted=spark.createDataFrame([(2,), (99,)], "doc_id long"))
    rollup.apply("two", frame(second), versions)
    rollup.apply("three", None, versions, deleted=spark.createDataFrame([(3,)], "doc_id long"))
    rollup.apply("four", frame([]), versions)
    left = [first[3], *first[4:], second[0], second[1], second[3]]
    wanted = {}
    for version, data in versions.items():
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        encoder = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for _, source, lang, text in left:
            sums = wanted.setdefault((source, lang, version), [0, 0, 0])
            for at, more in enumerate((1, len(encoder.encode_ordinary(text or "")), len(text or ""))):
                sums[at] += more
    assert {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens, r.chars] for r in rollup.totals().collect()} == wanted


def test_a_batch_that_broke_off_is_not_counted(spark):
    versions = {"byte_bpe_50k": tokencounts.rank_bytes(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")}
    path = new_folder(spark, "tokens")
    rollup = tokencounts.TokenRollup(spark, path)
    rollup.apply("one", docs(spark, [(1, "a b c")]), versions)
    row = rollup.totals().first()
    docs(spark, []).select(F.lit("s").alias("source")).write.parquet(f"{path}/totals/two")
    assert rollup.totals().first() == row and rollup.committed() == ["one"]
    rollup.apply("two", docs(spark, [(2, "a b c")]), versions)
    assert rollup.totals().first().docs == 2


# Secrets.

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secret_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets_equal_the_plain_rule(spark):
    generator = random.Random(12)
    parts = ["password=", "Token : ", "api_key\"='", "APIKEY:", "secret", "abcdefghijkl", "short", "AKIA", "AKIAABCDEFGHIJ1234", "0123456789abcdef",
             "deadbeef", " ", "é", "\n", "=", "😀", "password: secret: abcdefghijklmnop"]
    rows = [(i, "".join(generator.choice(parts) + generator.choice(["", " "]) for _ in range(generator.randint(0, 16)))) for i in range(300)]
    rows += [*ODD, (900, "token=" + "Ab1" * 20000), (901, "0123456789abcdef " * 3000), (902, "password" * 3000)]
    found = secrets.report(secrets.scan(docs(spark, rows)))
    wanted = []
    for i, t in rows:
        spans = secret_spans(t or "")
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        wanted.append((-1 if i is None else i, *[sum(k == n for _, k, _ in spans) for n in range(3)], hashlib.sha256(text.encode()).hexdigest()))
    names = ["n_assign", "n_access", "n_hex", "base_sha256"]
    assert sorted(tuple(r) for r in found.select(F.coalesce("doc_id", F.lit(-1)), *names).collect()) == sorted(wanted)
    assert secrets.scan(docs(spark, [])).collect() == []


def test_random_tokens_stand_and_words_do_not(spark):
    import base64

    generator = np.random.default_rng(3)
    keys = [base64.b64encode(generator.bytes(36)).decode() for _ in range(60)]
    words = [f"{'configuration' * 2}{n}settings{'value' * 3}" for n in range(60)]
    rows = [(i, f"see {x} here") for i, x in enumerate(keys + words)]
    added = {r.doc_id: [(s.start, s.end) for s in r.added] for r in secrets.scan(docs(spark, rows)).collect()}
    assert sum(added[i] == [(4, 4 + len(k))] for i, k in enumerate(keys)) >= 54
    assert not any(added[i] for i in range(60, 120))


def test_p_values_of_the_battery(spark):
    token = "0a1b2c3d4e5f6071829304a5b6c7d8e9"
    found = spark.createDataFrame([(token,)], "t string").select(secrets._tests(F.col("t")).alias("x")).first().x
    places = np.array(["0123456789abcdef".index(c) + 1 for c in token])
    n = len(places)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    counts = np.bincount(places, minlength=17)[1:]
    chi = (16 / n * (counts**2).sum() - n - 15) / math.sqrt(2 * 15 * (n - 1) / n)
    high = int((places > 8).sum())
    low = n - high
    runs = 1 + int(((places[1:] > 8) != (places[:-1] > 8)).sum())
    mean = 2 * high * low / n + 1
    spread = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    d = places - places.mean()
    serial = (d[1:] * d[:-1]).sum() / (d**2).sum()
    each = [tail(chi), 2 * tail(abs((runs - mean) / math.sqrt(spread))), 2 * tail(abs((serial + 1 / n) * math.sqrt(n)))]
    assert found.n == n and abs(found.p - min(1, 3 * min(each))) < 2e-3
