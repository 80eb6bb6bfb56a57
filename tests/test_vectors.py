"""Text, vectors, profiles and search against small or brute-force results."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsweave.functions.text import clean_text, combined_text
from newsweave.operators import corpus, profiles, quantised, similarity, text_vectors, vectors
from newsweave.session import new_folder
from tests.test_clicks import log


def articles(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "news_id string, embedding array<double>")


def one(spark, text, *columns):
    return spark.createDataFrame([text], "title string, abstract string").select(*columns).first()


def test_clean_text_drops_newlines_and_accents(spark):
    assert one(spark, ("a\nb É", None), clean_text(F.col("title")))[0] == "ab "


def test_null_abstract_leaves_the_title(spark):
    assert one(spark, ("title", None), combined_text(F.col("title"), F.col("abstract")))[0] == "title"


def test_worked_mean(spark):
    table = articles(spark, [("N11", [.1, .2, .3]), ("N21", [.2, .3, .4]), ("N103", [.3, .4, .5])])
    row = profiles.profiles_from_all_rows(log(spark, ("U1", "N11 N21 N103", None)), table).first()
    assert np.allclose(row.user_embedding, [.2, .3, .4])


@pytest.mark.parametrize("budget", [1 << 20, 0])
def test_repeats_weigh_and_unknown_items_do_not_count(spark, budget):
    from newsweave.operators.behaviors import history_items

    table = articles(spark, [("N1", [1, 0]), ("N2", [0, 3])])
    rows = log(spark, ("U1", "N1 N1 N2", None), ("U2", "N1 N999", None), ("U3", "N998 N999", None))
    found = profiles.mean_vectors(history_items(rows), table, budget=budget)
    means = {r.user_id: r.user_embedding for r in found.collect()}
    assert set(means) == {"U1", "U2"}
    assert np.allclose(means["U1"], [2 / 3, 1]) and np.allclose(means["U2"], [1, 0])


def test_first_row_profile_ignores_later_rows(spark):
    table = articles(spark, [("N1", [1, 0]), ("N2", [0, 1])])
    rows = log(spark, ("U1", "N1", None), ("U1", "N2", None), ("U2", None, None), ("U2", "N1", None))
    means = {r.user_id: r.user_embedding for r in profiles.profiles_from_first_row(rows, table).collect()}
    assert means == {"U1": [1.0, 0.0]}


def test_malformed_vectors_are_removed(spark):
    texts = spark.createDataFrame(
        [("a", "0.5,1.5"), ("b", "0.1,zz"), ("c", ""), ("d", None), ("e", "1, 2")],
        "news_id string, embedding_string string",
    )
    found = {r.news_id: r.embedding for r in vectors.parsed_checked(texts).collect()}
    assert found == {"a": [0.5, 1.5], "e": [1.0, 2.0]}


def test_mixed_dimensions_are_an_error(spark):
    texts = spark.createDataFrame([("a", "1,2"), ("b", "1,2,3")], "news_id string, embedding_string string")
    with pytest.raises(ValueError, match="one dimension"):
        vectors.parsed_checked(texts)


def test_text_form_goes_there_and_back(spark):
    table = spark.createDataFrame([("a", [0.1, -2.5e-9, 3.0])], "news_id string, embedding array<float>")
    assert vectors.parsed(vectors.serialised(table)).first() == table.first()


def test_zero_vector_stays(spark):
    row = vectors.normalised(articles(spark, [("a", [0, 0]), ("b", [3, 4])])).orderBy("news_id").collect()
    assert [r.embedding for r in row] == [[0.0, 0.0], [0.6, 0.8]]


def test_token_level_and_pooled_vectors(spark):
    words = spark.createDataFrame([("d", ["x", "none", "y", "x"])], "news_id string, tokens array<string>")
    table = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 2.0])], "token string, vector array<float>")
    level = text_vectors.token_level_vectors(words, table).first()
    assert level.embedding == [[1.0, 0.0], [0.0, 2.0], [1.0, 0.0]]
    pooled = text_vectors.document_vectors(words, table).first()
    assert np.allclose(pooled.embedding, [2 / 3, 2 / 3])


def brute_force(users, items, k):
    """Rows (user, item, rank) of the k best, ties to the lower id."""
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    rows = set()
    for user, profile in users:
        scored = sorted((-round(float(unit(profile) @ unit(v)), 9) + 0.0, name) for name, v in items)
        rows |= {(user, name, rank) for rank, (_, name) in enumerate(scored[:k], 1)}
    return rows


@pytest.fixture(scope="module")
def sets(spark):
    generator = np.random.default_rng(3)
    centres = generator.normal(size=(6, 8))
    items = [(f"N{i:03d}", centres[i % 6] + 0.15 * generator.normal(size=8)) for i in range(300)]
    items += [(f"N{300 + i}", items[i][1]) for i in range(20)]  # ties
    users = [(f"U{i}", centres[i % 6] + 0.3 * generator.normal(size=8)) for i in range(60)] + [("U60", np.zeros(8))]
    table = spark.createDataFrame(
        [(u, [float(x) for x in v]) for u, v in users], "user_id string, user_embedding array<double>"
    )
    return users, items, table, articles(spark, items)


def found(df):
    return {(r.user_id, r.news_id, r["rank"]) for r in df.collect()}


def test_broadcast_search_is_exact(sets):
    users, items, table, rows = sets
    assert found(similarity.top_articles(table, rows)) == brute_force(users, items, 10)


@pytest.mark.parametrize("block_rows", [8192, 7])
def test_cell_search_is_exact(sets, block_rows):
    users, items, table, rows = sets
    result = similarity.top_articles(table, rows, budget=0, block_rows=block_rows)
    assert found(result) == brute_force(users, items, 10)


def test_cell_search_skips_cells(sets):
    _, _, table, rows = sets
    index = similarity.build_cells(rows, 6)
    exact = similarity.search_exact(table, index)
    bounds = exact.filter("rank = 10").select("user_id", F.col("similarity_score").alias("bound"))
    visits = similarity._user_cells(table.join(bounds, "user_id"), index, "reachable").filter("user_id <> 'U60'")
    assert visits.count() < 60 * 5 / 2


def test_recall_grows_with_probes(sets):
    users, items, table, rows = sets
    index = similarity.build_cells(rows, 6)
    truth = brute_force(users, items, 10)
    pairs = {(u, n) for u, n, _ in truth}
    recalls = []
    for probes in (1, 3, 6):
        result = found(similarity.search_approximate(table, index, probes=probes))
        recalls.append(len({(u, n) for u, n, _ in result} & pairs) / len(pairs))
    assert recalls[0] <= recalls[1] <= recalls[2] == 1.0 and recalls[0] > 0.5


def test_fewer_articles_than_k(spark, sets):
    _, _, table, _ = sets
    few = articles(spark, [("a", [1] * 8), ("b", [2] + [1] * 7), ("c", [-1] * 8)])
    ranks = found(similarity.top_articles(table, few))
    assert {r for _, _, r in ranks} == {1, 2, 3} and len(ranks) == 61 * 3


def test_stored_index_is_rebuilt_when_articles_change(spark, sets):
    users, items, table, rows = sets
    path = new_folder(spark, "index")
    similarity.load_or_build_cells(rows, path, cells=4)
    fewer = articles(spark, items[:100])
    index = similarity.load_or_build_cells(fewer, path, cells=4)
    assert index.articles.count() == 100
    assert similarity.load_or_build_cells(rows, path, cells=4).articles.count() == 320


def test_encoder_hook(spark):
    texts = spark.createDataFrame([("a", "xx"), ("b", "xxxx")], "news_id string, clean_text string")
    result = text_vectors.encoded(texts, lambda batch: np.array([[len(t), 1.0] for t in batch]))
    assert {r.news_id: r.embedding for r in result.collect()} == {"a": [2.0, 1.0], "b": [4.0, 1.0]}


def test_chunked_search_goes_on_after_the_last_finished_chunk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = articles(spark, [(f"N{i}", rng.normal(size=4)) for i in range(60)])
    users = articles(spark, [(f"U{i}", rng.normal(size=4)) for i in range(40)]).toDF("user_id", "user_embedding")
    path, calls = new_folder(spark, "chunks"), []
    search = similarity.top_articles

    def counted(*args, **options):
        if len(calls) == 2:
            raise RuntimeError("lost")
        calls.append(sorted(r.user_id for r in args[0].collect()))
        return search(*args, **options)

    with monkeypatch.context() as patch:
        patch.setattr(similarity, "top_articles", counted)
        with pytest.raises(RuntimeError):
            similarity.search_in_chunks(users, items, path, 5, k=3)
    done = list(calls)
    patched = lambda *args, **options: (calls.append(sorted(r.user_id for r in args[0].collect())), search(*args, **options))[1]
    monkeypatch.setattr(similarity, "top_articles", patched)
    found = similarity.search_in_chunks(users, items, path, 5, k=3)
    assert len(calls) == 5 and calls[:2] == done and sorted(sum(calls, [])) == sorted(r.user_id for r in users.collect())
    assert sorted(found.collect()) == sorted(search(users, items, 3).collect())


def test_quantised_estimates_and_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, centres[i % 12] + 0.3 * rng.normal(size=16)) for i in range(900)] + [(2000 + i, centres[0]) for i in range(300)]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows] + [(5000, None), (5001, [float("nan")] * 16)], "news_id long, embedding array<double>")
    users = spark.createDataFrame([(i, [float(x) for x in centres[i % 12] + 0.2 * rng.normal(size=16)]) for i in range(30)], "user_id long, user_embedding array<double>")
    index = quantised.build(frame, new_folder(spark, "quantised"))
    assert 17 <= len(index.fine) <= 70 and index.articles.count() == 1200
    # Added table entries are the products with the reconstructed vectors.
    vectors = np.vstack([v for _, v in rows[:50]])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    cell = quantised._placed(index.coarse, index.fine, index.parent, vectors)
    codes = quantised._codes(index.books, vectors - index.fine[cell])
    back = index.fine[cell] + np.hstack([index.books[p][codes[:, p]] for p in range(len(index.books))])
    assert np.linalg.norm(back - vectors, axis=1).mean() < np.linalg.norm(index.fine[cell] - vectors, axis=1).mean() < 0.8
    exact = similarity.top_articles(users, frame)
    probes = quantised.measured_probes(users, frame, index)
    assert probes < len(index.fine) / 2
    found = quantised.search(users, index, probes=probes)
    assert quantised.recall(found, exact).first()["recall"] >= 0.9
    # Only folders of visited parts are read.
    whole = quantised.search(users, index, probes=len(index.fine), short=2000)
    assert sorted(whole.collect()) == sorted(exact.collect())
    one = quantised.search(users.limit(1), index, probes=1)
    assert len(one.inputFiles()) < len(index.articles.inputFiles()) or one.count() <= 10


def test_means_of_vectors_too_many_to_broadcast(spark, monkeypatch):
    from newsweave.operators import joins

    rng = np.random.default_rng(11)
    # A hot user, an item with two vectors, unknown and null items, a null user.
    pairs = [("hot", f"N{i % 90}") for i in range(400)] + [(f"U{int(rng.integers(20))}", f"N{int(rng.integers(120))}") for _ in range(300)]
    pairs = spark.createDataFrame([*pairs, (None, "N1"), ("U1", None), ("lost", "N500")], "user_id string, news_id string")
    table = articles(spark, [(f"N{i}", rng.normal(size=4)) for i in range(100)] + [("N1", [1, 2, 3, 4])])
    few = {r.user_id: r.user_embedding for r in profiles.mean_vectors(pairs, table).collect()}
    seen = []
    split = joins.bucketed
    monkeypatch.setattr(profiles, "BUCKET_BYTES", 8 * 4 * 30)
    monkeypatch.setattr(profiles, "bucketed", lambda *a: (seen.append(split(*a)), seen[-1])[1])
    many = {r.user_id: r.user_embedding for r in profiles.mean_vectors(pairs, table, budget=0).collect()}
    assert set(few) == set(many) and "lost" not in many and None in many
    assert all(np.allclose(few[u], many[u]) for u in few)
    dealt, needed = seen[0]
    # A bucket asks for an item once, and a hot user is in several buckets.
    assert dealt.where("user_id = 'hot'").select("_bucket").distinct().count() > 1
    assert needed.where("news_id <> 'N1'").groupBy("_of_bucket", "news_id").count().where("count > 1").isEmpty()


def test_frequent_words_are_added_up_where_the_articles_are(spark, monkeypatch):
    rng = np.random.default_rng(16)
    words = [(f"N{i % 70}" if i else None, [f"w{int(w)}" for w in rng.zipf(1.4, size=30) if w < 400] + (["lost"] if i % 3 else [])) for i in range(90)]
    words += [("N1", []), ("N500", ["lost", None]), ("N501", ["w390", None, "w1"]), ("N502", None)]
    words = spark.createDataFrame(words, "news_id string, tokens array<string>")
    table = [(f"w{i}", [float(x) for x in rng.normal(size=4)]) for i in range(400)] + [("w1", [1.0, 2.0, 3.0, 4.0]), ("w399", [9.0] * 4), ("w2", None)]
    dealt, split = [], profiles._bucket_means
    monkeypatch.setattr(text_vectors, "_bucket_means", lambda rows, *a: (dealt.append(rows.count()), split(rows, *a))[1])
    for kind, most in (("float", 4 * 4 * 30), ("double", 8 * 4 * 30), ("float", 1), ("float", 64 << 20)):
        vectors = spark.createDataFrame(table, f"token string, vector array<{kind}>")
        monkeypatch.setattr(text_vectors, "_FREQUENT_BYTES", most)
        few = {r.news_id: r.embedding for r in text_vectors.document_vectors(words, vectors).collect()}
        many = {r.news_id: r.embedding for r in text_vectors.document_vectors(words, vectors, budget=0).collect()}
        assert set(few) == set(many) and None in many and "N500" not in many and "N502" not in many
        assert all(np.allclose(few[u], many[u], atol=1e-12) for u in few)
    pairs = words.selectExpr("news_id", "explode(tokens) token").where("token is not null").distinct().count()
    # Only rare words are dealt out; with no room for frequent ones, all are.
    assert dealt[0] < pairs / 2 and dealt[0] == dealt[1] and dealt[2] >= pairs and dealt[3] < dealt[0]


def test_token_level_vectors_meet_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(text_vectors, "_BUCKET_ROWS", 10)
    words = [("a", "x y x z".split()), ("b", "y q".split()), ("b", "x".split()), (None, ["z"]), ("c", ["q"]), ("d", [])]
    table = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [0.5, 9.0]), ("z", None)], "token string, vector array<double>")
    frame = spark.createDataFrame(words, "news_id string, tokens array<string>")
    found = {r.news_id: r.embedding for r in text_vectors.token_level_vectors(frame, table).collect()}
    x, y = [1.0, 2.0], [0.5, 9.0]
    assert found == {"a": [x, y, x, None], "b": [y, x], None: [None]}
    plan = text_vectors.token_level_vectors(frame, table)._jdf.queryExecution().executedPlan().toString()
    # Vectors are gathered in the task that has the article's words, and not dealt again.
    assert "collect_list" not in plan


def test_words_dealt_into_buckets_are_stored_packed(spark, monkeypatch):
    from newsweave.operators import joins

    monkeypatch.setattr(joins, "cut_lineage", None)
    words = spark.createDataFrame([("a", "x y x".split()), ("b", ["y"]), (None, ["x"])], "news_id string, tokens array<string>")
    table = spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "token string, vector array<double>")
    found = {r.news_id: r.embedding for r in text_vectors.token_level_vectors(words, table).collect()}
    assert found == {"a": [[1.0], [2.0], [1.0]], "b": [[2.0]], None: [[1.0]]}


def test_a_user_goes_to_a_block_once_however_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    frame = articles(spark, [(f"N{i}", rng.normal(size=8)) for i in range(900)] + [(f"T{i}", np.ones(8)) for i in range(200)])
    users = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)], "user_id long, user_embedding array<double>")
    index = quantised.build(frame, new_folder(spark, "quantised"))
    first, many, count = quantised._blocks(index)
    probes = len(index.fine)
    visits = quantised._visits(users, index, probes, first, many)
    assert count == 1100 and probes >= 30 and visits.count() == 40
    listed = quantised._shortlists(quantised._unit_users(users), index, probes, 1100, 10)
    # With all articles on the short list only the best of each block go on.
    assert listed.count() == 40 * 10
    near = sorted(quantised.search(users, index, probes=12, short=50).collect())
    exact = sorted(similarity.top_articles(users, frame).collect())
    assert sorted(quantised.search(users, index, probes=probes, short=1100).collect()) == exact
    # Many blocks of cells, and cells of many blocks.
    for rows in (300, 30):
        monkeypatch.setattr(quantised, "BLOCK_ROWS", rows)
        monkeypatch.setattr(quantised, "USER_BLOCK_ROWS", 15)
        assert sorted(quantised.search(users, index, probes=12, short=50).collect()) == near
        assert sorted(quantised.search(users, index, probes=probes, short=1100).collect()) == exact


def test_a_short_list_leaves_its_task_whole_and_vectors_come_later(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [(f"N{i:04d}", rng.normal(size=8)) for i in range(900)]
    frame = articles(spark, rows + rows[:40] + [(f"Z{i}", np.ones(8)) for i in range(30)])
    users = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(30)] + [(30, [0.0] * 8)]
    users = spark.createDataFrame(users, "user_id long, user_embedding array<double>")
    index = quantised.build(frame, new_folder(spark, "quantised"))
    listed = quantised._shortlists(quantised._unit_users(users), index, 12, 200, 10)
    # Not the 200 listed articles of a user go on, but its best by cosine, one row for each.
    assert listed.count() == 31 * 10
    near = sorted(quantised.search(users, index, probes=12, short=200).collect())
    exact = sorted(quantised.search(users, index, probes=len(index.fine), short=2000).collect())
    # Several blocks of codes, whose lists are merged, and of vectors.
    monkeypatch.setattr(quantised, "BLOCK_ROWS", 250)
    monkeypatch.setattr(quantised, "CODE_BLOCKS", 1)
    assert sorted(quantised.search(users, index, probes=12, short=200).collect()) == near
    # With all cells and articles the rows of an id stand for each other, in any number of blocks.
    assert sorted(quantised.search(users, index, probes=len(index.fine), short=2000).collect()) == exact


def test_articles_all_listed_are_scored_by_products(spark, monkeypatch):
    rng = np.random.default_rng(15)
    frame = articles(spark, [(f"N{i:03d}", rng.normal(size=8)) for i in range(400)])
    users = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(20)], "user_id long, user_embedding array<double>")
    index = quantised.build(frame, new_folder(spark, "quantised"))
    # Pairs are not scored one by one.
    monkeypatch.setattr(quantised, "_exact", None)
    found = quantised.search(users, index, probes=len(index.fine), short=400)
    assert sorted(found.collect()) == sorted(similarity.top_articles(users, frame).collect())


def test_small_blocks_shuffle_no_more_and_find_the_same(spark):
    rng = np.random.default_rng(10)
    frame = articles(spark, [(f"N{i}", rng.normal(size=8)) for i in range(600)])
    users = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(50)], "user_id long, user_embedding array<double>")
    index = similarity.cells_around(frame, rng.normal(size=(2, 8)))
    chosen = similarity._user_cells(users, index, "closest", 2)
    # The best of a cell, not of each small block of it, leave the task.
    assert similarity._search_cells(chosen, index, 5, 20).count() == 50 * 2 * 5
    assert sorted(similarity.search_approximate(users, index, 5, 2, 20).collect()) == sorted(similarity.top_articles(users, frame, 5).collect())


def test_small_pieces_put_few_rows_in_order(monkeypatch):
    rng = np.random.default_rng(12)
    users, items = (similarity._unit_rows(rng.normal(size=(n, 16))) for n in (64, 20_000))
    items[5000:5100] = items[:100]
    whole, sizes, lexsort = similarity._best(users, items, 10), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sizes.append(len(keys[0])), lexsort(keys))[1])
    found = similarity._best(users, items, 10, 50)
    assert all((a == b).all() for a, b in zip(whole, found))
    # Not the ten best of each of 400 pieces.
    assert sum(sizes) < 100 * 64 * 10
    # What can't be among the best of a user is left out, what ties with the bound is not.
    bound = whole[2].reshape(64, 10)[:, 4]
    rows, _, values = similarity._best(users, items, 10, 50, bound)
    assert all((values[rows == i][:5] == whole[2].reshape(64, 10)[i, :5]).all() for i in range(64))


def test_exact_search_emits_only_what_reaches_the_first_hits(spark):
    rng = np.random.default_rng(13)
    frame = articles(spark, [(f"N{i}", rng.normal(size=8)) for i in range(900)])
    users = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], 0.8) for i in range(50)], "user_id long, user_embedding array<double>, bound double")
    index = similarity.cells_around(frame, rng.normal(size=(3, 8)))
    chosen = similarity._user_cells(users, index, "reachable")
    found = similarity._search_cells(chosen, index, 10, 50)
    unbound = similarity._search_cells(chosen.drop("bound"), index, 10, 50).where("similarity_score >= 0.8")
    assert 0 < found.count() < 50 * 2 * 10 and sorted(found.collect()) == sorted(unbound.collect())


def test_hashed_contexts_send_one_row_for_each_word_of_a_task_and_stream(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"a{i % 5}", i // 5, f"w{rng.integers(6)}") for i in range(3000)] + [(None, 0, "x"), (None, 1, None), (None, 2, "y")]
    frame = spark.createDataFrame(rows, "news_id string, position int, token string")
    found = {(r["token"], r["pos"]): r["value"] for r in text_vectors.hashed_contexts(frame, 8, 2).collect()}
    # Thousands of pairs of words are one row of sums for each different word.
    table = pa.table({"news_id": [r[0] for r in rows], "_block": [0] * len(rows), "position": [r[1] for r in rows], "token": [r[2] for r in rows]})
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] or "", rows[i][1]))
    batches = table.take(order).to_batches(100)
    sums = pa.Table.from_batches(text_vectors._context_sums(iter(batches), 8, 2, 4, 4096, 10_000))
    assert sums.num_rows == 9
    # A few words and sums at a time come to the same.
    for most in (7, 100, 1000):
        monkeypatch.setattr(text_vectors, "_CONTEXT_SUMS", 24)
        parts = pa.Table.from_batches(text_vectors._context_sums(iter(batches), 8, 2, 4, 4096, most)).sort_by("token")
        added = pa.Table.from_batches(text_vectors._added(iter(parts.to_batches(5)), 8)).to_pylist()
        assert len(added) == len(found) and {(r["token"], r["pos"]): r["value"] for r in added} == found


def test_hashed_contexts_follow_the_window_over_block_borders(spark, monkeypatch):
    words = [f"w{i % 7}" for i in range(50)]
    rows = spark.createDataFrame([("a", i, w) for i, w in enumerate(words)] + [("b", 0, "alone")], "news_id string, position int, token string")
    whole = sorted(text_vectors.hashed_contexts(rows, 32, 3).collect())
    monkeypatch.setattr(text_vectors, "_CONTEXT_BLOCK", 5)
    assert sorted(text_vectors.hashed_contexts(rows, 32, 3).collect()) == whole
    expected = {}
    for i, w in enumerate(words):
        for j in range(max(0, i - 3), min(50, i + 4)):
            if i != j:
                for e in range(4):
                    mark = hashlib.md5(f"{words[j]}#{e}".encode()).hexdigest()
                    key = (w, int(mark[:8], 16) % 32 + 1)
                    expected[key] = expected.get(key, 0) + (-1 if int(mark[8], 16) % 2 else 1)
    assert {(t, p): v for t, p, v in whole} == expected


def test_many_requests_equal_comparing_every_pair(spark):
    rng = np.random.default_rng(9)
    base = 1_700_000_000
    items = [(i, "hot" if i % 3 else f"t{i % 5}", base + int(rng.integers(0, 10**6)), None if i % 4 else "s") for i in range(400)] + [(900, None, base, None), (901, "hot", None, None)]
    wanted = []
    for r in range(60):
        start = base + int(rng.integers(0, 10**6))
        wanted.append((r, rng.choice(["hot", "t1", "t2", "none"]).item(), start, start + int(rng.choice([-5, 0, 1, 100, 70_000, 900_000]))))
    frame = spark.createDataFrame(items, "id long, topic string, at long, source string").withColumn("published", F.timestamp_seconds("at"))
    requests = spark.createDataFrame(wanted, "request_id long, topic string, s long, e long").select(
        "request_id", "topic", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))
    expected = sorted((r, i) for r, t, s, e in wanted for i, topic, at, _ in items if topic == t and at is not None and s <= at <= e)
    for budget in (1 << 28, 0):
        found = corpus.requested_articles(frame, requests, excluded=["x"], budget=budget)
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
        assert sorted((r.request_id, r.id) for r in found.collect()) == expected
    assert corpus.requested_articles(frame, requests.limit(0), excluded=["x"]).count() == 0


def test_totals_of_many_requests_equal_their_rows(spark, monkeypatch):
    rng = np.random.default_rng(10)
    base = 1_700_000_000_000_000
    items = [(None if i % 9 == 0 else i, "hot" if i % 3 else f"t{i % 5}", base + int(rng.integers(0, 10**6)), None if i % 4 else "s") for i in range(600)]
    items += [(900, None, base, None), (901, "hot", None, None), (902, "hot", base + 5, "x"), (None, "lone", base + 7, None), (7, "t1", base + 9, None), (7, "t1", base + 9, None)]
    wanted = [(None, "hot", base, base + 10**6), (5, None, base, base + 10**6), (1003, "lone", base, base + 10**6), (1004, "lone", base + 8, base + 9), (1006, "t1", base + 9, base + 9)]
    for r in range(200):
        start = base + int(rng.integers(0, 10**6))
        wanted.append((r % 150, rng.choice(["hot", "t1", "t2", "none"]).item(), start, start + int(rng.choice([-5, 0, 1, 100, 70_000, 900_000, 2_000_000]))))
    frame = spark.createDataFrame(items, "id long, topic string, at long, source string").withColumn("published", F.timestamp_micros("at"))
    requests = spark.createDataFrame(wanted, "request_id long, topic string, s long, e long").select(
        "request_id", "topic", F.timestamp_micros("s").alias("start"), F.timestamp_micros("e").alias("end"))
    rows = corpus.requested_articles(frame, requests, excluded=["x"])
    expected = sorted(map(tuple, rows.groupBy("request_id").agg(F.count(F.lit(1)), F.min("id"), F.max("id")).collect()), key=str)
    assert len(expected) > 50 and (1003, 1, None, None) in expected
    for piece, share, budget in ((1 << 18, 1 << 18, 1 << 28), (10, 3, 1 << 28), (10, 3, 0)):
        monkeypatch.setattr(corpus, "PIECE_ROWS", piece)
        monkeypatch.setattr(corpus, "EDGE_ROWS", share)
        found = corpus.requested_articles(frame, requests, excluded=["x"], budget=budget, totals="id")
        assert sorted(map(tuple, found.collect()), key=str) == expected
    local = [c.cast("timestamp_ntz").alias(n) for c, n in ((F.col("start"), "start"), (F.col("end"), "end"))]
    plain = frame.withColumn("published", F.col("published").cast("timestamp_ntz"))
    found = corpus.requested_articles(plain, requests.select("request_id", "topic", *local), excluded=["x"], totals="id")
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert corpus.requested_articles(frame, requests.limit(0), excluded=["x"], totals="id").count() == 0
    assert corpus.requested_articles(frame.limit(0), requests, excluded=["x"], totals="id").count() == 0
    # 20,000 requests for all of 20,000 articles: 4e8 pairs, of which no row is made.
    many = spark.range(20_000).select("id", F.lit("a").alias("topic"), F.lit(None).cast("string").alias("source"), F.timestamp_seconds("id").alias("published"))
    asked = spark.range(20_000).select(F.col("id").alias("request_id"), F.lit("a").alias("topic"), F.timestamp_seconds(F.col("id") % 7).alias("start"), F.timestamp_seconds(F.lit(10**6)).alias("end"))
    found = corpus.requested_articles(many, asked, totals="id").agg(F.sum("articles"), F.max("least"), F.min("greatest")).first()
    assert tuple(found) == (sum(20_000 - r % 7 for r in range(20_000)), 6, 19_999)


def test_fitted_text_stages_read_each_article_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(f"N{i % 9}" if i else None, f"The sun, {'moon' if i % 2 else 'star'} and sea", "of THE sky" if i % 3 else None) for i in range(20)]
    news = spark.createDataFrame(rows, "news_id string, title string, abstract string")
    pipeline = text_vectors.text_pipeline(["the", "and", "of"], vector_size=4, min_count=2, partitions=1)
    model, found = text_vectors.fitted_and_transformed(pipeline, news.mapInArrow(counted, news.schema))
    assert found.columns == ["news_id", "tokens", "embedding"]
    kept = lambda frame: sorted((r.news_id or "", r.tokens, r.embedding.toArray().tolist()) for r in frame.collect())
    once = kept(found)
    assert read.value == len(rows)
    # The model works on texts as one that is fitted in one go does.
    assert once == kept(model.transform(news))
    whole = pipeline.fit(news).transform(news)
    assert [x[:2] for x in once] == [x[:2] for x in kept(whole)]
    assert text_vectors.fitted_and_transformed(pipeline, news)[1].where("size(tokens) > 0").count() == len(rows)
