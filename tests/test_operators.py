import json

import pytest
from pyspark.sql import functions as F

from orefield.functions.hashing import modular_hash, next_prime, string_number, trailing_zeros
from orefield.functions.text import letter_tokens, raw_tokens, stripped
from orefield.operators import clustering, content, explore, graph, itemsets, keyed, recommend, similarity, sketches
from orefield.sources import files


def edges(spark, *pairs):
    return spark.createDataFrame([(*e, 1) for e in pairs], "a bigint, b bigint, common bigint")


@pytest.mark.parametrize("s", ["", "a", "héllo", "数据", "x" * 200])
def test_string_number_equals_big_integers(spark, s):
    p = 1_000_003
    assert spark.createDataFrame([(s,)], "s string").select(string_number(F.col("s"), p)).first()[0] == int.from_bytes(s.encode(), "big") % p


def test_hashes_and_zeros(spark):
    r = spark.createDataFrame([(0,), (8,), (7,), (-1,)], "x bigint").select(trailing_zeros(F.col("x")), modular_hash(F.col("x"), 3, 4, 97, 10)).collect()
    assert [x[0] for x in r] == [1, 3, 0, 0] and r[3][1] == ((96 * 3 + 4) % 97) % 10 and next_prime(7) == 11


def test_tokens(spark):
    r = spark.createDataFrame([("The, (He) x\tné2w !",)], "t string").select(raw_tokens(F.col("t")), letter_tokens(F.col("t"))).first()
    assert r[0] == ["the", "he", "x", "né2w", ""]
    assert r[1] == ["the", "he", "x", "néw"]
    odd = spark.createDataFrame([("\u00a0a\u3000b\u2009c\x1fd\u0085 ",)], "t string").select(raw_tokens(F.col("t")), letter_tokens(F.col("t")), stripped(F.col("t"))).first()
    assert odd[0] == ["", "a", "b", "c", "d", ""] and odd[1] == ["a", "b", "c", "d"]
    assert odd[2] == "a\u3000b\u2009c\x1fd"


def test_stop_words_as_substrings_and_exactly(spark):
    t = spark.createDataFrame([("he the thx zebra",)], "text string")
    assert [r.word for r in explore.top_words(t, 9, "substring").collect()] == ["thx", "zebra"]
    assert [r.word for r in explore.top_words(t, 9, "exact").collect()] == ["he", "thx", "zebra"]


def test_distinct_counts_null_as_a_value(spark):
    assert explore.distinct_keys(spark.createDataFrame([(1,), (None,), (1,)], "k int"), "k").first().n == 2
    assert explore.distinct_keys(spark.createDataFrame([(1,)], "k int"), "k").first().n == 1
    assert explore.distinct_keys(spark.createDataFrame([], "k int"), "k").first().n == 0


def test_category_means_trim_and_skip_null(spark):
    r = spark.createDataFrame([("b1", 5.0), ("b1", 3.0), ("b2", 1.0), ("b3", 2.0)], "business_id string, stars double")
    b = spark.createDataFrame([("b1", "X, Y "), ("b2", "Y"), ("b3", None)], "business_id string, categories string")
    assert [tuple(x) for x in explore.average_stars(r, b, 5).collect()] == [("X", 4.0), ("Y", 3.0)]


def test_explore_in_one_object(spark):
    r = spark.createDataFrame([("u", "2018-01-02", "good good the"), ("v", "2017-01-01", "good bad")], "user_id string, date string, text string")
    assert explore.explore(r, "2018", 1, 2, "exact") == {"A": 2, "B": 1, "C": 2, "D": [["u", 1]], "E": ["good", "bad"]}


def test_itemsets_levels_equal_fpgrowth(spark):
    rows = [(i, x) for i in range(30) for x in "abcde" if (i * (ord(x) - 90)) % 3 != 1]
    sets = itemsets.baskets(spark.createDataFrame(rows, "k int, i string"), "k", "i")
    plain = lambda df: {(tuple(r["items"]), r["freq"]) for r in df.collect()}
    assert plain(itemsets.frequent(sets, 7, 5)) == plain(itemsets.fpgrowth(sets, 7)) and plain(itemsets.frequent(sets, 999, 3)) == set()
    assert itemsets.baskets(spark.createDataFrame(rows, "k int, i string"), "k", "i", 99).isEmpty()


def test_pearson_defaults(spark):
    r = spark.createDataFrame([(k, u, float(s)) for k, v in {"a": [1, 2, 3], "b": [2, 4, 6], "c": [3, 3, 3], "d": [3, 2, 1]}.items() for u, s in enumerate(v)], "k string, u int, stars double")
    got = {(x.a, x.b): round(x.sim, 9) for x in similarity.pearson(r, "k", "u").collect()}
    assert got["a", "b"] == 1 and got["a", "d"] == -1 and got["a", "c"] == 1.0
    assert similarity.pearson(r, "k", "u", 4).isEmpty()


def test_jaccard_and_bands(spark):
    p = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 2), ("y", 2), ("z", 9)], "k string, i int")
    assert [tuple(r) for r in similarity.jaccard(p, "k", "i", 0.5).collect()] == [("x", "y", 1.0)] == [tuple(r) for r in similarity.lsh_jaccard(p, "k", "i", 0.5).collect()]


def test_predictions_fall_back(spark):
    r = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0), (2, 10, 5.0)], "user_id bigint, business_id bigint, stars double")
    q = spark.createDataFrame([(1, 10), (9, 11), (1, 99), (9, 99)], "user_id bigint, business_id bigint")
    by = lambda df: {(x.user_id, x.business_id): x.stars for x in df.collect()}
    assert by(recommend.predict_by_items(r, q)) == {(1, 10): 4.5, (9, 11): 2.0, (1, 99): 3.0, (9, 99): 0.0}
    assert by(recommend.predict_by_users(r, q))[1, 99] == 3.0


def test_content_scores(spark):
    u = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"])], "user_id int, words array<string>")
    b = spark.createDataFrame([("x", ["a", "c", "d", "e"])], "business_id string, words array<string>")
    q = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "user_id int, business_id string")
    assert [tuple(r) for r in content.content_scores(q, u, b).collect()] == [(1, "x", 0.5)]
    assert content.content_scores(q, u, b, measure="cosine").first().sim == round(1 / 8**0.5, 6)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark, monkeypatch):
    n = 100_000
    m, k = sketches.bloom_size(n, 0.01)
    base = spark.range(0, 3 * n, 3).withColumnRenamed("id", "x")
    probes = spark.range(3 * n).select(F.col("id").alias("seq"), F.col("id").alias("x"))
    for block in (sketches.BLOOM_BLOCK, m // 5):
        monkeypatch.setattr(sketches, "BLOOM_BLOCK", block)
        flags = sketches.bloom_flags(probes, "x", "seq", sketches.bloom_bits(base, "x", m, k), m, k)
        hits, false = flags.agg(F.sum(F.when(F.col("seq") % 3 == 0, F.col("flag"))), F.sum(F.when(F.col("seq") % 3 != 0, F.col("flag")))).first()
        assert hits == n and false < 0.02 * 2 * n
    few = spark.createDataFrame([(0, None), (1, 5), (2, 5)], "seq int, x bigint")
    none = sketches.bloom_bits(base.filter("false"), "x", m, k)
    assert [r.flag for r in sketches.bloom_flags(few, "x", "seq", none, m, k, insert_on_probe=True).orderBy("seq").collect()] == [0, 0, 1]


@pytest.mark.parametrize("n", [5000, 50_000, 1_000_000])
def test_distinct_estimate_is_near(spark, n):
    r = sketches.fm_distinct(spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("x")), ["k"], "x").first()
    assert r.n_exact == n and n / 4 < r.n_estimate < n * 4


def test_samples_are_whole(spark):
    assert sketches.bottom_k(spark.range(5), "id", 10).count() == 5 and sketches.bottom_k(spark.range(50), "id", 10).count() == 10
    tags = spark.createDataFrame([(["b", "a"],), (["a"],), ([],)], "tags array<string>")
    assert [tuple(x) for x in sketches.top_tags(tags).collect()] == [("a", 2), ("b", 1)]


def test_kmeans_and_distances(spark):
    p = spark.createDataFrame([(i, [float(i // 5 * 100 + i % 5), 1.0]) for i in range(10)], "point_id bigint, x array<double>")
    found = clustering.kmeans(p, [(0, [0.0, 1.0]), (1, [1.0, 1.0])], 2)
    assert sorted((c.n, c.centre[0]) for c in found) == [(5, 2.0), (5, 102.0)] and found[0].deviations[1] == 0.0
    edge = spark.createDataFrame([(1, [10.6, 1.0]), (2, [10.4, 1.0])], "point_id bigint, x array<double>")
    assert [r.cluster for r in clustering.assign_within(edge, [clustering.Cluster(0, 5, [10.0, 5.0], [40.0, 5.0])], 2).orderBy("point_id").collect()] == [-1, 0]
    assert clustering.kmeans(p.limit(0), [], 2) == []


def test_bfr_finds_two_far_groups(spark):
    p = spark.createDataFrame([(i, [float(i % 2 * 1000 + i % 7), float(i % 5)]) for i in range(200)], "point_id bigint, x array<double>")
    model = clustering.BFR(2, 2)
    for c in range(2):
        model.update(p.filter(F.floor(F.col("point_id") % 4 / 2) == c))
    got = {r.point_id: r.cluster for r in model.result().collect()}
    assert len(got) == 200 and len(model.metrics) == 2
    kept = [(i % 2, c) for i, c in got.items() if c >= 0]
    assert len(kept) > 150 and len({x for x in kept if x[1] >= 0}) == 2


def test_betweenness_of_hand_graphs(spark):
    tri = edges(spark, (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6))
    assert {(r.a, r.b): r.w for r in graph.betweenness(tri).collect()}[3, 4] == 9.0
    path = {(r.a, r.b): r.w for r in graph.betweenness(edges(spark, (1, 2), (2, 3), (3, 4))).collect()}
    assert path == {(1, 2): 3.0, (2, 3): 4.0, (3, 4): 3.0}
    gn = {r.node: r.comp for r in graph.girvan_newman(tri).collect()}
    assert gn == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert {r.node for r in graph.girvan_newman(edges(spark, (1, 2))).collect()} == {1, 2}
    with pytest.raises(ValueError):
        graph.girvan_newman(tri, 3)


def test_components_and_labels(spark):
    g = edges(spark, *((i, i + 1) for i in range(20)), (100, 101))
    assert {r.comp for r in graph.components(g).collect()} == {0, 100}
    star = {r.node: r.label for r in graph.label_propagation(edges(spark, (1, 2), (1, 3), (1, 4)), 1).collect()}
    assert star == {1: 2, 2: 1, 3: 1, 4: 1}
    assert [r.members for r in graph.community_rows(graph.components(g)).collect()] == [[100, 101], list(range(21))]


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u", "business_id": "b", "stars": 4, "date": "2018-01-01", "text": "x"}\n')
    assert files.read_json(spark, str(tmp_path / "r.json"), files.REVIEW).first().stars == 4.0
    (tmp_path / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.read_json(spark, str(tmp_path / "bad.json"), files.REVIEW).collect()
    assert files.read_json(spark, str(tmp_path / "bad.json"), files.REVIEW, strict=False).first().stars is None
    (tmp_path / "p.csv").write_text("user_id,business_id\nu,b\n")
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p.csv")).collect()] == [("u", "b")]
    (tmp_path / "points").mkdir()
    (tmp_path / "points" / "a.csv").write_text("7.0,1.5,2\n")
    assert tuple(files.read_points(spark, str(tmp_path / "points"), 2).first()) == (7, [1.5, 2.0], "a.csv", 0)
    sets = spark.createDataFrame([(["b"], 1), (["a"], 1), (["a", "b"], 2)], "items array<string>, size int")
    assert {r.size: r.line for r in files.itemset_report(sets).collect()} == {1: "('a'),('b')", 2: "('a', 'b')"}
    c = spark.createDataFrame([(["b", "a"],)], "members array<string>")
    assert files.community_report(c).first().line == "'a', 'b'"
    w = spark.createDataFrame([("u", "v", 2.0), ("u", "w", 3.0)], "u string, v string, w double")
    assert [r.line for r in files.betweenness_report(w).collect()] == ["('u', 'w'), 3.0", "('u', 'v'), 2.0"]
    assert files.flag_line(spark.createDataFrame([(2, 1), (1, 0)], "seq int, flag int")).first().flags == "0 1"
    files.write_csv(c.select(F.lit(1).alias("x")), str(tmp_path / "out"))
    files.write_json(w, str(tmp_path / "j"))
    files.write_text(files.betweenness_report(w), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and files.read_lines(spark, str(tmp_path / "t")).count() == 2


def test_positions_follow_the_order_of_keys(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), (F.col("id") % 300).cast("string")).alias("k")).repartition(7)
    got = {r.k: r.position for r in keyed.positions(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted({f"k{i % 300}" for i in range(1000)}))}
    assert keyed.positions(df.filter("false"), "k").isEmpty()
    assert [tuple(r) for r in keyed.positions(spark.createDataFrame([(None,), ("a",)], "k string"), "k").orderBy("position").collect()] == [(None, 0), ("a", 1)]


def test_upserts_replace_and_add(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    assert sorted(map(tuple, keyed.upsert(base, new, "k", "at").collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_partitions_are_counted_as_they_lie(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"))
    r = {x.partition: x.n_items for x in explore.partition_stats(df, "k", 8).collect()}
    assert len(r) == 8 and sum(r.values()) == 100 and sum(v > 0 for v in r.values()) <= 3
    assert explore.n_partitions(df.repartition(5)) == 5 == explore.partition_counts(df.repartition(5)).count()
    report = explore.busy_report(df.withColumnRenamed("k", "business_id"), 33, 4)
    assert report["n_partitions"] == 4 and sum(report["n_items"]) == 100 and report["result"] == [[0, 34]]


def test_candidates_hold_every_frequent_itemset(spark):
    rows = [(i, x) for i in range(120) for x in "abcdef" if (i * (ord(x) - 90) + i // 7) % 3 != 1]
    sets = itemsets.baskets(spark.createDataFrame(rows, "k int, i string"), "k", "i")
    frequent, found = itemsets.frequent(sets, 20, 4), itemsets.candidates(sets, 20, 4, 3)
    plain = lambda df: {tuple(r["items"]) for r in df.collect()}
    assert plain(frequent) and plain(frequent) <= plain(found)
    lines = [r.line for r in files.itemset_sections(found, frequent).collect()]
    assert lines[0] == "Candidates:" and "Frequent Itemsets:" in lines and lines[1].startswith("('a'),('b')") and all(x.endswith("\n") for x in lines if x[0] == "(")


def test_trained_models_are_written_and_read_again(spark, tmp_path):
    r = spark.createDataFrame([(u, b, float((u * b) % 5 + 1)) for u in range(12) for b in range(8) if (u + b) % 3], "user_id bigint, business_id bigint, stars double")
    q = r.select("user_id", ((F.col("business_id") + 1) % 8).alias("business_id"))
    files.write_model(str(tmp_path), items=recommend.train(r, "business_id", "user_id"), users=recommend.train(r, "user_id", "business_id"))
    items, users = files.read_model(spark, str(tmp_path), "items", "users")
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    assert same(recommend.predict_by_items(r, q, 2, model=items), recommend.predict_by_items(r, q, 2))
    assert same(recommend.predict_by_users(r, q, 2, model=users), recommend.predict_by_users(r, q, 2))
    lsh = {tuple(x)[:2]: x.sim for x in recommend.train(r, "business_id", "user_id", lsh=(60, 1, 1)).collect()}
    exact = {tuple(x)[:2]: x.sim for x in items.collect()}
    assert lsh and lsh.items() <= exact.items()


def test_factorisation_takes_ids_of_any_size(spark):
    r = spark.createDataFrame([(3_000_000_000 + u, f"b{b}", float(u % 5 + 1)) for u in range(6) for b in range(4)], "user_id bigint, business_id string, stars double")
    p = recommend.factorise(r, spark.createDataFrame([(3_000_000_002, "b1"), (-1, "b1"), (3_000_000_002, "none")], "user_id bigint, business_id string"), rank=2, epochs=2).collect()
    assert len(p) == 3 and all(0 <= x.stars <= 5 for x in p)


def test_pairs_are_written_in_order(spark, tmp_path):
    files.write_pairs(spark.createDataFrame([(2, 3, 0.5), (1, 9, 0.1), (1, 2, 0.9)], "a int, b int, sim double").repartition(3), str(tmp_path / "p"))
    lines = [x for f in sorted((tmp_path / "p").glob("part-*")) for x in f.read_text().splitlines() if x[0] != "a"]
    assert lines == ["1,2,0.9", "1,9,0.1", "2,3,0.5"]


def test_neighbours_are_ranked_on_both_sides(spark):
    p = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (2, 3, 0.5)], "a int, b int, sim double")
    assert sorted(map(tuple, similarity.neighbours(p, 1).collect())) == [(1, 3, 0.9, 1), (2, 1, 0.5, 1), (3, 1, 0.9, 1)]


def test_edges_that_chance_does_not_explain(spark):
    rows = [(k, i) for k in range(6) for i in range(1000) if (k * 1000 + i) * 2654435761 % (1 << 32) >> 28 < 6]
    rows += [(k, 2000 + i) for k in (6, 7) for i in range(100)]
    assert [(r.a, r.b, r.common) for r in graph.surprising_edges(spark.createDataFrame(rows, "k int, i int"), "k", "i").filter("b > 5").collect()] == [(6, 7, 100)]


def test_paths_are_as_long_as_the_graph(spark):
    chain = edges(spark, *((i, i + 1) for i in range(24)))
    paths = graph.shortest_paths(chain, spark.createDataFrame([(0,)], "root bigint"))
    assert {(r.node, r.level) for r in paths.collect()} == {(i, i) for i in range(25)}


def test_points_come_in_chunks_of_files_in_order(spark, tmp_path):
    for name, at in (("b", 100), ("a", 0)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{at + i},{float(i % 2 * 50)},{float(i % 3)}\n" for i in range(40)))
    points = files.read_points(spark, str(tmp_path), 2)
    model = clustering.BFR(2, 2)
    for c in files.chunks(points):
        model.update(c)
    assert [r.point_id for r in points.filter("chunk = 'a.csv' and place < 3").orderBy("place").collect()] == [0, 1, 2]
    assert len(model.metrics) == 2 and model.result().count() == 80 and model.metrics[0][2] + model.metrics[0][4] + model.metrics[0][5] == 40
    files.write_clusters(model.result(), model.metric_rows(spark), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "metrics")).count() == 2
    ids = [int(x.split(":")[1].split(",")[0]) for f in sorted((tmp_path / "out" / "points").glob("part-*")) for x in f.read_text().splitlines()]
    assert ids == sorted(ids) and len(ids) == 80


def test_stop_words_and_objects(spark, tmp_path):
    (tmp_path / "stop").write_text("good\n\nthe\n")
    words = files.read_stopwords(spark, str(tmp_path / "stop"))
    assert words == ["good", "the"]
    r = spark.createDataFrame([("u", "2018-01-02", "good good the"), ("v", "2017-01-01", "good bad")], "user_id string, date string, text string")
    found = explore.explore(r, "2018", 1, 2, "exact", words)
    assert found["E"] == ["bad"]
    files.write_object(spark, found, str(tmp_path / "o"))
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0]) == found
