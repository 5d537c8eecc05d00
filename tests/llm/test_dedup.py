import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orefield.llm import exact_dedup as exact
from orefield.llm import near_dedup as near
from orefield.llm import queries, suffix_dedup
from orefield.llm.line_dedup import line_dedup
from orefield.llm.substring_dedup import from_small_numbers, small_numbers, substring_dedup
from orefield.llm.suffix_dedup import passages_removed, repeated_passages

from ..oracle import SF, duck, rows
from . import cases


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF)) == duck(queries.ORACLES[name])


def test_exact_dedup_on_odd_rows(spark):
    got = exact.exact_dedup(cases.documents(spark)).collect()
    want = {}
    for d, t in cases.texts():
        want.setdefault(t or "", []).append(d)
    assert len(got) == len(cases.texts()) and sum(r.kept for r in got) == len(want)
    by = {cases.sha(t): (max((d for d in ids if d is not None), default=None), len(ids)) for t, ids in want.items()}
    assert all((r.keep_id, r.group_size) == by[r.text_sha256] for r in got)
    assert exact.exact_dedup(cases.documents(spark, [])).isEmpty()


def test_fingerprints_compose_and_huge_texts_go_by_chunks(spark):
    a, b = b"x" * 100_000, "é".encode() * 70_000
    assert exact.combine(exact.fingerprint(a), exact.fingerprint(b)) == exact.fingerprint(a + b)
    assert exact.fingerprint(b"\0") != exact.fingerprint(b"\0\0")
    docs = spark.createDataFrame([(1, "ab" * 3_000_000), (2, "ab" * 3_000_000), (3, "ab" * 2_999_999 + "ac")], "doc_id bigint, text string")
    parts = exact.exact_dedup(docs, huge=1 << 20).orderBy("doc_id").collect()
    assert [(r.keep_id, r.kept) for r in parts] == [(2, False), (2, True), (3, True)]
    assert {r.n_bytes for r in exact.fingerprints(docs, huge=1 << 20).collect()} == {6_000_000}


def test_exact_dedup_survives_colliding_fingerprints(spark, monkeypatch):
    real = exact.fingerprints
    monkeypatch.setattr(exact, "fingerprints", lambda docs, huge: real(docs, huge).withColumns({"h1": F.lit(0).cast("bigint"), "h2": F.lit(0).cast("bigint")}))
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab")], "doc_id bigint, text string")
    assert [(r.doc_id, r.keep_id, r.group_size) for r in exact.exact_dedup(docs).orderBy("doc_id").collect()] == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


def test_line_dedup_on_odd_rows(spark):
    docs = cases.documents(spark)
    got = line_dedup(docs)
    assert got.columns == [*docs.columns, "kept_text", "n_lines", "n_dropped"]
    assert cases.plain((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()) == cases.plain(cases.lines_dropped(cases.texts()))
    assert any(r.n_dropped for r in got.collect()) and line_dedup(cases.documents(spark, [])).isEmpty()


def test_substring_dedup_on_odd_rows(spark):
    assert cases.plain(substring_dedup(cases.documents(spark)).collect()) == cases.plain(cases.windows_removed(cases.texts()))
    assert substring_dedup(cases.documents(spark, [])).isEmpty()
    x = np.array([0, 254, 255, 256, 700, 3])
    assert from_small_numbers(small_numbers(x)).tolist() == x.tolist()


def test_substring_dedup_sorts_windows_range_by_range(spark, monkeypatch):
    from orefield.llm import substring_dedup as sub

    monkeypatch.setattr(sub, "SORTED", 1000)
    monkeypatch.setattr(sub, "PART", 100_000)
    assert cases.plain(substring_dedup(cases.documents(spark)).collect()) == cases.plain(cases.windows_removed(cases.texts()))


def test_substring_dedup_equals_brute_force_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert cases.plain(queries.op5_substring_dedup(spark, SF).collect()) == cases.plain(cases.windows_removed(docs))


def test_near_duplicates_on_odd_rows(spark):
    got = near.near_duplicates(cases.documents(spark), shingle=3, percent=85, leaf=4)  # small leaves: large ones are dealt into blocks
    assert cases.plain((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == cases.plain(cases.near_classes(cases.texts(), 3, 85))
    assert near.near_duplicates(cases.documents(spark, [])).isEmpty()


def test_near_duplicates_equal_brute_force_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op10_minhash_near_dedup(spark, SF).collect()
    assert cases.plain((r.doc_id, r.n_shingles, r.component_id) for r in got) == cases.plain(cases.near_classes(docs, 3, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_a_hopeful_mate_are_not_shuffled(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1 << 62, 4000))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, texts[7] + " more"), (61, texts[9])], "doc_id bigint, text string")
    before = shuffled(spark)
    got = near.near_duplicates(docs, shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got if not r.kept} == {60: 7, 61: 9}
    assert shuffled(spark) - before < sum(map(len, texts)) / 5  # squeezed they have nearly half


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_among_keeps_the_rows_of_the_ids_and_no_others(spark, most):
    ids = [0, 1, 7, 8, 32767, 32768, 65535, 65536, 1 << 33, (1 << 33) + 9, (5 << 33) + 40000]
    df = spark.createDataFrame([(i, str(i)) for x in ids for i in (x, x + 2)], "vid bigint, t string")
    got = near._among(df, spark.createDataFrame([(i,) for i in [*ids, *ids, 1 << 50]], "vid bigint"), most).collect()
    assert sorted((r.vid, r.t) for r in got) == sorted((i, str(i)) for x in ids for i in (x, x + 2) if i in ids)


def test_members_of_small_nodes_are_not_shuffled_to_find_the_large_ones(spark, monkeypatch):
    path = lambda i, level: 7 * level if i < 30 and level < 2 else 1000 * (level + 1) + i  # noqa: E731  one large node on two levels
    sets = spark.createDataFrame([(i, 10, [path(i, level) for level in range(4)]) for i in range(900)], "vid bigint, size bigint, path array<bigint>")
    took, found = [], []
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for most in (near.NODES, 0):
            monkeypatch.setattr(near, "NODES", most)
            at = shuffled(spark)
            found.append(sorted(map(tuple, near._leaves(sets, 1, 4, 20).collect())))
            took.append(shuffled(spark) - at)
    finally:
        spark.conf.set(threshold, before)
    assert found[0] == found[1] and took[0] < 0.8 * took[1]


def test_near_copies_at_the_threshold_are_linked_and_those_below_are_not(spark):
    r = np.random.default_rng(8)
    rows = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(300)]
        for c in range(8):
            own = list(base)
            for at in r.integers(0, 300, int(r.integers(2, 14))):  # around 0.85 of 3-word shingles at 7 changes
                own[at] = f"g{g}c{c}x{at}"
            rows.append((100 * g + c, " ".join(own)))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), shingle=3, percent=85).collect()
    want = cases.near_classes(rows, 3, 85)
    assert 60 < len({c for *_, c in want}) < 300
    assert cases.plain((x.doc_id, x.n_shingles, x.component_id) for x in got) == cases.plain(want)


def test_blocks_of_large_texts_are_compared_part_by_part(spark, monkeypatch):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in r.integers(0, 10**9, 3000)]
    texts = [" ".join([*words[: 3000 - 10 * i], *(f"x{i}y{j}" for j in range(10 * i))]) for i in range(12)]
    codec = pa.Codec("zstd")
    z, sizes = [codec.compress(t.encode(), asbytes=True) for t in texts], [len(t.encode()) for t in texts]

    def classes(edges):
        up = list(range(12))
        for a, b in edges * 12:
            up[a] = up[b] = min(up[a], up[b])
        return up

    assert classes(near._joined(z, sizes, 5, 92)) == classes(near._joined(z, sizes, 5, 92, most=40_000)) == [0] * 12
    assert near._joined(z, sizes, 5, 100, most=40_000) == []
    monkeypatch.setattr(near, "BYTES", 60_000)  # leaves of three texts are dealt into blocks
    got = near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 5, 92).collect()
    assert {x.component_id for x in got} == {0}


def test_equal_sets_of_other_texts_are_linked(spark):
    a = " ".join(f"w{i}" for i in range(50))
    got = near.near_duplicates(spark.createDataFrame([(4, a), (5, f"{a} {a}"), (6, a.upper()), (7, f"{a}  {a}")], "doc_id bigint, text string"), 1, 100).collect()
    assert {x.component_id for x in got} == {4}


def test_shared_counts_and_forests():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 500, 40_000)]
    sets += [sets[2][::2], sets[1]]
    got = near.shared_counts(sets, 512)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    linked = np.eye(5, dtype=bool)
    linked[0, 3] = linked[3, 0] = linked[3, 4] = linked[4, 3] = linked[0, 4] = linked[4, 0] = True
    assert len(near.forest(linked)) == 2
    assert near.trees_for(0.85, 0.999) >= 10


def test_repeated_passages_are_found_and_real(spark):
    docs = dict((d, t) for d, t in cases.texts() if d is not None)
    found = repeated_passages(cases.documents(spark))
    got = found.collect()
    for r in got:
        a, b = cases.words(docs[r.doc_id])[r.start : r.start + r.n_words], cases.words(docs[r.source_id])[r.source_start : r.source_start + r.n_words]
        assert a == b and len(a) >= 50 and r.source_id < r.doc_id
    assert {r.doc_id for r in got} == {7} | {100 + i for i in (3, 6, 9, 12)} | {201, 202, 203, 204, 205}
    assert {r.n_words for r in got if r.doc_id == 7} == {30_000}
    left = {r.doc_id: r for r in passages_removed(cases.documents(spark).filter("doc_id is not null"), found).collect()}
    assert left[7].kept_text == "" and cases.passage(1) not in left[103].kept_text and cases.passage(1) in left[100].kept_text
    assert repeated_passages(cases.documents(spark, [])).isEmpty()
    with pytest.raises(ValueError):
        repeated_passages(cases.documents(spark), min_words=20)


def test_repeated_passages_cover_what_brute_force_finds_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    text, got, n_rows = {d: cases.words(t) for d, t in docs}, {d: set() for d, _ in docs}, 0
    for r in queries.op2_suffix_array_dedup(spark, SF).collect():
        assert text[r.doc_id][r.start : r.start + r.n_words] == text[r.source_id][r.source_start : r.source_start + r.n_words]
        assert r.source_id < r.doc_id and r.n_words >= 50
        got[r.doc_id].update(range(r.start, r.start + r.n_words))
        n_rows += 1
    assert {d: x for d, x in got.items() if x} == {d: x for d, x in cases.windows_covered(docs, 50).items() if x} and n_rows


def test_passages_of_a_large_group_of_near_copies_are_few_and_whole(spark):
    r = np.random.default_rng(5)
    text, rows = [f"w{i}" for i in range(170)], []
    for d in range(300):
        own = list(text)
        for at in r.integers(0, 170, d % 3):
            own[at] = f"x{d}y{at}"
        rows.append((d, " ".join(own)))
    found = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    got = {d: set() for d, _ in rows}
    for x in found:
        got[x.doc_id].update(range(x.start, x.start + x.n_words))
    assert got == cases.windows_covered(rows, 50) and len(found) < 4 * len(rows)


def test_matches_are_maximal_and_contained_ones_go():
    a, b = np.array([9, 1, 2, 3, 4, 8]), np.array([7, 7, 1, 2, 3, 4])
    assert suffix_dedup.match(a, b, 2, 3) == (2, 4) and suffix_dedup.match(a, b, 0, 0) == (0, 0)
    big = np.arange(5000)
    assert suffix_dedup.match(big, big, 700, 700) == (0, 5000)
    for order in itertools.permutations([(0, 60, 3, 0), (5, 50, 1, 5), (0, 55, 2, 9), (30, 60, 1, 1), (100, 50, 4, 4)]):
        found = suffix_dedup.Longest()
        for x in order:
            found.add(x)
        assert found.runs == [(0, 60, 3, 0), (30, 60, 1, 1), (100, 50, 4, 4)] and found.holds(40, 90) and not found.holds(20, 61)


def test_passages_between_shorter_overlapping_ones_are_found(spark):
    r = np.random.default_rng(11)
    rows, want = [], {}
    for g in range(8):
        text, n = [f"g{g}w{i}" for i in range(150)], int(r.integers(50, 62))
        fill = lambda t: [f"g{g}f{t}x{i}" for i in range(20)]  # noqa: B023, E731
        rows.append((g, " ".join(fill("a") + text[50 : 50 + n] + fill("b"))))
        # Any 49 words of the last document in a row stand in another document, too few on their own.
        rows += [(100 + 200 * g + i, " ".join(fill(f"c{i}") + text[i : i + 49] + fill(f"d{i}"))) for i in range(102)]
        rows.append((10_000 + g, " ".join(text)))
        want[10_000 + g] = (50, n, g, 20)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).filter("doc_id >= 10000").collect()
    assert {x.doc_id: (x.start, x.n_words, x.source_id, x.source_start) for x in got} == want


def test_nearest_smaller_suffixes_over_any_borders():
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 40))
        gram = np.sort(r.integers(0, 3, n))
        key = np.sort(r.integers(0, 5, n) + 10 * gram)
        order = np.lexsort((doc := r.integers(0, 12, n), key))
        doc = doc[order]
        smaller = lambda i: {(i, next((j for j in w if gram[j] == gram[i] and doc[j] < doc[i]), None)) for w in (range(i - 1, -1, -1), range(i + 1, n))} - {(i, None)}  # noqa: B023, E731
        cuts = sorted({0, n, *r.integers(0, n + 1, 4).tolist()})
        got, parts = set(), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            left, right = suffix_dedup.nearest_smaller(doc[a:b].tolist(), gram[a:b].tolist())
            got |= {(a + i, a + j) for x in (left, right) for i, j in enumerate(x) if j >= 0}
            ends: tuple = ([], [])
            for kind, i in suffix_dedup._borders(doc[a:b], gram[a:b], key[a:b]):
                ends[kind - 1].append((a + i, int(doc[a + i]), 0, int(gram[a + i])))
            parts.append((*ends, bool(gram[a] == gram[b - 1])))
        got |= {(x[0], y[0]) for x, y in suffix_dedup.across(parts)}
        # The nearest itself, or one with the same words (and so as much in common) in its place.
        for i in range(n):
            for _, j in smaller(i):
                assert any(x == i and (y == j or key[y] == key[j]) and doc[y] < doc[i] for x, y in got) or any(x != i and key[x] == key[i] and doc[x] < doc[i] for x in range(n))


def test_hashes_of_ranges_don_t_depend_on_their_place():
    h = np.random.default_rng(5).integers(0, 1 << 63, 50, dtype=np.uint64)
    x = np.concatenate([h, h[:7], h])
    sums, back = suffix_dedup._prefixes(x)
    at = lambda a, b: suffix_dedup._ranged(sums, back, np.array([a]), np.array([b]))[0]
    assert at(3, 20) == at(60, 77) != at(4, 20) and at(0, 0) == at(9, 9) and at(0, 107) != at(1, 107)
