import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orefield.llm import mixing, packing, queries, toxicity
from orefield.llm.html_text import extract, html_text
from orefield.llm.topk_search import ordered, products, topk_search

from ..oracle import SF
from . import cases


def pieces_of(rows):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(queries.word_tokenizer()), []
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(d, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    return out


def gapless(found, capacity=4096):
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= capacity
    return len(by)


def test_packing_on_odd_rows(spark):
    rows = [*cases.texts(), (400, "<|endoftext|> Don't 12ab ²x ÉÀ é ... a.b! 数据。")]
    got = packing.best_fit_packing(cases.documents(spark, rows), queries.word_tokenizer()).collect()
    assert cases.plain((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == cases.plain(pieces_of(rows))
    assert gapless(got) == packing.lower_bound(np.array([r.length for r in got]))
    assert packing.best_fit_packing(cases.documents(spark, []), queries.word_tokenizer()).isEmpty()


def test_packing_query_equals_the_plain_tokenizer_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op1_best_fit_packing(spark, SF).collect()
    assert cases.plain((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == cases.plain(pieces_of(docs))
    assert gapless(got) <= packing.lower_bound(np.array([r.length for r in got])) + 1


def test_very_long_documents_leave_one_piece_to_pack(spark):
    rows = [(i, "word " * n) for i, n in enumerate((4096 * 9, 5, 4095, 4096 * 3 + 7, 4094))]
    got = packing.best_fit_packing(cases.documents(spark, rows), queries.word_tokenizer(), part=2).collect()
    assert cases.plain((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == cases.plain(pieces_of(rows))
    assert gapless(got) == packing.lower_bound(np.array([r.length for r in got])) and all(r.offset == 0 for r in got if r.length == 4096)


def test_packing_over_many_partitions_stays_near_the_bound(spark):
    got = packing.best_fit_packing(spark.read.parquet(f"{SF}/documents.parquet"), queries.word_tokenizer(), part=40).collect()
    assert gapless(got) <= packing.lower_bound(np.array([r.length for r in got])) * 1.02 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_bounds_hold_for_any_sizes(sizes):
    x = np.array(sizes, np.int64)
    bins = packing.best_fit_decreasing(x, 50)
    fill = np.bincount(bins, weights=x) if len(x) else np.zeros(0)
    assert packing.lower_bound(x, 50) <= len(fill) and (fill <= 50).all() and len(fill) <= max(1.5 * packing.lower_bound(x, 50), 1)


def test_topk_equals_brute_force_with_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [1.0]), (100, [-1.0, 0.25]), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (8, [])]
    got = topk_search(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, score int, rank int"), F.col("vec_id") % 50 == 0, 3, block=2, shard=2)
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {i: tuple(v) for i, v in good if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(q[1], v, strict=True)), i) for i, v in good if i != q[0] and len(v) == len(q[1]))[:3]
        want += [(q[0], k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert cases.plain((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == cases.plain(want)
    big = np.array([[2.0**40, 1]]), np.array([[2.0**40, 1]])
    assert products(*big)[0, 0] == 2**80 + 1
    assert products(np.array([[1.5e308, -0.3]]), np.array([[1.0, 1.0]]), 256)[0, 0] == int(1.5e308) * 2**16 + -77 * 256
    v = [-(2**70), -(2**63), -1, 0, 5, 2**64, 2**64 + 1, 2**900]
    assert sorted(v, key=ordered) == v
    huge = spark.createDataFrame([(0, [1e16, 1.0]), (1, [1e16, 2.0]), (2, [1e16, 3.0]), (3, [1e300, 0.0]), (4, [-1e16, 0.0])], "vec_id bigint, embedding array<double>")
    found = topk_search(huge, F.col("vec_id") == 0, 4, shard=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(3, 2**63 - 1), (2, 2**63 - 1), (1, 2**63 - 1), (4, -(2**63))]


def test_topk_shuffles_queries_and_lists_but_no_matrix(spark):
    m = np.random.default_rng(6).normal(0, 0.125, (4000, 64)).astype(np.float32)
    m[1000:1400] = m[0]  # copies: ties by vec_id, within tiles and across them
    table = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id bigint, embedding array<float>").repartition(8).localCheckpoint()
    written = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    before = written()
    got = topk_search(table, F.col("vec_id") % 50 == 0).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    assert 0 < sum(n for i, n in written().items() if i not in before) < m.nbytes / 2
    v = np.floor(256 * m.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 4000, 50):
        s = v @ v[q]
        want += [(q, n + 1, int(c), int(s[c])) for n, c in enumerate([c for c in np.lexsort((np.arange(4000), -s)) if c != q][:5])]
    assert cases.plain(got) == cases.plain(want)


def test_html(spark):
    page = "<html><head><title>t</title><style>x</style></head><body><h1>A &amp; B</h1><p>one<p>two <b>bold</b><ul><li>x<li>y</ul><ol start=3><li>z</ol><table><tr><th>k<th>val<tr><td>long key<td>1</table><div style='display:none'>no</div><span hidden>no</span><pre>a\n  b</pre><script>no</script>end"
    assert html_text(page).split("\n") == ["A & B", "", "one", "", "two bold", "", "- x", "- y", "", "3. z", "", "k         val", "long key  1", "", "a", "  b", "", "end"]
    assert html_text("") == "" and html_text("<b>x") == "x" and html_text("</p></div>x<!-- c") == "x" and html_text("a < b") == "a < b"
    assert html_text("<div>" * 3000 + "deep") == "deep"
    got = extract(spark.createDataFrame([(1, None, "t"), (None, "<p>x", None), (2, "", "u")], "page_id bigint, html string, page string"))
    assert got.columns == ["page_id", "page", "text"] and cases.plain(got.collect()) == cases.plain([(1, "t", ""), (None, None, "x"), (2, "u", "")])
    assert queries.op4_html_extraction(spark, SF).filter("text rlike '<script|</div>'").isEmpty()


def test_words_are_restored():
    rows = ["the idiot is a stupid loser and the weather is nice today " * 30, "a pathetic moron walks home"]
    n = np.zeros(toxicity.SYMBOLS**3)
    for t in rows:
        s = np.concatenate([[0, 0], toxicity.symbols(np.frombuffer(t.encode(), np.uint8)), [0]]).astype(int)
        np.add.at(n, (s[:-2] * toxicity.SYMBOLS + s[1:-1]) * toxicity.SYMBOLS + s[2:], 1)
    n = n.reshape((toxicity.SYMBOLS,) * 3)
    r = toxicity.Restorer(np.log((n + 0.01) / (n.sum(2)[:, :, None] + 0.01 * toxicity.SYMBOLS)).astype(np.float32))
    assert r.decode("1d10t") == "idiot" and r.decode("st.u.p.id") == "stupid" and r.decode("looooser") == "loser" and r.decode("l o s e r") == "loser"
    long = "1d10t." * 2000
    assert r.decode(long).replace(" ", "").count("idiot") == 2000
    assert toxicity.token_words("455", toxicity.Restorer(np.array(r.model), 0.0)) == []
    assert toxicity.word_features("w" * 41) and toxicity.word_features("w")


def test_words_of_signs_alone_are_read_if_likely():
    n = np.full((toxicity.SYMBOLS,) * 3, 0.01)
    s = np.concatenate([[0, 0], toxicity.symbols(np.frombuffer(b"sass a pass in the lass " * 50, np.uint8)), [0]]).astype(int)
    np.add.at(n, (s[:-2], s[1:-1], s[2:]), 1)
    model = np.log(n / n.sum(2)[:, :, None])
    r = toxicity.Restorer(model, float((n * model).sum() / n.sum()))
    assert toxicity.token_words("@$$", r) == ["ass"] or toxicity.token_words("$@$$", r) == ["sass"]
    assert toxicity.token_words("90210", r) == [] and toxicity.token_words("|", r) == [] and toxicity.token_words("--", r) == []


@pytest.mark.parametrize("sf,least", [("/root/testdata/sf0.01", 0.95), ("/root/testdata/sf0.1", 0.98)])
def test_toxicity_held_out_accuracy(spark, sf, least):
    got = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) == h for d, h in zip(got.doc_id, got.held_out, strict=True))
    rank = held.score.rank()
    n1 = int(held.toxic.sum())
    assert (rank[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(held) - n1)) > least
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()


def test_toxicity_on_odd_rows(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([(4, None), (None, 1), (5, 1), (5, 0)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, none)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").isEmpty()
    assert set(docs.columns) <= set(got.columns)
    assert toxicity.toxicity(cases.documents(spark, []), none).isEmpty()


def test_mix_deviates_by_less_than_a_block(spark):
    rows = [(i, "x") for i in range(600)]
    docs = cases.documents(spark, rows).withColumn("source", F.when(F.col("doc_id") < 400, "big").when(F.col("doc_id") < 560, "mid"))
    got = mixing.mix(docs, {"big": 0.6, "mid": 0.3, "": 0.1}, block=4)
    assert got.columns == [*docs.columns, "mix_block", "mix_place"]
    found = got.orderBy("mix_place").collect()
    assert sorted(r.doc_id for r in found) == list(range(600)) and len({r.mix_place for r in found}) == 600
    first = {}
    for r in found:
        first.setdefault(r.mix_block, r.source)
    blocks, share, seen = [first[t] for t in sorted(first)], {"big": 0.6, "mid": 0.3, None: 0.1}, Counter()
    for t, s in enumerate(blocks[:90], 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * w) < 1 for x, w in share.items())
    assert mixing.mix(cases.documents(spark)).count() == len(cases.texts()) and mixing.mix(cases.documents(spark, [])).isEmpty()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.sampled_from([1 / 3, 0.0001, 0.05, 0.7, 2.5, 1e-9])), min_size=1, max_size=8))
def test_mix_keeps_to_weights_of_any_size_after_sources_have_run_out(sources):
    blocks, rate = [b for b, _ in sources], mixing.rates([w for _, w in sources])
    done, fluid = [0] * len(blocks), [Fraction(0)] * len(blocks)
    for i in mixing.order(blocks, rate):
        done[i] += 1
        left = Fraction(1)
        while left:  # serve one more block in proportion to the weights
            live = [k for k, b in enumerate(blocks) if fluid[k] < b]
            step = min([left, *((blocks[k] - fluid[k]) * sum(rate[x] for x in live) / rate[k] for k in live)])
            total = sum(rate[x] for x in live)
            for k in live:
                fluid[k] += step * rate[k] / total
            left -= step
        assert all(abs(d - f) < 1 for d, f in zip(done, fluid, strict=True))
    assert done == blocks


def test_mix_deviates_by_less_than_a_block_after_many_blocks():
    blocks, rate = [20_000] + [3000] * 19, mixing.rates([1 / 3] + [2 / 57] * 19)
    seen, total = 0, sum(rate)
    for t, i in enumerate(mixing.order(blocks, rate), 1):
        seen += i == 0
        if t <= 50_000:  # all sources last
            assert abs(seen * total - t * rate[0]) < total
    assert mixing.rates([0.0001, 0.9999]) == [1, 9999]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=6))
def test_every_block_has_its_own_time(sources):
    blocks, quota = [b for b, _ in sources], [q for _, q in sources]
    times = []
    for _i, _first, n, base, size, t in mixing.phases(blocks, quota):
        times += [base + k // len(t) * size + t[k % len(t)] for k in range(n)]
    assert sorted(times) == list(range(sum(blocks)))


def test_mix_takes_thousands_of_sources(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("site"), F.pmod("id", F.lit(3000))).alias("source"))
    found = mixing.mix(docs, block=1).collect()
    assert sorted(r.doc_id for r in found) == list(range(9000)) and sorted(r.mix_place for r in found) == list(range(9000))


def test_large_schedules_are_joined(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, "a").when(F.col("id") % 3 == 0, "b").alias("source"))
    small = cases.plain(mixing.mix(docs, block=2).collect())
    monkeypatch.setattr(mixing, "SMALL", -1)
    assert "BroadcastHashJoin" not in mixing.mix(docs, block=2)._jdf.queryExecution().optimizedPlan().toString() and cases.plain(mixing.mix(docs, block=2).collect()) == small


def test_the_mixing_query_keeps_every_document_in_its_place(spark):
    found = queries.op8_mix_sources(spark, SF).orderBy("mix_place").collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.source for r in found} == docs and len({r.mix_place for r in found}) == len(docs)
    sizes = Counter(docs.values())
    names = sorted(sizes, key=lambda x: x or "")
    blocks, turn = [-(-sizes[s] // mixing.BLOCK) for s in names], []
    for i in mixing.order(blocks, mixing.rates([sizes[s] ** 0.5 for s in names])):
        turn.append(names[i])
    assert all(turn[r.mix_block] == r.source for r in found)


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(cases.documents(spark))
