import corpus_pipeline as p
from pyspark.sql import functions as F

from orefield.llm.toxicity import toxicity

from ..oracle import SF
from . import cases
from .test_other import gapless, pieces_of


def written(df, path):
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def test_stages_equal_brute_force_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    a = written(p.drop_toxic(spark, docs, SF), str(tmp_path / "a"))
    kept = {r.doc_id for r in a.collect()}
    scored = toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r.doc_id for r in scored.filter(F.col("score") < p.REJECT).collect()}
    gone = {r.doc_id for r in docs.collect()} - kept
    assert sum(labels.get(d, 1) for d in gone) >= 0.8 * len(gone) and all(x.columns == docs.columns for x in (a,))
    b = written(p.drop_common_lines(spark, a, SF), str(tmp_path / "b"))
    rows = [(r.doc_id, r.text) for r in a.collect()]
    assert cases.plain((r.doc_id, r.text) for r in b.collect()) == cases.plain((d, t) for d, t, _, _ in cases.lines_dropped(rows))
    assert b.filter("n_chars != length(text)").isEmpty() and b.columns == docs.columns
    c = written(p.drop_near_copies(spark, b, SF), str(tmp_path / "c"))
    rows = [(r.doc_id, r.text) for r in b.collect()]
    assert sorted(r.doc_id for r in c.collect()) == sorted(d for d, _, k in cases.near_classes(rows, 5, 80) if d == k) and c.columns == docs.columns
    d = written(p.in_mixed_order(spark, c, SF), str(tmp_path / "d"))
    order = [r.source for r in d.orderBy(F.col("_metadata.file_name"), F.col("_metadata.row_index")).collect()]
    assert cases.plain(d.collect()) == cases.plain(c.collect()) and order != sorted(order)
    e = p.packed_in_order(spark, d, SF).collect()
    assert cases.plain((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in e) == cases.plain(pieces_of([(r.doc_id, r.text) for r in d.collect()]))
    gapless(e)


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", cases.texts()), ("empty", [])):
        docs = written(cases.documents(spark, rows), str(tmp_path / name))
        for k, (_, stage) in enumerate(p.STAGES):
            docs = written(stage(spark, docs, SF), str(tmp_path / f"{name}{k}"))
            if k < 4:
                assert docs.columns == cases.documents(spark, []).columns
        assert docs.isEmpty() == (not rows)


OWN = "score predicted held_out kept_text n_lines n_dropped mix_block mix_place at key class_id component_id sequence_id place part".split()


def test_stages_keep_columns_of_any_name_and_rows_of_equal_ids(spark, tmp_path):
    texts = [*cases.texts(), (5, cases.passage(1)), (5, cases.passage(2)), (3, cases.passage(1) + " x"), (None, cases.passage(2)), (None, cases.passage(77)), (None, cases.passage(77))]
    docs = spark.createDataFrame([(d, t, "ab"[i % 2], *[1000 + i] * len(OWN)) for i, (d, t) in enumerate(texts)], "doc_id bigint, text string, source string, " + ", ".join(f"{c} int" for c in OWN))
    now, rows = written(docs.repartition(3), str(tmp_path / "0")), [(d, t, 1000 + i) for i, (d, t) in enumerate(texts)]
    for k, (name, stage) in enumerate(p.STAGES[:4]):
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        now = written(out, str(tmp_path / str(k + 1)))
        found = now.collect()
        assert all({r[c] for c in OWN} == {r.score} for r in found)
        if name == "line_dedup":
            kept = cases.lines_dropped([(d, t) for d, t, _ in rows])
            rows = [(d, t if not x[3] else x[1], n) for (d, t, n), x in zip(rows, kept, strict=True)]
        elif name == "near_dedup":
            classes = cases.near_row_classes([(d, t) for d, t, _ in rows], 5, 80)
            best = {}
            for (d, t, n), c in zip(rows, classes, strict=True):
                if c is not None:
                    best.setdefault(c, []).append((d is None, d or 0, n))
            # Of a class one row, of the smallest doc_id; which of those that share it is open.
            assert all(sum(r.score in {n for *_, n in x} for r in found) == 1 and {r.doc_id for r in found if r.score in {n for *_, n in x}} == {None if min(x)[0] else min(x)[1]} for x in best.values())
            left = {r.score for r in found}
            assert all(n in left for (_, _, n), c in zip(rows, classes, strict=True) if c is None)
            rows = [r for r in rows if r[2] in left]
        assert cases.plain((r.doc_id, r.text, r.score) for r in found) == cases.plain(rows)
    e = p.packed_in_order(spark, now, SF).collect()
    assert cases.plain((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in e) == cases.plain(pieces_of([(d, t) for d, t, _ in rows]))
    gapless(e)
    assert p.drop_near_copies(spark, spark.createDataFrame([(3, "y"), (5, "y"), (5, "x")], "doc_id bigint, text string"), SF).count() == 2
