import pytest
from pyspark.sql import functions as F

from orefield.plans import catalogue

from .oracle import SF, duck, rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert rows(catalogue.QUERIES[name](spark, SF)) == duck(catalogue.ORACLES[name])


def test_entry_has_rows_and_needs_no_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["category", "avg_stars"]


def test_lsh_pairs_are_among_the_exact_ones_and_most_of_them(spark):
    exact = {(r.a, r.b, r.sim) for r in catalogue.QUERIES["jaccard_exact"](spark, SF).collect()}
    found = {(r.a, r.b, r.sim) for r in catalogue.QUERIES["minhash_lsh_pairs"](spark, SF).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)


def test_factorisation_beats_the_global_mean_on_ratings_it_has_not_seen(spark):
    from pyspark.sql import functions as F

    from orefield.operators import recommend

    # Ratings with structure: users like one half of the businesses.
    r = spark.range(60).crossJoin(spark.range(40).withColumnRenamed("id", "b")).select(F.col("id").alias("user_id"), F.col("b").alias("business_id"), F.when(F.col("id") % 2 == F.col("b") % 2, 5.0).otherwise(1.0).alias("stars"))
    held = r.filter(F.pmod(F.xxhash64("user_id", "business_id"), F.lit(5)) == 0)
    p = recommend.factorise(r.join(held, ["user_id", "business_id"], "left_anti"), held.select("user_id", "business_id"), rank=4)
    rmse = p.withColumnRenamed("stars", "p").join(held, ["user_id", "business_id"]).agg(F.sqrt(F.avg((F.col("p") - F.col("stars")) ** 2))).first()[0]
    assert rmse < 1.0


@pytest.mark.parametrize("name,key,by", [("item_model_lsh", "business_id", "user_id"), ("user_model_lsh", "user_id", "business_id")])
def test_models_by_lsh_hold_most_alike_pairs_of_the_exact_ones(spark, name, key, by):
    from orefield.operators import recommend, similarity
    from orefield.sources.tables import ratings

    r = ratings(spark, SF)
    pairs = lambda df: {(x.a, x.b) for x in df.collect()}
    exact, found = pairs(recommend.train(r, key, by)), pairs(catalogue.QUERIES[name](spark, SF))
    alike = exact & pairs(similarity.jaccard(r, key, by, 0.05))
    assert found <= exact and len(found & alike) >= 0.9 * len(alike) > 0


def test_partition_stats_add_up(spark):
    r = catalogue.QUERIES["partition_stats"](spark, SF).collect()
    assert len(r) == 16 and sum(x.n_items for x in r) == catalogue.QUERIES["explore_counts"](spark, SF).first().n


def test_bfr_places_every_point_once_and_its_metrics_add_up(spark):
    model = catalogue._bfr(spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert sum(model.metrics[-1][i] for i in (2, 4, 5)) == n
    placed = model.result()
    assert placed.count() == n == placed.select("point_id").distinct().count()


def test_every_group_has_one_community(spark):
    r = catalogue.QUERIES["girvan_newman"](spark, SF).collect()
    assert len({x.node for x in r}) == len(r) and -0.5 <= r[0].q <= 1
    members = [m for x in catalogue.QUERIES["lpa_communities"](spark, SF).collect() for m in x.members.split(",")]
    assert sorted(map(int, members)) == sorted(x.node for x in r)


def test_every_request_is_answered(spark):
    rated = spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = rated.select("o_custkey", "l_partkey").distinct().count() + 3
    for name in ("mf_predict", "cf_item_predict", "cf_user_predict"):
        assert catalogue.QUERIES[name](spark, SF).count() == asked
