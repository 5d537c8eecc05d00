"""The queries on the driver's tables, by name, and the SQL that they are compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import FM_HASHES, FM_PRIME, FM_RANGE
from ..functions.text import BLANK, BLANKS, STOP_TEXT, STOPWORDS
from ..operators import clustering, content, explore, graph, itemsets, keyed, recommend, similarity, sketches
from ..session import durable, shared_folder, written
from ..sources.files import read_model, write_model
from ..sources.tables import DIMENSIONS, baskets_long, businesses, ctes, events, points, ratings, reviews, sellers, table, text_reviews
from ..streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL over the driver's tables and the views it needs."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"with {ctes(*needs)}{',' if needs and sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if needs else sql
        return f

    return add


# Exploration


@query("select count(*) as n from reviews", ("reviews",))
def explore_counts(spark, sf_dir):
    return explore.row_count(reviews(spark, sf_dir))


@query("select count(*) as n from reviews where contains(strftime(review_ts, '%Y-%m-%d'), '1995')", ("reviews",))
def explore_rows_in_year(spark, sf_dir):
    return explore.rows_with_date(reviews(spark, sf_dir), "review_ts", "1995")


@query("select count(distinct user_id) as n from reviews", ("reviews",))
def explore_distinct_users(spark, sf_dir):
    return explore.distinct_keys(reviews(spark, sf_dir), "user_id")


@query("select user_id, count(*) as n from reviews group by 1 order by n desc, user_id limit 20", ("reviews",))
def explore_top_users(spark, sf_dir):
    return explore.top_keys(reviews(spark, sf_dir), "user_id", 20)


_WORDS = f"+ w as (select unnest(list_transform(string_split_regex(text, '{BLANK}'), lambda t: translate(lower(t), '([,.!?:;])', ''))) as word from text_reviews) select word, count(*) as n from w where word <> '' and {{}} group by 1 order by n desc, word limit 50"


@query(_WORDS.format(f"not contains('{STOP_TEXT}', word)"), ("text_reviews",))
def explore_top_words_substring_stop(spark, sf_dir):
    return explore.top_words(text_reviews(spark, sf_dir), 50, "substring")


_STOP_LIST = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(_WORDS.format(f"word not in ({_STOP_LIST})"), ("text_reviews",))
def explore_top_words_exact_stop(spark, sf_dir):
    return explore.top_words(text_reviews(spark, sf_dir), 50, "exact")


@query(
    f"""+ c as (select business_id, trim(unnest(string_split(categories, ',')), '{BLANKS}') as category from businesses where categories is not null)
    select category, round(avg(stars), 6) as avg_stars from c join reviews using (business_id) group by 1 order by avg_stars desc, category limit 20""",
    ("reviews", "businesses"),
)
def category_avg_stars(spark, sf_dir):
    return explore.average_stars(reviews(spark, sf_dir), businesses(spark, sf_dir), 20)


@query("select business_id, count(*) as n from reviews group by 1 having count(*) > 35", ("reviews",))
def business_min_reviews(spark, sf_dir):
    return explore.busy_keys(reviews(spark, sf_dir), "business_id", 35)


@query()
def partition_stats(spark, sf_dir):
    return explore.partition_stats(reviews(spark, sf_dir), "business_id", 16)


@query("select user_id, seller_id as business_id from reviews join sellers using (seller_id) where state = 'ASIA'", ("reviews", "sellers"))
def state_user_business(spark, sf_dir):
    asia = sellers(spark, sf_dir).filter("state = 'ASIA'").select("seller_id")
    return reviews(spark, sf_dir).select("user_id", "seller_id").join(asia, "seller_id").select("user_id", F.col("seller_id").alias("business_id"))


# Joins, set operations, windows


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def join_semi_seen(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_semi")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def join_anti_unseen(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("select p_partkey, round(coalesce(m, 3.0), 6) as stars from part left join (select business_id, avg(stars) as m from reviews where stars > 4 group by 1) on p_partkey = business_id", ("reviews",))
def join_left_fallback(spark, sf_dir):
    mean = reviews(spark, sf_dir).filter("stars > 4").groupBy(F.col("business_id").alias("p_partkey")).agg(F.avg("stars").alias("m"))
    return table(spark, sf_dir, "part").select("p_partkey").join(mean, "p_partkey", "left").select("p_partkey", F.round(F.coalesce("m", F.lit(3.0)), 6).alias("stars"))


_OVERLAPS = "+ one as (select distinct seller_id as k, user_id as i from reviews), pairs as (select x.k as a, y.k as b, count(*) as common from one x join one y on x.i = y.i and x.k < y.k group by 1, 2)"


@query(f"{_OVERLAPS} select a, b, common from pairs where common >= 20", ("reviews",))
def join_theta_pairs(spark, sf_dir):
    return similarity.overlaps(reviews(spark, sf_dir), "seller_id", "user_id", 20)


def _users(spark, sf_dir, stars):
    return reviews(spark, sf_dir).filter(F.col("stars") == stars).select("user_id", "seller_id")


_SETS = "select user_id, seller_id from reviews where stars = 5 {} select user_id, seller_id from reviews where stars = 1"


@query(_SETS.format("union"), ("reviews",))
def set_union(spark, sf_dir):
    return _users(spark, sf_dir, 5).union(_users(spark, sf_dir, 1)).distinct()


@query(_SETS.format("intersect"), ("reviews",))
def set_intersect(spark, sf_dir):
    return _users(spark, sf_dir, 5).intersect(_users(spark, sf_dir, 1))


@query(_SETS.format("except"), ("reviews",))
def set_except(spark, sf_dir):
    return _users(spark, sf_dir, 5).subtract(_users(spark, sf_dir, 1))


@query(
    """+ s as (select user_id, list(distinct seller_id) filter (where stars = 5) as a, list(distinct seller_id) filter (where stars = 1) as b from reviews group by 1)
    select user_id, len(list_intersect(a, b)) as n_both, len(list_distinct(list_concat(a, b))) as n_any, len(list_filter(a, lambda x: not list_contains(b, x))) as n_first from s where a is not null and b is not null""",
    ("reviews",),
)
def array_set_ops(spark, sf_dir):
    pick = lambda n: F.collect_set(F.when(F.col("stars") == n, F.col("seller_id")))
    s = reviews(spark, sf_dir).groupBy("user_id").agg(pick(5).alias("a"), pick(1).alias("b")).filter("size(a) > 0 and size(b) > 0")
    size = lambda c: F.size(c).cast("bigint")
    return s.select("user_id", size(F.array_intersect("a", "b")).alias("n_both"), size(F.array_union("a", "b")).alias("n_any"), size(F.array_except("a", "b")).alias("n_first"))


@query(
    """select coalesce(o_custkey, c_custkey) as c_custkey, coalesce(o_totalprice, c_acctbal) as c_acctbal from customer full join
    (select o_custkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders) where r = 1) on o_custkey = c_custkey"""
)
def keyed_upsert(spark, sf_dir):
    updates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    return keyed.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), updates, "c_custkey", "o_orderkey")


@query("select c_name, row_number() over (order by c_name) - 1 as position from (select distinct c_name from customer)")
def key_positions(spark, sf_dir):
    return keyed.positions(table(spark, sf_dir, "customer"), "c_name")


@query("select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) as rank from orders) where rank <= 3")
def topk_per_group(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", rank.alias("rank")).filter("rank <= 3")


@query("select event_id, cast(row_number() over (partition by user_id order by event_id) > 1 as int) as flag from events")
def running_seen_flag(spark, sf_dir):
    seen = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) > 1
    return table(spark, sf_dir, "events").select("event_id", seen.cast("int").alias("flag"))


@query("+ c as (select user_id, seller_id, count(*) as n from reviews group by 1, 2) select user_id, seller_id, round(n::double / max(n) over (partition by user_id), 6) as ratio from c", ("reviews",))
def ratio_to_max(spark, sf_dir):
    c = reviews(spark, sf_dir).groupBy("user_id", "seller_id").agg(F.count("*").alias("n"))
    return c.select("user_id", "seller_id", F.round(F.col("n").cast("double") / F.max("n").over(W.partitionBy("user_id")), 6).alias("ratio"))


@query("+ e as (select label, unnest(embedding) as v, unnest(range(len(embedding))) as pos from embeddings) select label, cast(pos as int) as pos, count(*) as n, round(sum(v::double), 4) as s, round(sum(v::double * v::double), 4) as q from e group by 1, 2".replace("+ e", "with e"))
def vector_stats(spark, sf_dir):
    v = F.col("v").cast("double")
    return table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("s"), F.round(F.sum(v * v), 4).alias("q"))


# Frequent itemsets. A pair must be in a sixtieth of all baskets, a triple in a 250th.


def _itemsets(spark, sf_dir, share, size):
    sets = itemsets.baskets(baskets_long(spark, sf_dir), "basket_id", "item")
    return itemsets.frequent(sets, sets.count() // share, size).filter(F.col("size") == size).select(F.array_join("items", ",").alias("itemset"), "freq")


_ITEMS = [
    "select item as itemset, count(*) as freq, 1 as size from baskets_long group by 1",
    "select a.item || ',' || b.item as itemset, count(*) as freq, 2 as size from baskets_long a join baskets_long b on a.basket_id = b.basket_id and a.item < b.item group by 1",
    "select a.item || ',' || b.item || ',' || c.item as itemset, count(*) as freq, 3 as size from baskets_long a join baskets_long b on a.basket_id = b.basket_id and a.item < b.item join baskets_long c on a.basket_id = c.basket_id and b.item < c.item group by 1",
]
_FREQUENT = "select itemset, freq from ({}) where freq >= (select count(distinct basket_id) // {} from baskets_long)"


@query(_FREQUENT.format(_ITEMS[0], 60), ("baskets_long",))
def freq_items_1(spark, sf_dir):
    return _itemsets(spark, sf_dir, 60, 1)


@query(_FREQUENT.format(_ITEMS[1], 60), ("baskets_long",))
def freq_items_2(spark, sf_dir):
    return _itemsets(spark, sf_dir, 60, 2)


@query(_FREQUENT.format(_ITEMS[2], 250), ("baskets_long",))
def freq_items_3(spark, sf_dir):
    return _itemsets(spark, sf_dir, 250, 3)


@query(
    "+ big as (select basket_id from baskets_long group by 1 having count(*) > 4), b as (select * from baskets_long where basket_id in (select basket_id from big)) select itemset, freq from ("
    + _ITEMS[1].replace("baskets_long", "b") + ") where freq >= (select count(distinct basket_id) // 40 from b)",
    ("baskets_long",),
)
def freq_items_min_basket(spark, sf_dir):
    sets = itemsets.baskets(baskets_long(spark, sf_dir), "basket_id", "item", 4)
    return itemsets.frequent(sets, sets.count() // 40, 2).filter("size = 2").select(F.array_join("items", ",").alias("itemset"), "freq")


@query("select itemset, freq, size from (" + " union all ".join(_ITEMS) + ") where freq >= (select count(distinct basket_id) // 250 from baskets_long)", ("baskets_long",))
def fpgrowth_itemsets(spark, sf_dir):
    sets = written(itemsets.baskets(baskets_long(spark, sf_dir), "basket_id", "item"))
    return itemsets.fpgrowth(sets, sets.count() // 250, 3).select(F.array_join("items", ",").alias("itemset"), "freq", "size")


# Similarity


@query(
    """+ one as (select distinct user_id as k, business_id as i from ratings), n as (select k, count(*) as n from one group by 1),
    p as (select x.k as a, y.k as b, count(*) as c from one x join one y on x.i = y.i and x.k < y.k group by 1, 2)
    select a, b, round(c::double / (m.n + o.n - c), 6) as sim from p join n m on a = m.k join n o on b = o.k where c::double / (m.n + o.n - c) >= 0.05""",
    ("ratings",),
)
def jaccard_exact(spark, sf_dir):
    return similarity.jaccard(ratings(spark, sf_dir), "user_id", "business_id", 0.05).withColumn("sim", F.round("sim", 6))


#: Bands, rows and matches of LSH: three of 120 single hashes agree for a pair at 0.05 with probability 0.94, and closer ones more surely.
LSH = (120, 1, 3)


@query()
def minhash_lsh_pairs(spark, sf_dir):
    return similarity.lsh_jaccard(ratings(spark, sf_dir), "user_id", "business_id", 0.05, *LSH).withColumn("sim", F.round("sim", 6))


def _pearson_sql(key: str, by: str, common: int, default: str = "1.0") -> str:
    return f"""s as (select x.{key} as a, y.{key} as b, count(*) as n, sum(x.stars) as sx, sum(y.stars) as sy, sum(x.stars * y.stars) as sxy, sum(x.stars * x.stars) as sxx, sum(y.stars * y.stars) as syy
        from ratings x join ratings y on x.{by} = y.{by} and x.{key} < y.{key} group by 1, 2 having count(*) >= {common}),
    t as (select *, n * sxy - sx * sy as top, sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy) as low from s),
    sims as (select a, b, n, case when low > 0 and top <> 0 then top / low else {default} end as sim from t)"""


@query(f"+ {_pearson_sql('business_id', 'user_id', 3)} select a, b, n, round(sim, 6) as sim from sims", ("ratings",))
def pearson_items(spark, sf_dir):
    return similarity.pearson(ratings(spark, sf_dir), "business_id", "user_id").withColumn("sim", F.round("sim", 6))


@query(f"+ {_pearson_sql('user_id', 'business_id', 3)} select a, b, n, round(sim, 6) as sim from sims where sim >= 0.01", ("ratings",))
def pearson_users(spark, sf_dir):
    return similarity.pearson(ratings(spark, sf_dir), "user_id", "business_id").filter("sim >= 0.01").withColumn("sim", F.round("sim", 6))


# Recommendation


def requests(spark, sf_dir):
    """Each user with the part after one that they rated; -1 stands for the unknown on either side."""
    n = F.broadcast(table(spark, sf_dir, "part").agg(F.count("*").alias("parts")))  # one row
    asked = ratings(spark, sf_dir).join(n, F.lit(True)).select("user_id", ((F.col("business_id") + 1) % F.col("parts")).alias("business_id")).distinct()
    return asked.union(spark.createDataFrame([(-1, 1), (1, -1), (-1, -1)], "user_id bigint, business_id bigint"))


_REQUESTS = "requests as (select distinct user_id, (business_id + 1) % (select count(*) from part) as business_id from ratings union all values (-1, 1), (1, -1), (-1, -1))"
_AVERAGES = "b_avg as (select business_id, avg(stars) as b_avg, count(*) as raters from ratings group by 1), u_avg as (select user_id, avg(stars) as u_avg, count(*) as items from ratings group by 1)"
_BOTH = "ways as (select a, b, abs(sim) as w from sims where sim is not null union all select b, a, abs(sim) from sims where sim is not null)"


def _model(spark, tables):
    """Tables of a model, written and read again as a trainer and a predictor that run apart would."""
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    write_model(folder, **tables)
    return read_model(spark, folder, *tables)


@query(
    f"""+ {_pearson_sql('business_id', 'user_id', 3, 'null')}, {_REQUESTS}, {_AVERAGES}, {_BOTH},
    near as (select q.user_id, q.business_id, sum(w * r.stars) / nullif(sum(w), 0) as p from requests q join b_avg on q.business_id = b_avg.business_id and raters >= 30
        join ratings r on r.user_id = q.user_id join ways on ways.a = q.business_id and ways.b = r.business_id group by 1, 2)
    select q.user_id, q.business_id, round(greatest(0.0, least(5.0, coalesce(nullif(p, 0), b_avg, u_avg, 0.0))), 6) as stars
    from requests q left join near using (user_id, business_id) left join b_avg using (business_id) left join u_avg using (user_id)""",
    ("ratings",),
)
def cf_item_predict(spark, sf_dir):
    r = written(ratings(spark, sf_dir))
    (model,) = _model(spark, {"items": recommend.train(r, "business_id", "user_id")})
    return recommend.predict_by_items(r, requests(spark, sf_dir), model=model)


@query(
    f"""+ {_pearson_sql('user_id', 'business_id', 3, 'null')}, {_REQUESTS}, {_AVERAGES}, {_BOTH},
    near as (select q.user_id, q.business_id, sum(w * r.stars) / nullif(sum(w), 0) as p from requests q join u_avg on q.user_id = u_avg.user_id and items >= 30
        join ratings r on r.business_id = q.business_id join ways on ways.a = q.user_id and ways.b = r.user_id group by 1, 2)
    select q.user_id, q.business_id, round(greatest(0.0, least(5.0, case when b_avg is null then 3.0 else coalesce(nullif(p, 0), u_avg, b_avg) end)), 6) as stars
    from requests q left join near using (user_id, business_id) left join b_avg using (business_id) left join u_avg using (user_id)""",
    ("ratings",),
)
def cf_user_predict(spark, sf_dir):
    r = written(ratings(spark, sf_dir))
    (model,) = _model(spark, {"users": recommend.train(r, "user_id", "business_id")})
    return recommend.predict_by_users(r, requests(spark, sf_dir), 30, model=model)


@query()
def item_model_lsh(spark, sf_dir):
    return recommend.train(ratings(spark, sf_dir), "business_id", "user_id", lsh=LSH).withColumn("sim", F.round("sim", 6))


@query()
def user_model_lsh(spark, sf_dir):
    return recommend.train(ratings(spark, sf_dir), "user_id", "business_id", lsh=LSH).withColumn("sim", F.round("sim", 6))


@query(f"+ {_pearson_sql('business_id', 'user_id', 3)}, w as (select a as node, b as neighbour, round(sim, 6) as sim from sims union all select b, a, round(sim, 6) from sims) select node, neighbour, sim, cast(rank as int) as rank from (select *, row_number() over (partition by node order by sim desc, neighbour) as rank from w) where rank <= 5", ("ratings",))
def item_neighbours(spark, sf_dir):
    sims = similarity.pearson(ratings(spark, sf_dir), "business_id", "user_id").withColumn("sim", F.round("sim", 6))
    return similarity.neighbours(sims, 5).select("node", "neighbour", "sim", F.col("rank").cast("int").alias("rank"))


@query(f"+ busy as (select business_id from ratings group by 1 having count(*) >= 30), r2 as (select * from ratings where business_id in (select business_id from busy)), {_pearson_sql('business_id', 'user_id', 2, 'null').replace('ratings', 'r2')} select a as b1, b as b2, round(abs(sim), 6) as sim from sims where sim is not null", ("ratings",))
def item_similarity_model(spark, sf_dir):
    return recommend.item_model(ratings(spark, sf_dir), 30)


@query()
def mf_predict(spark, sf_dir):
    return recommend.factorise(ratings(spark, sf_dir), requests(spark, sf_dir))


_TFIDF = rf"""+ w as (select business_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}{BLANKS}]', '', 'g'), '{BLANK}'), lambda t: t <> '')) as word from text_reviews),
    c0 as (select business_id, word, count(*) as n from w where word not in ({_STOP_LIST}) group by 1, 2),
    c as (select * from c0 where word in (select word from c0 group by 1 having sum(n) >= 0.0001 * (select sum(n) from c0))),
    f as (select business_id, word, round(n::double / max(n) over (partition by business_id) * log2((select count(distinct business_id) from text_reviews)::double / count(*) over (partition by word)), 9) as w from c),
    v as (select distinct word from (select word, row_number() over (partition by business_id order by w desc, word) as rank from f) where rank <= 200),
    b as (select business_id, list_sort(list(word)) as words from f where word in (select word from v) group by 1),
    u as (select user_id, list_sort(list(distinct word)) as words from (select distinct user_id, unnest(words) as word from text_reviews join b using (business_id)) group by 1)"""


@query(f"{_TFIDF} select business_id, word, cast(rank as int) as rank, round(w, 6) as w from (select *, row_number() over (partition by business_id order by w desc, word) as rank from f) where rank <= 20", ("text_reviews",))
def tfidf_top_words(spark, sf_dir):
    return content.top_words(content.tfidf(text_reviews(spark, sf_dir)), 20).select("business_id", "word", "rank", F.round("w", 6).alias("w"))


@query(f"{_TFIDF} select business_id, len(words) as n, array_to_string(words, ',') as words from b", ("text_reviews",))
def business_profile(spark, sf_dir):
    return content.business_profiles(text_reviews(spark, sf_dir)).select("business_id", F.size("words").cast("bigint").alias("n"), F.array_join("words", ",").alias("words"))


@query(f"{_TFIDF} select word, row_number() over (order by word) - 1 as position from v", ("text_reviews",))
def vocabulary(spark, sf_dir):
    return content.vocabulary(durable(content.tfidf(text_reviews(spark, sf_dir))))


@query(f"{_TFIDF} select user_id, len(words) as n, array_to_string(words, ',') as words from u", ("text_reviews",))
def user_profile(spark, sf_dir):
    texts = text_reviews(spark, sf_dir)
    return content.user_profiles(texts, content.business_profiles(texts)).select("user_id", F.size("words").cast("bigint").alias("n"), F.array_join("words", ",").alias("words"))


@query(
    f"{_TFIDF} select * from (select q.user_id, q.business_id, round(len(list_intersect(u.words, b.words))::double / len(u.words), 6) as sim from (select distinct user_id, 'src' || (user_id % 20) as business_id from text_reviews) q join u using (user_id) join b using (business_id)) where sim > 0.01",
    ("text_reviews",),
)
def content_score(spark, sf_dir):
    texts = text_reviews(spark, sf_dir)
    trained = durable(content.business_profiles(texts))
    businesses_, users = _model(spark, {"business_profiles": trained, "user_profiles": content.user_profiles(texts, trained)})
    asked = texts.select("user_id", F.concat(F.lit("src"), F.col("user_id") % 20).alias("business_id")).distinct()
    return content.content_scores(asked, users, businesses_)


# Sketches


def _fm_sql(modulus: int) -> str:
    h = lambda a, b: f"((((user_id % {FM_PRIME}) * {a} + {b}) % {FM_PRIME}) % {modulus})"
    rest = lambda x: f"case when {x} = 0 then 1 else bit_count(({x} & -{x}) - 1) end"
    return ", ".join(f"pow(2.0, max({rest(h(a, b))})) as r{i}" for i, (a, b) in enumerate(FM_HASHES))


_ESTIMATE = "round(list_median([" + ", ".join(f"(r{g * 3} + r{g * 3 + 1} + r{g * 3 + 2}) / 3" for g in range(3)) + "]), 6) as n_estimate"
_ESTIMATE = _ESTIMATE.replace("list_median(", "list_aggregate(").replace("]), 6)", "], 'median'), 6)")
_WINDOWS = "with w as (select e.*, time_bucket(interval '1 day', ts) - d * interval '1 day' as start from events e, range(3) r(d))"


@query(f"with s as (select event_type, count(distinct user_id) as n_exact, {_fm_sql(FM_RANGE)} from events group by 1) select event_type, n_exact, {_ESTIMATE} from s")
def fm_distinct(spark, sf_dir):
    return sketches.fm_distinct(events(spark, sf_dir), ["event_type"], "user_id")


_FM_WINDOWS = f"{_WINDOWS}, s as (select start, {_fm_sql(FM_RANGE)} from w group by 1) select start, {_ESTIMATE} from s"


@query(_FM_WINDOWS)
def fm_sliding_window(spark, sf_dir):
    return streams.sliding_distinct(events(spark, sf_dir))


@query(f"{_WINDOWS} select start, count(distinct user_id) as n from w group by 1")
def distinct_exact_window(spark, sf_dir):
    return streams.exact_sliding(events(spark, sf_dir))


@query(f"{_WINDOWS} select strftime(start + interval '3 days', '%Y-%m-%d %H:%M:%S') as time, count(distinct user_id) as n from w group by start")
def distinct_by_window_end(spark, sf_dir):
    return streams.stamped(streams.exact_sliding(events(spark, sf_dir))).select("time", "n")


_FPP = 0.01
_HASHES = sketches.bloom_size(1, _FPP)[1]


def _bloom_sql() -> str:
    p = sketches.BLOOM_PRIME
    at = ", ".join(f"(((y * y + y * {a} + {b}) % {p}) % m)" for a, b in sketches.bloom_hashes(_HASHES))
    hit = " and ".join(f"bits[{i + 1}] in (select bit from s)" for i in range(_HASHES))
    return f"""with b as (select distinct user_id from events where event_type = 'purchase' and user_id % 3 = 0),
    size as (select greatest(8, cast(ceil(-count(*) * ln({_FPP}) / pow(ln(2), 2)) as bigint)) as m from b),
    p as (select event_id, user_id, [{at}] as bits from (select *, ((user_id % {p}) * 48271 + 11) % {p} as y from events), size),
    s as (select distinct unnest(bits) as bit from p where user_id in (select user_id from b))
    select event_id, case when {hit} then 1 else 0 end as flag from p"""


def _base(spark, sf_dir):
    return events(spark, sf_dir).filter("event_type = 'purchase' and user_id % 3 = 0")


@query(_bloom_sql())
def bloom_probe(spark, sf_dir):
    base = _base(spark, sf_dir).select("user_id").distinct()
    m, k = sketches.bloom_size(base.count(), _FPP)
    return sketches.bloom_flags(events(spark, sf_dir), "user_id", "event_id", sketches.bloom_bits(base, "user_id", m, k), m, k)


@query("select event_id, case when user_id in (select user_id from events where event_type = 'purchase' and user_id % 3 = 0) then 1 else 0 end as flag from events")
def seen_exact(spark, sf_dir):
    return sketches.seen_exact(events(spark, sf_dir), "user_id", _base(spark, sf_dir), ["event_id"])


_SAMPLE = "select event_id, event_type, props from events order by md5('7:' || event_id), event_id limit 100"


@query(f"select event_id from ({_SAMPLE})")
def reservoir_sample(spark, sf_dir):
    return sketches.bottom_k(events(spark, sf_dir), "event_id", 100).select("event_id")


@query(f"select tag, count(*) as n from (select unnest([event_type, 'k' || json_extract_string(props, '$.k')]) as tag from ({_SAMPLE})) group by 1 order by n desc, tag limit 3")
def top_tags_in_sample(spark, sf_dir):
    return sketches.top_tags(sketches.bottom_k(events(spark, sf_dir), "event_id", 100))


# Clustering. The points with the smallest ids are the centres of single steps.


def _centres(spark, sf_dir, k=4):
    return [(r["vec_id"], list(r["x"])) for r in points(spark, sf_dir).filter(F.col("vec_id") < k).collect()]


_ASSIGNED = f"""+ d as (select p.vec_id, p.x, c.vec_id as cluster, sqrt(list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))) as d from points p, points c where c.vec_id < 4),
    a as (select * from (select *, row_number() over (partition by vec_id order by d, cluster) as r from d) where r = 1)"""
_STATS = f", e as (select cluster, unnest(x) as v, unnest(range({DIMENSIONS})) as pos from a), s as (select cluster, pos, count(*) as n, sum(v) as s, sum(v * v) as q from e group by 1, 2)"


@query(f"{_ASSIGNED} select vec_id, cast(cluster as int) as cluster, round(d, 5) as d from a", ("points",))
def kmeans_assign(spark, sf_dir):
    return clustering.assign(points(spark, sf_dir), _centres(spark, sf_dir)).select("vec_id", "cluster", F.round("d", 5).alias("d"))


@query(f"{_ASSIGNED}{_STATS} select cast(cluster as int) as cluster, cast(pos as int) as pos, n, round(s, 4) as s, round(q, 4) as q from s", ("points",))
def kmeans_stats(spark, sf_dir):
    return clustering.summary_rows(clustering.assign(points(spark, sf_dir), _centres(spark, sf_dir)), DIMENSIONS)


@query(
    f"""{_ASSIGNED}{_STATS}, c as (select cluster, list(s / n order by pos) as m, list(case when q / n - (s / n) * (s / n) > 0 then sqrt(q / n - (s / n) * (s / n)) else 1.0 end order by pos) as sd from s group by 1),
    g as (select p.vec_id, c.cluster, sqrt(list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: ((p.x[i] - c.m[i]) / c.sd[i]) ** 2))) as d from points p, c)
    select vec_id, cast(case when d < sqrt({DIMENSIONS}.0) then cluster else -1 end as int) as cluster from (select *, row_number() over (partition by vec_id order by d, cluster) as r from g) where r = 1""",
    ("points",),
)
def mahalanobis_assign(spark, sf_dir):
    p = points(spark, sf_dir)
    found = clustering.summaries(clustering.assign(p, _centres(spark, sf_dir)), DIMENSIONS)
    return clustering.assign_within(p, found, DIMENSIONS, 1.0).select("vec_id", "cluster")


def _numbered(spark, sf_dir):
    return points(spark, sf_dir).withColumnRenamed("vec_id", "point_id")


_TURN = """a{0} as (select vec_id, x, cluster from (select p.vec_id, p.x, c.cluster, row_number() over (partition by p.vec_id order by
        list_sum(list_transform(range(1, {2}), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), c.cluster) as r from points p, c{0} c) where r = 1),
    m{0} as (select cluster, pos, count(*) as n, avg(v) as m from (select cluster, unnest(x) as v, unnest(range({3})) as pos from a{0}) group by 1, 2),
    c{1} as (select cluster, max(n) as n, list(m order by pos) as x from m{0} group by 1)"""


@query(
    f"+ c0 as (select vec_id as cluster, x from points where vec_id < 4), {', '.join(_TURN.format(i, i + 1, DIMENSIONS + 1, DIMENSIONS) for i in range(3))} select cast(cluster as int) as cluster, n, cast(pos as int) as pos, round(v, 4) as v from (select cluster, n, unnest(x) as v, unnest(range({DIMENSIONS})) as pos from c3)",
    ("points",),
)
def kmeans_three_turns(spark, sf_dir):
    found = clustering.kmeans(points(spark, sf_dir), _centres(spark, sf_dir), DIMENSIONS, tolerance=-1.0, turns=3)
    rows = spark.createDataFrame([(c.id, c.n, c.centre) for c in found], "cluster int, n bigint, centre array<double>")
    return rows.select("cluster", "n", F.posexplode("centre").alias("pos", "v")).withColumn("v", F.round("v", 4))


@query()
def kmeans_fit(spark, sf_dir):
    p = _numbered(spark, sf_dir)
    found = clustering.kmeans(p, clustering.first_points(p, 8), DIMENSIONS)
    return spark.createDataFrame([(c.id, c.n, [round(v, 6) for v in c.centre]) for c in found], "cluster int, n bigint, centre array<double>")


def _bfr(spark, sf_dir):
    p, model = _numbered(spark, sf_dir), clustering.BFR(8, DIMENSIONS)
    for chunk in range(4):
        model.update(p.filter(F.col("chunk") == chunk))
    return model


@query()
def bfr_round_metrics(spark, sf_dir):
    return _bfr(spark, sf_dir).metric_rows(spark)


@query()
def bfr_assignments(spark, sf_dir):
    return _bfr(spark, sf_dir).result().orderBy("point_id")


# Graphs: sellers that share more reviewers than chance gives, by 3.5 standard deviations.


def _edges(spark, sf_dir):
    return graph.surprising_edges(reviews(spark, sf_dir), "seller_id", "user_id")


_EDGES = f"""{_OVERLAPS}, n as (select k, count(*)::double as n from one group by 1), every as (select count(distinct i)::double as every from one),
    e as (select a, b, common, x.n * y.n / every as mean, (1 - x.n / every) * (1 - y.n / every) as f from pairs join n x on a = x.k join n y on b = y.k, every),
    edges as (select a, b, common from e where common > mean and (common - mean) * (common - mean) >= 12.25 * mean * f), ends as (select a as node, b as other from edges union all select b, a from edges)"""
_COMPS = "reach(node, seen) as (select node, node from ends union select r.node, e.other from reach r join ends e on r.seen = e.node), comps as (select node, min(seen) as comp from reach group by 1)"


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query(f"{_EDGES} select a, b, common from edges", ("reviews",))
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"{_EDGES} select node, count(*) as degree from ends group by 1", ("reviews",))
def graph_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"{_EDGES}, {_COMPS} select node, comp from comps", ("reviews",))
def graph_components(spark, sf_dir):
    return graph.components(_edges(spark, sf_dir))


@query(
    f"""{_EDGES}, m as (select count(*)::double as m from edges), deg as (select node % 5 as comp, count(*) as d from ends group by 1), inn as (select a % 5 as comp, count(*) as l from edges where a % 5 = b % 5 group by 1)
    select round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) as q from deg left join inn using (comp), m""",
    ("reviews",),
)
def graph_modularity(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.modularity(edges, graph.degrees(edges).select("node", (F.col("node") % 5).alias("comp")))


_VOTE = "l{1} as (select node, label from (select e.node, l.label, row_number() over (partition by e.node order by count(*) desc, l.label) as r from ends e join l{0} l on e.other = l.node group by 1, 2) where r = 1)"


@query(
    f"{_EDGES}, l0 as (select distinct node, node as label from ends), {', '.join(_VOTE.format(i, i + 1) for i in range(5))} select cast(count(*) as int) as size, string_agg(cast(node as varchar), ',' order by node) as members from l5 group by label",
    ("reviews",),
)
def lpa_communities(spark, sf_dir):
    return graph.community_rows(graph.label_propagation(_edges(spark, sf_dir)), "label").select("size", F.array_join("members", ",").alias("members"))


@query(
    f"""{_EDGES}, walks(root, node, level) as (select distinct node, node, 0 from ends union select w.root, e.other, w.level + 1 from walks w join ends e on w.node = e.node where w.level < (select count(distinct node) from ends)),
    dist as (select root, node, min(level) as level from walks group by 1, 2),
    paths(root, node, level, sigma) as (select root, node, level, 1.0::double from dist where level = 0 union all
        select p.root, e.other, p.level + 1, sum(p.sigma) from paths p join ends e on p.node = e.node join dist d on d.root = p.root and d.node = e.other and d.level = p.level + 1 group by 1, 2, 3)
    select least(e.node, e.other) as a, greatest(e.node, e.other) as b, round(sum(x.sigma * y.sigma / z.sigma) / 2, 6) as w
    from ends e join paths x on x.node = e.node join paths y on y.root = e.other join paths z on z.root = x.root and z.node = y.node and z.level = x.level + 1 + y.level group by 1, 2""",
    ("reviews",),
)
def edge_betweenness(spark, sf_dir):
    return graph.betweenness(_edges(spark, sf_dir)).select("a", "b", F.round("w", 6).alias("w"))


@query()
def girvan_newman(spark, sf_dir):
    return graph.girvan_newman(_edges(spark, sf_dir))


for _name in ("graph_components", "edge_betweenness"):
    ORACLES[_name] = _recursive(ORACLES[_name])

# Streams: equal to their batch twins after all has been read.


@query(_FM_WINDOWS)
def stream_fm(spark, sf_dir):
    return streams.stream_fm(spark, sf_dir)


@query(f"select event_id from ({_SAMPLE})")
def stream_reservoir(spark, sf_dir):
    return streams.stream_reservoir(spark, sf_dir)


@query("select distinct user_id from events")
def stream_seen(spark, sf_dir):
    return streams.stream_seen(spark, sf_dir)
