"""The queries of this subpackage, by name, and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .html_text import extract
from .line_dedup import line_dedup
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import best_fit_packing
from .substring_dedup import substring_dedup
from .suffix_dedup import repeated_passages
from .topk_search import topk_search
from .toxicity import toxicity


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens at most: a row for each piece, with its place. Ids, nulls, repeats and empty tables as in `best_fit_packing`."""
    return best_fit_packing(table(spark, sf_dir, "documents"), word_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of a smaller doc_id has too: doc_id, start, n_words, source_id, source_start. Nulls, repeats and empty tables as in `repeated_passages`."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256 for each row. Nulls, ties and empty tables as in `exact_dedup`."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of each page: page_id, url, text. Nulls, broken pages and empty tables as in `extract`."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when those in windows of 13 words of a smaller doc_id go: doc_id, n_words, n_removed, kept_sha256. Nulls, repeats and empty tables as in `substring_dedup`."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best others by integer inner product for each vec_id divisible by 50: query_id, rank, vec_id, score. Nulls, ties, repeats and empty tables as in `topk_search`."""
    return topk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document: doc_id, held_out, score, predicted. Nulls, repeats and empty tables as in `toxicity`; of the documents only doc_id and text are read."""
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by the square root of their sources' sizes: doc_id, source, mix_block, mix_place. Nulls, ties and empty tables as in `mix`."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "mix_block", "mix_place")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that ten or more have (each row is a document): doc_id, n_lines, n_dropped, kept_sha256. Nulls, repeats and empty tables as in `line_dedup`."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates by 3-word shingles at 0.85: doc_id, n_shingles, component_id, kept. Nulls, repeats and empty tables as in `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_toxicity": op7_toxicity,
    "op8_mix_sources": op8_mix_sources,
    "op9_line_dedup": op9_line_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        with t as (select doc_id, coalesce(text, '') as text from documents),
        g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
        from t join g on t.text = g.text""",
    "op6_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id,
                     list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op9_line_dedup": """
        with d as (select row_number() over () as doc, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
        e as (select doc, doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as pos from d),
        k as (select doc, doc_id, line, pos,
                     translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
        bad as (select key from k where length(key) >= 1 group by key having count(distinct doc) >= 10)
        select k.doc_id, count(*) as n_lines, count(*) filter (where k.key in (select key from bad)) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where k.key not in (select key from bad)), '')) as kept_sha256
        from k group by k.doc, k.doc_id""",
}
