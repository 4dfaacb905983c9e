"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import token_report

    return token_report(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    outcomes = table(spark, sf_dir, "labels").selectExpr("doc_id as page_id", "quality as good")
    return url_filter(table(spark, sf_dir, "pages"), outcomes)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_digest, chat_windows

    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat_digest(chat_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import score_quality, train

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroid_clustering import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_file_report

    return token_file_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


CLOSURE = """both_ways as (select a, b from links union all select b, a from links),
reach as (select * from (with recursive r as (select a, b from both_ways union select r.a, l.b from r join both_ways l on r.b = l.a) select * from r)),
roots as (select a, min(b) as root from reach group by 1)"""

JACCARD_SQL = rf"""
with recursive_words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from recursive_words),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (select x.doc_id as a, y.doc_id as b from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
{CLOSURE}
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(root, doc_id)) as component_id from sets left join roots on a = doc_id
"""

VECTORS_SQL = f"""
with fine as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(embedding::double[], embedding::double[]) > 0),
links as (select x.vec_id as a, y.vec_id as b from fine x join fine y on x.vec_id < y.vec_id and len(x.v) = len(y.v) and list_cosine_similarity(x.v, y.v) >= 0.9),
{CLOSURE},
counts as (select a, count(*) as n from both_ways group by 1)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(root, vec_id)) as component_id, coalesce(root, vec_id) >= vec_id as kept from embeddings left join counts c on c.a = vec_id left join roots r on r.a = vec_id
"""


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
RUNS = "list_transform(range(1, len(w) - {n} + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + {n} - 1], ' ')}})"

LEAKS_SQL = f"""
with dw as (select doc_id, {WORDS} as w from documents), iw as (select item_id, {WORDS} as w from benchmark),
dg as (select doc_id, dn, r.i as i, r.g as g from (select doc_id, len(w) as dn, unnest({RUNS.format(n=5)}) as r from dw where len(w) >= 5)),
ig as (select item_id, n, g, count(*) as c from (select item_id, len(w) as n, unnest(list_transform({RUNS.format(n=5)}, lambda r: r.g)) as g from iw where len(w) >= 5) group by all),
hits as (select doc_id, item_id, i, g, c, n - 4 as m, least(n, dn) - 4 as k, dn - 4 as last, least(n, dn) as n_words from dg join ig using (g)),
enough as (select doc_id, item_id from hits group by doc_id, item_id, m, k having count(*) >= 0.75 / 1.75 * (m + k) - 1e-9),
h as (select hits.* from hits join enough using (doc_id, item_id)),
starts as (select distinct doc_id, item_id, m, k, n_words, unnest(range(greatest(1, i - k + 1), least(i, last - k + 1) + 1)) as s from h),
met as (select t.doc_id, t.item_id, t.m, t.k, t.n_words, t.s, least(count(*), h.c) as c from starts t join h on h.doc_id = t.doc_id and h.item_id = t.item_id and h.i between t.s and t.s + t.k - 1 group by t.doc_id, t.item_id, t.m, t.k, t.n_words, t.s, h.g, h.c),
sums as (select doc_id, item_id, s - 1 as first_word, n_words, sum(c) / (m + k - sum(c)) as similarity from met group by doc_id, item_id, m, k, s, n_words),
short as (select d.doc_id, i.item_id, min(d.x.i) - 1 as first_word, len(i.w) as n_words, 1.0::double as similarity from iw i join (select doc_id, 1 as n, unnest({RUNS.format(n=1)}) as x from dw union all select doc_id, 2, unnest({RUNS.format(n=2)}) from dw union all select doc_id, 3, unnest({RUNS.format(n=3)}) from dw union all select doc_id, 4, unnest({RUNS.format(n=4)}) from dw) d on d.n = len(i.w) and d.x.g = array_to_string(i.w, ' ') group by d.doc_id, i.item_id, i.w),
found as (select doc_id, item_id, similarity::double as similarity, first_word, n_words from sums where similarity >= 0.75 - 1e-12 union all select doc_id, item_id, similarity, first_word, n_words from short)
select doc_id, item_id, similarity, first_word::bigint as first_word, n_words::int as n_words from found qualify row_number() over (partition by doc_id, item_id order by similarity desc, first_word) = 1
"""


def oracle_sql() -> dict[str, str]:
    from .centroid_clustering import SQL as CLUSTERS_SQL
    from .source_divergence import SQL as DIVERGENCE_SQL
    from .url_filter import SQL

    return {"op11_centroid_clustering": CLUSTERS_SQL, "op13_source_divergence": DIVERGENCE_SQL, "op1_ngram_jaccard_join": JACCARD_SQL, "op4_benchmark_decontamination": LEAKS_SQL, "op6_url_filters": SQL, "op8_embedding_near_dedup": VECTORS_SQL}
