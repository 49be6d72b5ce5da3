"""The operators over their whole tables, with SQL where SQL can state the result.

Every entry is ``name: (spark_query, sql_or_none)``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import alignment, bpe, importance, language_id, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash, token_counts, topk_search, url_filter
from quire.llm.common import fold, labelled_sample, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


#: Bounds of the labelled samples that classifiers are fitted on.
RULE_SAMPLE = 8000
QUALITY_SAMPLE = 3000
LANGUAGE_SAMPLE = 1000  # documents of each language


def rule_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality_rules.RuleModel:
    labels = table(spark, sf_dir, "labels")
    return quality_rules.fit_rules(labelled_sample(docs, labels, RULE_SAMPLE))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URL_MODEL = url_filter.fit_urls(url_filter.seed_table())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_MODEL)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = fold("doc_id", 5) != 0
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), QUALITY_SAMPLE, where=seen)
    scored = quality_classifier.score_quality(docs, quality_classifier.fit_quality(sample))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.learn_and_score(docs, fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), *scored.columns[1:])


def language_model(docs: DataFrame) -> language_id.LanguageModel:
    sample = language_id.training_sample(docs, LANGUAGE_SAMPLE, fold("doc_id", 5) != 0)
    return language_id.fit_languages(sample)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_model(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


_OP9 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
  where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, rule_model(spark, sf_dir, docs))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.token_pieces(docs, path, capacity=2048, outputs=("ids_crc32",)), capacity=2048)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.count_links(table(spark, sf_dir, "documents"), *paths)


QUERIES = {
    "op1_simhash": (op1_simhash, None),
    "op2_byte_bpe": (op2_byte_bpe, None),
    "op3_token_counts": (op3_token_counts, None),
    "op4_url_filter": (op4_url_filter, url_filter.sql(URL_RULES, URL_MODEL)),
    "op5_quality_classifier": (op5_quality_classifier, None),
    "op6_lm_scoring": (op6_lm_scoring, None),
    "op7_language_id": (op7_language_id, None),
    "op8_mixing": (op8_mixing, mixing.sql()),
    "op9_topk_search": (op9_topk_search, _OP9),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_packing": (op11_packing, None),
    "op12_importance_resampling": (op12_importance_resampling, importance.sql()),
    "op13_alignment": (op13_alignment, None),
}
