"""The thin queries opN_<name> over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import ann, bpe, licenses, neardup, packing, pii, quality, secrets, sharding, tokenfile
from graphloom.llm.common import read_table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixed_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op1_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"))


def op3_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.op3_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read_table(spark, sf_dir, "documents"))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op7_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op8_documents(read_table(spark, sf_dir, "documents"))


def op9_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op10_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixed_range_coder": op1_mixed_range_coder, "op2_rule_ledger": op2_rule_ledger, "op3_distinct_word_bpe": op3_distinct_word_bpe, "op4_boosted_pii": op4_boosted_pii, "op5_markov_secrets": op5_markov_secrets, "op6_nn_descent": op6_nn_descent, "op7_odd_sketch_neardup": op7_odd_sketch_neardup, "op8_ring_shards": op8_ring_shards, "op9_rare_token_licenses": op9_rare_token_licenses, "op10_binary_packing": op10_binary_packing}


#: Exact search. While one leaf holds all vectors the operator is exact too; beyond that its recall is measured in the tests.
_OP6_SQL = """
with usable as (
  select cast(vec_id as bigint) vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id query_id, c.vec_id vec_id, sqrt(list_reduce(list_prepend(cast(0 as double), list_transform(list_zip(c.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), lambda a, b: a + b)) score
  from usable q join usable c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score, vec_id) rank from pairs) where rank <= 10"""

#: Words, lines and windows are lists of a row; no text meets another.
_OP2_SQL = """
with w as (
  select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from documents),
g as (select *, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) grams from w),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) n from (select doc_id, unnest(range(1, len(grams) + 1)) i, unnest(grams) gram from g)) where n > 1),
covered as (select doc_id, count(distinct i + k) n from twice, (values (0), (1), (2)) v(k) group by doc_id),
m as (
  select g.doc_id, cast(len(words) as bigint) n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines, cast(coalesce(n, 0) as bigint) n_repeat_words,
    cast(len(lines) as bigint) n_lines, cast(length(regexp_replace(t, '\\P{L}+', '', 'g')) as bigint) n_letters, cast(length(regexp_replace(t, '\\P{Lu}+', '', 'g')) as bigint) n_upper
  from g left join covered c on g.doc_id = c.doc_id),
b as (
  select *, cast((case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end) + (case when 10 * n_symbols > n_words then 4 else 0 end)
    + (case when 100 * n_dup_lines > 40 * n_lines then 8 else 0 end) + (case when word_chars < 2 * n_words or word_chars > 14 * n_words then 16 else 0 end)
    + (case when n_letters > 0 and 100 * n_upper > 60 * n_letters then 32 else 0 end) + (case when 4 * n_letters < word_chars then 64 else 0 end) as bigint) fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 base_failed, fail_bits = 0 kept, n_lines, n_letters, n_upper, fail_bits from b"""


def oracle_sql() -> dict[str, str]:
    """Encoders, models and hash rings have no SQL form; the tests hold them against plain Python."""
    return {"op2_rule_ledger": _OP2_SQL, "op6_nn_descent": _OP6_SQL}
