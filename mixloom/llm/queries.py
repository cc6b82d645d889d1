"""The pN_ queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mixloom.llm import defects, leaks, mixing, packing, sentences, tokens
from mixloom.plans.queries_text import _DS


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark, sf):
    return leaks.find_leaks(_t(spark, sf, "train_rows"), _t(spark, sf, "eval_items"))


def p2_found(spark, sf):
    return defects.find_defects(_t(spark, sf, "completions"), _t(spark, sf, "train_rows"))


def p3_found(spark, sf):
    return mixing.short_sources(p3_shares(spark, sf))


def p3_shares(spark, sf):
    plan, copies = mixing.mix_copies(_t(spark, sf, "train_rows"), _t(spark, sf, "mix_spec"))
    return mixing.mix_shares(plan, copies)


def p3_copies(spark, sf):
    return mixing.mix_copies(_t(spark, sf, "train_rows"), _t(spark, sf, "mix_spec"))[1]


def p4_token_budget(spark, sf):
    return tokens.token_budget(_t(spark, sf, "train_rows"), _t(spark, sf, "dataset_info"))


def p4_example_tokens(spark, sf):
    return tokens.example_tokens(_t(spark, sf, "train_rows"))


def p5_ids(spark, sf):
    return tokens.encode_texts(_t(spark, sf, "documents"))


def p6_found(spark, sf):
    return packing.split_documents(p6_containers(spark, sf))


def p6_containers(spark, sf):
    return packing.pack(_t(spark, sf, "documents"))


def p6_fill(spark, sf):
    return packing.fill_report(p6_containers(spark, sf))


def p7_found(spark, sf):
    return sentences.sentence_units(_t(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_shares, p3_copies, p4_example_tokens, p4_token_budget, p5_ids, p6_found, p6_containers, p6_fill, p7_found)}

SQL: dict[str, str] = {
    "p3_found": f"""with e as (select distinct row_id, {_DS} as key from train_rows where row_id is not null), n as (select key, count(*) as n from e where key is not null group by 1),
s as (select *, {_DS} as key from mix_spec), z as (select s.mix, s.dataset, s.key, coalesce(s.target_share, 0) as share, s.max_repeats, coalesce(n.n, 0) as n from s left join n using (key)),
t as (select mix, sum(n) as total from (select distinct mix, key, n from z) group by 1) select z.mix, z.dataset from z join t using (mix) where z.n * z.max_repeats < z.share * t.total"""
}
