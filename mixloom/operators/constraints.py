"""Verifiers of instruction constraints: labels that name checks and their arguments.

A label's checks are told apart by their name and arguments. Each distinct one becomes a native
expression; they are met in parts of PART, so an expression stays small however many there are.
"""

from __future__ import annotations

import ast
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from mixloom.functions import following
from mixloom.functions.text import remove_thinking
from mixloom.session import cut

PART = 100
# Names of the arguments of each check, in the order the check takes them.
CHECK_ARGUMENTS = {
    "keywords:existence": ("keywords",),
    "keywords:frequency": ("keyword", "frequency", "relation"),
    "keywords:forbidden_words": ("forbidden_words",),
    "keywords:letter_frequency": ("letter", "let_frequency", "let_relation"),
    "letters:letter_counting2": ("letter", "let_frequency", "let_relation"),
    "language:response_language": ("language",),
    "length_constraints:number_sentences": ("num_sentences", "relation"),
    "length_constraints:number_paragraphs": ("num_paragraphs",),
    "length_constraints:number_words": ("num_words", "relation"),
    "length_constraints:nth_paragraph_first_word": ("num_paragraphs", "nth_paragraph", "first_word"),
    "detectable_content:number_placeholders": ("num_placeholders",),
    "detectable_content:postscript": ("postscript_marker",),
    "detectable_format:number_bullet_lists": ("num_bullets",),
    "detectable_format:number_highlighted_sections": ("num_highlights",),
    "detectable_format:multiple_sections": ("section_spliter", "num_sections"),
    "combination:repeat_prompt": ("prompt_to_repeat",),
    "startend:end_checker": ("end_phrase",),
    "change_case:capital_word_frequency": ("capital_frequency", "capital_relation"),
    "copy:repeat_phrase": ("phrase", "small_n"),
    "copy:copy": ("prompt_to_repeat",),
    "copy:copying_simple": ("prompt_to_repeat",),
    "copy:copying_multiple": ("prompt_to_repeat", "N"),
    "new:copy_span_idx": ("prompt_to_repeat", "n_start", "n_end"),
    "keywords:word_once": ("keyword",),
    "keywords:word_count_different_numbers": ("keyword", "frequency", "relation"),
    "keywords:exclude_word_harder": ("keyword",),
    "keywords:keyword_specific_position": ("keyword", "n", "m"),
    "first_word:first_word_sent": ("first_word",),
    "first_word:first_word_answer": ("first_word",),
    "last_word:last_word_sent": ("last_word",),
    "last_word:last_word_answer": ("last_word",),
    "count:lowercase_counting": ("N",),
    "count:counting_composition": ("n_sent", "n_words"),
    "count:count_increment_word": ("keyword1", "keyword2"),
    "letters:letter_counting": ("N", "relation"),
}
FUNCTION_ARGUMENTS = {
    "verify_keywords": ("keyword_list",),
    "verify_keyword_frequency": ("word", "N"),
    "validate_forbidden_words": ("forbidden_words",),
    "verify_letter_frequency": ("letter", "N"),
    "validate_response_language": ("language",),
    "verify_paragraph_count": ("N",),
    "validate_word_constraint": ("N", "quantifier"),
    "verify_sentence_constraint": ("N", "quantifier"),
    "validate_paragraphs": ("N", "first_word", "i"),
    "verify_postscript": ("postscript_marker",),
    "validate_placeholders": ("N",),
    "verify_bullet_points": ("N",),
    "validate_choice": ("options",),
    "validate_highlighted_sections": ("N",),
    "validate_sections": ("N", "section_splitter"),
    "validate_repeat_prompt": ("original_prompt",),
    "validate_frequency_capital_words": ("N", "quantifier"),
    "validate_end": ("end_phrase",),
}
#: Checks whose first argument is a text column.
_TEXT = {"combination:repeat_prompt", "copy:copy", "copy:copying_simple", "copy:copying_multiple", "new:copy_span_idx", "validate_repeat_prompt"}
_PARSED = ArrayType(StructType([StructField("name", StringType()), StructField("arguments", StringType())]))


def _arguments(given: dict | None) -> str:
    return json.dumps({k: v for k, v in (given or {}).items() if v is not None}, sort_keys=True, ensure_ascii=False)


@pandas_udf(_PARSED)
def _checks_of(labels: pd.Series) -> pd.Series:
    """Of a literal (or JSON) list whose first entry has instruction_id and kwargs."""

    def one(label):
        try:
            first = ast.literal_eval(label)[0]
            first = json.loads(first) if isinstance(first, str) else first
            return [(n, _arguments(a)) for n, a in zip(first["instruction_id"], first["kwargs"])]
        except (ValueError, SyntaxError, KeyError, IndexError, TypeError):
            return None

    return labels.map(one)


@pandas_udf(_PARSED)
def _function_of(labels: pd.Series) -> pd.Series:
    """Of a JSON object with func_name and the function's arguments."""

    def one(label):
        try:
            given = json.loads(label)
            return [(given.pop("func_name"), _arguments(given))]
        except (ValueError, KeyError, TypeError, AttributeError):
            return None

    return labels.map(one)


def _verdict(x: Column, name: str, arguments: str, checks: dict, names: dict) -> Column:
    if name not in checks:
        return F.lit(False)
    given = json.loads(arguments)
    values = [given.get(k) for k in names.get(name, ())]
    if None in values:
        return F.lit(False)
    if name in _TEXT:
        values[0] = F.lit(values[0])
    return F.coalesce(checks[name](x, *values), F.lit(False))


def _scores(df: DataFrame, key: str, response: str, parsed: Column, checks: dict, names: dict) -> DataFrame:
    answers = df.select(key, F.col(response).alias("_raw"), remove_thinking(F.col(response)).alias("_x"), parsed.alias("_c"))
    each = cut(answers.select(key, "_raw", "_x", F.explode_outer("_c").alias("c")).select(key, "_raw", "_x", F.col("c.name").alias("_n"), F.col("c.arguments").alias("_a")))
    # Only names and arguments are looked at here; rows stay where they are.
    wanted = each.where("_n is not null").select("_n", "_a").distinct().orderBy("_n", "_a").toLocalIterator()
    parts: list[list] = [[]]
    for row in wanted:
        if len(parts[-1]) == PART:
            parts.append([])
        parts[-1].append((row["_n"], row["_a"]))
    rule = lambda n, a: (F.col("_n") == n) & (F.col("_a") == a)
    frames = [each.where("_n is null").select(key, F.lit(0.0).alias("_s"))]
    for part in filter(None, parts):
        ok = F.lit(False)
        for n, a in part:
            ok = F.when(rule(n, a), _verdict(F.col("_x"), n, a, checks, names)).otherwise(ok)
        filled = (F.coalesce(F.length("_raw"), F.lit(0)) > 0) & (F.coalesce(F.length("_x"), F.lit(0)) > 0)
        here = F.concat_ws("\u0001", "_n", "_a").isin(*[f"{n}\u0001{a}" for n, a in part])
        frames.append(each.where(here).select(key, F.when(filled & ok, 1.0).otherwise(0.0).alias("_s")))
    return reduce(DataFrame.unionByName, frames).groupBy(key).agg(F.avg("_s").alias("score"))


def ifeval(df: DataFrame, key: str, response: str, label: str) -> DataFrame:
    """(key, score): share of the label's checks that the answer, without its reasoning, follows.

    Null and empty answers, labels that can't be read, unknown checks and missing arguments score 0.
    """
    return _scores(df, key, response, _checks_of(F.col(label)), following.CHECKS, CHECK_ARGUMENTS)


def ifeval_old(df: DataFrame, key: str, response: str, label: str) -> DataFrame:
    """(key, score): 1 if the function the label names holds for the answer, else 0; otherwise as ``ifeval``."""
    return _scores(df, key, response, _function_of(F.col(label)), following.FUNCTIONS, FUNCTION_ARGUMENTS)
