"""Scalar text functions as native column expressions.

Patterns that Python applies to ``str`` get ``(?U)`` so that \\w, \\s, \\d and \\b are Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def split_words(x: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def word_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)(\w+)"), F.lit(1))


def count_matches(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a blank; none if there are fewer tokens."""
    size = F.size(tokens) - (n - 1)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "\n\n"), strip), lambda p: p != "")


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"[.!?]+"), strip), lambda p: p != "")


def remove_thinking(x: Column) -> Column:
    """What follows the last reasoning block, without answer tags."""
    x = F.replace(x, F.lit("<|assistant|>"), F.lit(""))
    x = F.element_at(F.split(x, "</think>"), -1)
    for tag in ("<answer>", "</answer>"):
        x = F.replace(x, F.lit(tag), F.lit(""))
    return strip(x)


def strip_special_tokens(x: Column) -> Column:
    """Reasoning and answer tags turned into line breaks."""
    for tag, by in (("<think>", "\n"), ("</think>", ""), ("<answer>", "\n\n"), ("</answer>", "")):
        x = F.replace(x, F.lit(tag), F.lit(by))
    return x


def normalize_answer(x: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single blanks."""
    x = F.regexp_replace(F.lower(x), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    x = F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " ")
    return F.array_join(split_words(x), " ")


def f1(prediction: Column, truth: Column) -> Column:
    """F1 of the multisets of normalised tokens; 0 without overlap."""
    p, t = split_words(normalize_answer(prediction)), split_words(normalize_answer(truth))
    same = F.aggregate(
        F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(t, lambda x: x == w)))
    )
    return F.when(same == 0, F.lit(0.0)).otherwise(2.0 * same / (F.size(p) + F.size(t)))


def final_answer(x: Column) -> Column:
    """The answer block, else what follows the reasoning, else the text without the tag."""
    block = F.regexp_extract(x, r"(?s)<answer>(.*?)</answer>", 1)
    return F.when(x.rlike(r"(?s)<answer>.*?</answer>"), strip(block)).when(x.contains("</think>"), strip(F.element_at(F.split(x, "</think>"), -1))).otherwise(strip(F.replace(x, F.lit("<answer>"), F.lit(""))))


def python_code(x: Column) -> Column:
    """The last fenced block, or the whole text."""
    blocks = F.regexp_extract_all(x, F.lit(r"(?s)```(?:python)?(.*?)```"), F.lit(1))
    return F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(x)


def minerva_answer(x: Column) -> Column:
    found = F.regexp_extract(x, r"(?s)Final Answer: The final answer is(.*?)\. I hope it is correct\.", 1)
    return F.when(x.rlike(r"(?s)Final Answer: The final answer is.*?\. I hope it is correct\."), strip(found)).otherwise("[invalidanswer]")


def soft_format(x: Column, scale: float = 1.0) -> Column:
    return F.when(x.rlike(r"(?s)^.*?</think>\s*<answer>.*?</answer>"), F.lit(scale)).otherwise(F.lit(0.0))


def truncate_output(x: Column, limit: int = 500) -> Column:
    more = (F.length(x) - limit).cast("string")
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("... ["), more, F.lit(" more chars]"))).otherwise(x)


def shared_prefix_length(a: Column, b: Column) -> Column:
    """Characters two texts have in common from the start."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    first = F.array_position(F.transform(pairs, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False))), False)
    return F.when(F.least(F.length(a), F.length(b)) == 0, 0).when(first > 0, first - 1).otherwise(F.length(a))


def judge_score(x: Column) -> Column:
    """A ratio a/b, else a percentage, else the first number, else yes-words before no-words, else 0."""
    a = F.regexp_extract(x, r"(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)", 1)
    b = F.regexp_extract(x, r"(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)", 2)
    percent = F.regexp_extract(x, r"(\d+(?:\.\d+)?)\s*%", 1)
    number = F.regexp_extract(x, r"(\d+(?:\.\d+)?)", 1)
    low = F.lower(x)
    return (
        F.when((a != "") & (b.try_cast("double") > 0), a.try_cast("double") / b.try_cast("double"))
        .when(percent != "", percent.try_cast("double") / 100)
        .when(number != "", number.try_cast("double"))
        .when(low.rlike(r"\b(yes|correct|true|pass)\b") & ~low.rlike(r"\b(not|incorrect|wrong)\b"), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def user_query(x: Column, shapes: tuple[str, ...] = (r"(?s)<\|user\|>\n(.*?)\n<\|assistant\|>", r"(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>")) -> Column:
    """The last user turn of a rendered conversation in one of the shapes, else the text."""
    out = x
    for shape in reversed(shapes):
        found = F.regexp_extract_all(x, F.lit(shape), F.lit(1))
        out = F.when(F.size(found) > 0, strip(F.element_at(found, -1))).otherwise(out)
    return out


def json_object(x: Column) -> Column:
    """The first span from an opening brace to the last closing one that is JSON, also after a byte
    order mark is removed or doubled braces are made single; null if there is none."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(texts):
        import json

        def valid(s):
            try:
                json.loads(s)
                return True
            except ValueError:
                return False

        def one(text):
            last = (text or "").rfind("}")
            at = text.find("{") if last >= 0 else -1
            while 0 <= at < last:
                span = text[at : last + 1]
                for form in (span, span.replace("\ufeff", ""), span.replace("{{", "{").replace("}}", "}")):
                    if valid(form):
                        return form
                at = text.find("{", at + 1)
            return None

        return texts.map(one)

    return run(x)


def pack_bits(values: Column, width: int) -> Column:
    """Numbers below 2^width as bytes, ``width`` bits each, most significant first; the last byte is filled with 0."""
    bits = F.array_join(F.transform(values, lambda v: F.lpad(F.bin(v.cast("bigint")), width, "0")), "")
    n = F.ceil(F.length(bits) / 8).cast("int")
    full = F.rpad(bits, 8 * n, "0")
    return F.when(n > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.conv(F.substr(full, 8 * i + 1, F.lit(8)), 2, 16), 2, "0")), ""))).otherwise(F.lit(b""))


def unpack_bits(data: Column, width: int, n: Column) -> Column:
    """The first n numbers of ``pack_bits``."""
    hexes = F.hex(data)
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(hexes) / 2).cast("int") - 1)), lambda i: F.lpad(F.conv(F.substr(hexes, 2 * i + 1, F.lit(2)), 16, 2), 8, "0")), "")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(bits, width * i + 1, F.lit(width)), 2, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
