"""Repeated blocks and n-grams in texts, found with joins of positions instead of loops over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.functions.text import ngrams, paragraphs, sentences, split_words, strip

#: Phrases that count as short where they occur anywhere in a block.
SHORT_PHRASES = (
    "not sure|wait no|i think|maybe|probably|yes|no|ok|okay|right|wrong|correct|incorrect|true|false|good|bad|nice|great|awesome|terrible|wow|oh|hmm|um|uh|well|so|now|then|here|there|this|that|these|those|"
    "it|is|are|was|were|have|has|had|do|does|did|will|would|could|should|can|cannot|cant|dont|doesnt|isnt|arent|second < b|we can use:|we can use|first < a|third < c|fourth < d|a < b|b < c|c < d|d < e|e < f|"
    "f < g|g < h|x < y|y < z|i < j|j < k|k < l|l < m|m < n|n < o|o < p|p < q|q < r|r < s|s < t|t < u|u < v|v < w|w < x|return none|return true|return false|return 0|return 1|return -1|return null|return undefined"
)
TRANSITIONS = ("alternatively,", "therefore,", "however,")


def is_math_or_code(x: Column) -> Column:
    return x.rlike(r"[=+\-*/^()\[\]{}<>|&~!@#$%\\]") | x.rlike(r"(?U)\w+\([^)]*\)|\w+\s*=\s*\w+|\d+/\d+")


def is_code_line(x: Column) -> Column:
    """A statement, or a block with a bracket that is open on one side only."""
    one_sided = x.rlike(r"[(\[{][^)\]}]*$") | x.rlike(r"^[^(\[{]*[)\]}]")
    matched = x.rlike(r"[(\[{][^(\[{)\]}]*[)\]}]")
    statement = x.rlike(r"(?iU)^(?:import\s+|from\s+\w+\s+import|return\s+|\w+\s*[+\-*/]\s*=\s*\d+|for\s+|while\s+|if\s+|def\s+|class\s+|\w+\.\w+\(|\w+\s*=\s*\w+\()")
    return (one_sided & ~matched) | statement


def is_short_phrase(x: Column) -> Column:
    low = strip(F.lower(x))
    compare = x.rlike(r"(?U)^\w+\s*[<>]\s*\w+\z") & ~low.rlike("import|from|return|def|class|if|for|while")
    return low.rlike(SHORT_PHRASES) | compare


def is_complex_math(x: Column) -> Column:
    return x.rlike(
        r"(?U)math\.\w+\([^)]*\)|\w+\*\*[0-9]+|[0-9]+\s*[+\-*/]\s*[0-9]+|[a-zA-Z_]\w*\s*[+\-*/]\s*[a-zA-Z_]\w*|def\s+\w+\([^)]*\):|lambda\s+[^:]+:|\[[^\]]*for[^\]]*\]|\{[^}]*for[^}]*\}|\([^)]*for[^)]*\)"
    )


def is_structured(x: Column) -> Column:
    lines = F.transform(F.split(x, "\n"), strip)
    counted = lambda pattern: F.size(F.filter(lines, lambda s: s.rlike(pattern)))
    return (F.size(lines) >= 2) & ((counted(r"(?U)^\d+\.\s") >= 2) | (counted(r"(?U)^[\-*•]\s") >= 2))


def is_multi_line(x: Column) -> Column:
    return strip(x).contains("\n")


def is_transition(x: Column) -> Column:
    return strip(F.lower(x)).isin(*TRANSITIONS)


def block_runs(df: DataFrame, key: str, text: str, block: str = "line", shortest: int | None = None) -> DataFrame:
    """(key, block, first, total_count, consecutive_count) of blocks that occur more than once.

    Lines are sentences of at least 5 characters, paragraphs have at least 10. The longest run of
    neighbouring places comes from the islands of place minus row number.
    """
    shortest = shortest or (5 if block == "line" else 10)
    split = sentences if block == "line" else paragraphs
    items = df.select(key, F.posexplode(split(F.col(text))).alias("place", "block")).where(F.length("block") >= shortest)
    w = Window.partitionBy(key, "block").orderBy("place")
    islands = items.withColumn("island", F.col("place") - F.row_number().over(w)).groupBy(key, "block", "island").agg(F.count(F.lit(1)).alias("run"), F.min("place").alias("first"))
    return islands.groupBy(key, "block").agg(F.min("first").alias("first"), F.sum("run").alias("total_count"), F.max("run").alias("consecutive_count")).where("total_count > 1")


def repeated_ngrams(df: DataFrame, key: str, text: str, n: int = 3, least: int = 2) -> DataFrame:
    """(key, ngram, n, first) of n-grams of lower-case words that occur at least ``least`` times."""
    items = df.select(key, F.posexplode(ngrams(split_words(F.lower(F.col(text))), n)).alias("place", "ngram"))
    return items.groupBy(key, "ngram").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where(F.col("n") >= least)


def repetition_decision(df: DataFrame, key: str, text: str, paragraph_min: int = 10, sentence_min: int = 40, consecutive_min: int = 4) -> DataFrame:
    """(key, has_repetition, reason, repeated_block): the first block over its threshold, paragraphs
    before sentences. Texts without one have reason null; so have null texts."""
    base = df.select(key, F.col(text).alias("_t"), is_structured(F.col(text)).alias("_s"))
    flags = base.select(key, "_s")
    b = F.col("block")

    par = block_runs(base, key, "_t", "paragraph").join(flags, key)
    par = par.where(~((F.col("consecutive_count") == 1) & (F.length(b) < 20)) & ~is_code_line(b) & ~is_complex_math(b) & ~is_transition(b))
    need = paragraph_min * F.greatest(F.when(F.col("_s"), 3).otherwise(1), F.when(is_multi_line(b), 4).otherwise(1), F.when(is_math_or_code(b), 2).otherwise(1))
    need = F.when(F.col("consecutive_count") == 1, F.least(need * 2, F.lit(30))).otherwise(need)
    par = par.where(F.col("total_count") >= need).select(key, F.lit(0).alias("pass"), "first", "block", F.format_string("paragraph_repeated_%dx", "total_count").alias("reason"))

    line = block_runs(base, key, "_t", "line").join(flags, key).where(F.size(split_words(b)) > 1)
    times = F.greatest(F.when(is_math_or_code(b), 2).otherwise(1), F.when(F.col("_s"), 3).otherwise(1))
    short = is_short_phrase(b)
    skipped = is_code_line(b) | is_complex_math(b) | is_transition(b)
    total, run = F.col("total_count"), F.col("consecutive_count")
    reason = (
        F.when(short & (run >= consecutive_min * 2), F.format_string("line_repeated_%dx_consecutive_short_phrase", "total_count"))
        .when(short | skipped, F.lit(None))
        .when(run >= consecutive_min * times, F.format_string("line_repeated_%dx_consecutive", "total_count"))
        .when((total >= sentence_min * times) & (F.length(b) >= 10), F.format_string("line_repeated_%dx", "total_count"))
    )
    line = line.select(key, F.lit(1).alias("pass"), "first", "block", reason.alias("reason")).where("reason is not null")

    hit = par.unionByName(line).groupBy(key).agg(F.min_by(F.struct("reason", "block"), F.struct("pass", "first")).alias("h"))
    return base.select(key).join(hit, key, "left").select(key, F.col("h").isNotNull().alias("has_repetition"), F.col("h.reason").alias("reason"), F.col("h.block").alias("repeated_block"))
