"""Instruction-following checks as boolean columns (or, where no native form exists, as vectorised UDFs).

``CHECKS`` maps the key of an instruction to a function of the response column and its arguments.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

from mixloom.functions.text import count_matches, split_words, strip, word_tokens

LOOK_BEHIND_SENTENCE = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"


def _quantified(n: Column, quantifier: str, target: int, slack: int) -> Column:
    if quantifier == "at least":
        return n >= target
    if quantifier == "at most":
        return n <= target
    if quantifier == "around":
        return F.abs(n - target) <= slack
    return F.lit(False)


def _relation(n: Column, relation: str, target: int) -> Column:
    if relation not in ("less than", "at least"):
        raise ValueError(f"unknown relation {relation!r}")
    return n < target if relation == "less than" else n >= target


@pandas_udf(BooleanType())
def _is_json(texts: pd.Series) -> pd.Series:
    def ok(x):
        try:
            json.loads(x)
            return True
        except (TypeError, ValueError):
            return False

    return texts.map(ok)


# The 25 functions of the first family.


def keywords_present(x: Column, keywords: list[str]) -> Column:
    out = F.lit(True)
    for k in keywords:
        out = out & F.lower(x).contains(k.lower())
    return out


def keyword_frequency(x: Column, word: str, n: int) -> Column:
    tokens = F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b(\w+)\b"), F.lit(1))
    return F.size(F.filter(tokens, lambda t: t == word.lower())) == n


def no_forbidden(x: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & ~F.lower(x).contains(w.lower())
    return out


def letter_frequency(x: Column, letter: str, n: int) -> Column:
    if len(letter) != 1:
        raise ValueError("one letter expected")
    return F.length(x) - F.length(F.replace(x, F.lit(letter), F.lit(""))) == n


def response_language(x: Column, language: str) -> Column:
    """By share of function words; an approximation, see the README."""
    return _language(x) == language


#: Frequent function words by language.
_FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are be this by not or from at which but".split(),
    "de": "der die das und ist nicht ein eine mit von zu den auf für im dem sich des auch es an wird".split(),
    "fr": "le la les et des est une un dans que pour pas qui sur du au avec ce il ne se plus par".split(),
    "es": "el la los las y de que en un una es por con para no se del al lo como más su".split(),
}


@pandas_udf(StringType())
def _language(texts: pd.Series) -> pd.Series:
    scripts = (("ja", r"[぀-ヿ]"), ("zh", r"[一-鿿]"), ("ru", r"[Ѐ-ӿ]"), ("hi", r"[ऀ-ॿ]"), ("th", r"[฀-๿]"), ("ar", r"[؀-ۿ]"))

    def one(x):
        if not x:
            return None
        for lang, script in scripts:
            if len(re.findall(script, x)) > 0.2 * len(x):
                return lang
        words = re.findall(r"[^\W\d_]+", x.lower())
        counts = {k: sum(w in v for w in words) for k, v in ((k, frozenset(v)) for k, v in _FUNCTION_WORDS.items())}
        best = max(counts, key=counts.get)
        return best if counts[best] else None

    return texts.map(one)


def paragraph_count(x: Column, n: int) -> Column:
    cleaned = strip(F.array_join(F.transform(F.split(x, "\n"), strip), "\n"))
    parts = F.split(cleaned, r"\* \* \*")
    return (F.size(parts) == n) & F.forall(parts, lambda p: strip(p) != "")


def word_constraint(x: Column, n: int, quantifier: str) -> Column:
    return _quantified(F.size(split_words(strip(x))), quantifier, n, max(round(n * 0.1), 1))


def sentence_constraint(x: Column, n: int, quantifier: str) -> Column:
    return _quantified(F.size(F.split(x, LOOK_BEHIND_SENTENCE)), quantifier, n, 1)


def paragraph_starts(x: Column, n: int, word: str, i: int) -> Column:
    parts = F.split(x, "\n\n")
    return (F.size(parts) == n) & F.coalesce(F.startswith(F.lower(F.trim(F.try_element_at(parts, F.lit(i)))), F.lit(word.lower())), F.lit(False))


def postscript(x: Column, marker: str) -> Column:
    at = F.instr(x, marker)
    return (at > 0) & (F.length(strip(F.substr(x, at + len(marker)))) > 0)


def placeholders(x: Column, n: int) -> Column:
    return count_matches(x, r"\[(.*?)\]") >= n


def bullet_points(x: Column, n: int) -> Column:
    lines = F.transform(F.split(x, "\n"), strip)
    return F.size(F.filter(lines, lambda s: s.startswith("*") | s.startswith("-"))) == n


def has_title(x: Column) -> Column:
    return x.rlike(r"<<(.*?)>>")


def chooses(x: Column, options: list[str]) -> Column:
    out = F.lit(False)
    for o in options:
        out = out | x.contains(o)
    return out


def highlighted(x: Column, n: int) -> Column:
    return count_matches(x, r"\*(.*?)\*") >= n


def sections(x: Column, n: int, splitter: str) -> Column:
    parts = F.split(x, re.escape(splitter))
    return F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) == n


def json_format(x: Column) -> Column:
    return _is_json(x)


def repeats_prompt(x: Column, prompt: Column) -> Column:
    return F.startswith(x, prompt)


def two_responses(x: Column) -> Column:
    parts = F.split(x, r"\*\*\*\*\*\*")
    return (F.size(parts) == 2) & F.coalesce(strip(F.try_element_at(parts, F.lit(1))) != strip(F.try_element_at(parts, F.lit(2))), F.lit(False))


def uppercase(x: Column) -> Column:
    return x == F.upper(x)


def lowercase(x: Column) -> Column:
    return x == F.lower(x)


def capital_words(x: Column, n: int, quantifier: str) -> Column:
    return _quantified(count_matches(x, r"(?U)\b[A-Z]+\b"), quantifier, n, max(round(n * 0.1), 1))


def ends_with(x: Column, phrase: str) -> Column:
    return x.endswith(phrase)


def quoted(x: Column) -> Column:
    return x.startswith('"') & x.endswith('"')


def no_commas(x: Column) -> Column:
    return ~x.contains(",")


# The checkers of the second family.


def keywords_exist(x: Column, keywords: list[str]) -> Column:
    out = F.lit(True)
    for k in keywords:
        out = out & x.rlike("(?i)" + k)
    return out


def keyword_count(x: Column, keyword: str, n: int, relation: str) -> Column:
    return _relation(count_matches(x, "(?i)" + keyword), relation, n)


def words_absent(x: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & ~x.rlike(r"(?iU)\b" + w + r"\b")
    return out


def letter_count(x: Column, letter: str, n: int, relation: str) -> Column:
    low = F.lower(x)
    return _relation(F.length(low) - F.length(F.replace(low, F.lit(letter.lower()), F.lit(""))), relation, n)


def number_words(x: Column, n: int, relation: str) -> Column:
    return _relation(F.size(word_tokens(x)), relation, n)


def number_sentences(x: Column, n: int, relation: str) -> Column:
    """By the rule splitter, not by a trained punkt model, see the README."""
    return _relation(F.size(F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: strip(s) != "")), relation, n)


def number_paragraphs(x: Column, n: int) -> Column:
    parts = F.split(x, r"\s?\*\*\*\s?")
    blank = F.transform(parts, lambda p: strip(p) == "")
    edge = F.when(F.element_at(blank, 1), 1).otherwise(0) + F.when((F.size(parts) > 1) & F.element_at(blank, -1), 1).otherwise(0)
    inner = F.when(F.size(parts) > 2, F.exists(F.slice(blank, 2, F.size(parts) - 2), lambda b: b)).otherwise(F.lit(False))
    return (F.size(parts) - edge == n) & ~inner


def nth_paragraph_first_word(x: Column, n: int, i: int, word: str) -> Column:
    parts = F.split(x, r"\n\n")
    full = F.size(F.filter(parts, lambda p: strip(p) != ""))
    paragraph = strip(F.try_element_at(parts, F.lit(i)))
    first = F.lower(F.regexp_extract(F.regexp_replace(F.element_at(F.split(paragraph, r"\s+"), 1), r"^['\"]+", ""), r"^([^.,?!'\"]*)", 1))
    return F.coalesce((full == n) & (first == word.lower()), F.lit(False))


def postscript_line(x: Column, marker: str) -> Column:
    shapes = {"P.P.S": r"(?m)\s*p\.\s?p\.\s?s.*$", "P.S.": r"(?m)\s*p\.\s?s\..*$"}
    return F.lower(x).rlike(shapes.get(marker, r"(?m)\s*" + marker.lower() + r".*$"))


def bullet_lists(x: Column, n: int) -> Column:
    return count_matches(x, r"(?m)^\s*\*[^\*].*$") + count_matches(x, r"(?m)^\s*-.*$") == n


def highlighted_sections(x: Column, n: int) -> Column:
    single = F.regexp_extract_all(x, F.lit(r"\*([^\n\*]*)\*"), F.lit(1))
    double = F.regexp_extract_all(x, F.lit(r"\*\*([^\n\*]*)\*\*"), F.lit(1))
    filled = lambda a: F.size(F.filter(a, lambda s: strip(s) != ""))
    return filled(single) + filled(double) >= n


def multiple_sections(x: Column, splitter: str, n: int) -> Column:
    return F.size(F.split(x, r"\s?" + splitter + r"\s?\d+\s?")) - 1 >= n


def json_fenced(x: Column) -> Column:
    bare = F.regexp_replace(strip(x), r"(?i)^```(json)?|```$", "")
    return _is_json(strip(bare))


def titled(x: Column) -> Column:
    return F.exists(F.regexp_extract_all(x, F.lit(r"<<([^\n]+)>>"), F.lit(1)), lambda t: strip(F.regexp_replace(t, r"^<+|>+$", "")) != "")


def two_different(x: Column) -> Column:
    parts = F.split(x, r"\*\*\*\*\*\*")
    inner = F.when(F.size(parts) > 2, F.exists(F.slice(parts, 2, F.size(parts) - 2), lambda p: strip(p) == "")).otherwise(F.lit(False))
    full = F.transform(F.filter(parts, lambda p: strip(p) != ""), strip)
    return (F.size(full) == 2) & ~inner & F.coalesce(F.try_element_at(full, F.lit(1)) != F.try_element_at(full, F.lit(2)), F.lit(False))


def repeats_prompt_first(x: Column, prompt: Column) -> Column:
    return F.startswith(F.lower(strip(x)), F.lower(strip(prompt)))


def ends_phrase(x: Column, phrase: str) -> Column:
    return F.endswith(F.lower(F.regexp_replace(strip(x), r"^\"+|\"+$", "")), F.lit(phrase.strip().lower()))


def in_quotes(x: Column) -> Column:
    s = strip(x)
    return (F.length(s) > 1) & s.startswith('"') & s.endswith('"')


def capital_word_frequency(x: Column, n: int, relation: str) -> Column:
    capital = F.filter(word_tokens(x), lambda w: (F.upper(w) == w) & (F.lower(w) != w))
    return _relation(F.size(capital), relation, n)


def english_case(x: Column, upper: bool) -> Column:
    return (x == (F.upper(x) if upper else F.lower(x))) & (F.coalesce(_language(x), F.lit("en")) == "en")


def absent(x: Column, mark: str) -> Column:
    return ~x.contains(mark)


def copies(x: Column, prompt: Column) -> Column:
    return F.lower(strip(x)) == F.lower(strip(prompt))


def copies_times(x: Column, prompt: Column, n: int) -> Column:
    parts = F.split(x, r"\*\*\*\*\*\*")
    return (F.size(parts) == n) & F.forall(parts, lambda p: F.lower(strip(p)) == F.lower(strip(prompt)))


def copies_span(x: Column, prompt: Column, start: int, end: int) -> Column:
    return F.lower(strip(x)) == F.lower(strip(F.substring(prompt, start + 1, end - start)))


def square_brackets(x: Column) -> Column:
    return F.forall(split_words(x), lambda w: w.startswith("[") & w.endswith("]"))


def bigram_wrapping(x: Column) -> Column:
    words = split_words(x)
    return F.when(F.size(words) < 2, F.lit(True)).otherwise(
        F.forall(F.sequence(F.lit(1), F.size(words) - 1, F.lit(2)), lambda i: F.element_at(words, i).startswith("<<") & F.element_at(words, i + 1).endswith(">>"))
    )


def no_adjacent_consecutive(x: Column) -> Column:
    words = split_words(x)
    first = lambda w: F.ascii(F.lower(F.substring(w, 1, 1)))
    return F.when(F.size(words) < 2, F.lit(True)).otherwise(F.forall(F.sequence(F.lit(1), F.size(words) - 1), lambda i: first(F.element_at(words, i + 1)) - first(F.element_at(words, i)) != 1))


def word_once(x: Column, keyword: str) -> Column:
    return count_matches(x, "(?i)" + keyword) == 1


def exclude_word(x: Column, keyword: str) -> Column:
    return ~x.contains(" " + keyword + " ")


def has_palindrome(x: Column) -> Column:
    return F.exists(split_words(x), lambda w: w == F.reverse(w))


def start_end(x: Column) -> Column:
    words = word_tokens(x)
    return (F.size(words) >= 2) & (F.lower(F.try_element_at(words, F.lit(1))) == F.lower(F.try_element_at(words, F.lit(-1))))


def two_parts(x: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(x, pattern), lambda p: strip(p) != "")) == 2


def first_word(x: Column, word: str) -> Column:
    return F.lower(F.try_element_at(split_words(x), F.lit(1))) == word.lower()


def last_word(x: Column, word: str) -> Column:
    return F.lower(F.regexp_replace(F.try_element_at(split_words(x), F.lit(-1)), r"(?U)[^\w\s]", "")) == word.lower()


def _by_sentence(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def first_word_each(x: Column, word: str) -> Column:
    return F.forall(_by_sentence(x), lambda s: F.lower(F.try_element_at(split_words(s), F.lit(1))) == word.lower())


def last_word_each(x: Column, word: str) -> Column:
    return F.forall(_by_sentence(x), lambda s: F.lower(F.regexp_replace(F.try_element_at(split_words(s), F.lit(-1)), r"(?U)[^\w\s]", "")) == word.lower())


def sentence_hyphens(x: Column) -> Column:
    by_mark = F.transform(_by_sentence(F.regexp_replace(x, "-", " ")), strip)
    by_hyphen = F.filter(F.transform(F.split(x, "-"), strip), lambda s: s != "")
    return F.size(by_mark) == F.size(by_hyphen)


def keyword_position(x: Column, keyword: str, sentence: int, word: int) -> Column:
    s = F.try_element_at(_by_sentence(x), F.lit(sentence))
    return F.coalesce(F.try_element_at(word_tokens(s), F.lit(word)) == keyword, F.lit(False))


def lowercase_counting(x: Column, n: int) -> Column:
    return count_matches(x, r"(?U)\b[a-z]+\b") <= n


def counting_composition(x: Column, n_sentences: int, n_words: int) -> Column:
    parts = F.filter(F.transform(F.split(x, r"\*\*\*"), strip), lambda p: p != "")
    return (F.size(parts) == 3) & F.forall(parts, lambda p: (F.size(_by_sentence(p)) == n_sentences) & F.forall(_by_sentence(p), lambda s: F.size(word_tokens(s)) == n_words))


def count_unique(x: Column) -> Column:
    words = word_tokens(x)
    return F.size(words) == F.size(F.array_distinct(words))


def count_increment(x: Column, first: str, second: str) -> Column:
    return (count_matches(x, "(?i)" + first) == 1) & (count_matches(x, "(?i)" + second) == 2)


def letter_counting(x: Column, n: int, relation: str) -> Column:
    return _relation(count_matches(x, "[a-zA-Z]"), relation, n)


@pandas_udf(BooleanType())
def _spans_differ_by_one(texts: pd.Series, phrases: pd.Series, times: pd.Series) -> pd.Series:
    def one(text, phrase, n):
        if text is None or not phrase:
            return None
        words = phrase.split()
        found = re.findall(re.escape(words[0]) + r"(.*?)" + re.escape(words[-1]), text)
        if len(found) < n:
            return False
        inner = words[1:-1]
        return all(sum(a != b for a, b in zip(f.split(), inner)) == 1 and len(f.split()) == len(inner) for f in found)

    return pd.Series([one(*x) for x in zip(texts, phrases, times)])


def repeat_phrase(x: Column, phrase: str, n: int) -> Column:
    return _spans_differ_by_one(x, F.lit(phrase), F.lit(n))


CHECKS = {
    "keywords:existence": keywords_exist, "keywords:frequency": keyword_count, "keywords:forbidden_words": words_absent, "keywords:letter_frequency": letter_count, "letters:letter_counting2": letter_count,
    "language:response_language": response_language, "length_constraints:number_sentences": number_sentences, "length_constraints:number_paragraphs": number_paragraphs, "length_constraints:number_words": number_words,
    "length_constraints:nth_paragraph_first_word": nth_paragraph_first_word, "detectable_content:number_placeholders": placeholders, "detectable_content:postscript": postscript_line, "detectable_format:number_bullet_lists": bullet_lists,
    "detectable_format:constrained_response": chooses, "detectable_format:number_highlighted_sections": highlighted_sections, "detectable_format:multiple_sections": multiple_sections, "detectable_format:json_format": json_fenced,
    "detectable_format:title": titled, "combination:two_responses": two_different, "combination:repeat_prompt": repeats_prompt_first, "startend:end_checker": ends_phrase, "startend:quotation": in_quotes,
    "change_case:capital_word_frequency": capital_word_frequency, "change_case:english_capital": lambda x: english_case(x, True), "change_case:english_lowercase": lambda x: english_case(x, False),
    "punctuation:no_comma": lambda x: absent(x, ","), "punctuation:punctuation_dot": lambda x: absent(x, "."), "punctuation:punctuation_exclamation": lambda x: absent(x, "!"), "copy:repeat_phrase": repeat_phrase,
    "copy:copy": copies, "copy:copying_simple": copies, "copy:copying_multiple": copies_times, "new:copy_span_idx": copies_span, "detectable_format:sentence_hyphens": sentence_hyphens, "detectable_format:square_brackets": square_brackets,
    "detectable_format:bigram_wrapping": bigram_wrapping, "keywords:no_adjacent_consecutive": no_adjacent_consecutive, "keywords:word_once": word_once, "keywords:word_count_different_numbers": keyword_count,
    "keywords:exclude_word_harder": exclude_word, "keywords:palindrome": has_palindrome, "keywords:keyword_specific_position": keyword_position, "keywords:start_end": start_end, "paragraphs:paragraphs": lambda x: two_parts(x, r"\s?\*\*\*\s?"),
    "paragraphs:paragraphs2": lambda x: two_parts(x, r"\n\n"), "first_word:first_word_sent": first_word_each, "first_word:first_word_answer": first_word, "last_word:last_word_sent": last_word_each, "last_word:last_word_answer": last_word,
    "count:lowercase_counting": lowercase_counting, "count:counting_composition": counting_composition, "count:count_unique": count_unique, "count:count_increment_word": count_increment, "letters:letter_counting": letter_counting,
}

FUNCTIONS = {
    "verify_keywords": keywords_present, "verify_keyword_frequency": keyword_frequency, "validate_forbidden_words": no_forbidden, "verify_letter_frequency": letter_frequency, "validate_response_language": response_language,
    "verify_paragraph_count": paragraph_count, "validate_word_constraint": word_constraint, "verify_sentence_constraint": sentence_constraint, "validate_paragraphs": paragraph_starts, "verify_postscript": postscript,
    "validate_placeholders": placeholders, "verify_bullet_points": bullet_points, "validate_title": has_title, "validate_choice": chooses, "validate_highlighted_sections": highlighted, "validate_sections": sections,
    "validate_json_format": json_format, "validate_repeat_prompt": repeats_prompt, "validate_two_responses": two_responses, "validate_uppercase": uppercase, "validate_lowercase": lowercase,
    "validate_frequency_capital_words": capital_words, "validate_end": ends_with, "validate_quotation": quoted, "validate_no_commas": no_commas,
}


def conflicts_closure(pairs):
    """Symmetric closure of a conflict relation given as a DataFrame (a, b)."""
    return pairs.union(pairs.select("b", "a")).distinct()
