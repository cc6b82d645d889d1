"""Queries over texts and messages, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixloom.functions import following as I
from mixloom.functions import text as T
from mixloom.functions import verifiers as V
from mixloom.functions.names import dataset_key, lang_key
from mixloom.operators import decontam, filters, joins, messages, repetition, stats, tokenize
from mixloom.plans.registry import run_transforms

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: White space and word characters as RE2 classes.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NWS = WS.replace("[", "[^", 1)
W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"
CONTENTS = "list_transform(messages, lambda m: m.content)"
ASSISTANT = "list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: m.content)"
LAST = f"{ASSISTANT}[-1]"
#: Stimuli the data lack, appended to the last message of every row by its id, alike in both dialects.
STIMULI = (
    "", " <think>plan</think> <answer>42</answer>", " I am a language model trained by OpenAI and friends.", " My knowledge cutoff June 2024 holds.", " 漢字漢字漢字漢字漢字", " ChatGPT said so.",
    "\n\n* * *\n\nP.S. Done [name] <<Title>> *bold*", " The answer is: 1,234", " As of my last update in March 2023.", " {\"a\": 1}", " <code>x = 1</code> <search>cats</search>",
)


def q(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '{NWS}+')"


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def train(spark, sf):
    return read(spark, sf, "train_rows")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stimulated(spark, sf):
    """Every training row with its last content and a stimulus, as ``x``."""
    last = F.coalesce(F.try_element_at(filters.contents(F.col("messages")), F.lit(-1)), F.lit(""))
    extra = F.lit("")
    for i, s in enumerate(STIMULI):
        extra = F.when(F.pmod("row_id", F.lit(len(STIMULI))) == i, F.lit(s)).otherwise(extra)
    return train(spark, sf).select("row_id", F.concat(last, extra).alias("x"))


STIM = f"(select row_id, coalesce({CONTENTS}[-1], '') || case row_id % {len(STIMULI)} " + " ".join(f"when {i} then {_lit(s)}" for i, s in enumerate(STIMULI)) + " end as x from train_rows) s"

# -- statistics ---------------------------------------------------------------------------------

_MEASURES = f"""with m as (select row_id, list_filter(messages, lambda m: m.role <> 'system') as ms from train_rows
  where messages is not null and len(list_filter(messages, lambda m: {strip_sql("coalesce(m.content, '')")} = '')) = 0),
n as (select row_id, len(ms) as turns, list_sum(list_transform(ms, lambda m: len({words_sql('m.content')})))::double as tokens,
  list_sum(list_transform(list_filter(ms, lambda m: m.role = 'user'), lambda m: len({words_sql('m.content')})))::double as user_tokens from m where len(ms) > 0)"""


def conversation_sizes(spark, sf):
    rows = train(spark, sf).where("messages is not null").where(~filters.has_blank(F.col("messages")))
    ms = F.filter("messages", lambda m: m["role"] != "system")
    count = lambda a: F.aggregate(a, F.lit(0), lambda s, m: s + T.count_matches(m["content"], r"(?U)\S+"))
    return rows.select("row_id", ms.alias("ms")).where(F.size("ms") > 0).select("row_id", F.size("ms").alias("turns"), count(F.col("ms")).alias("tokens"), count(F.filter("ms", lambda m: m["role"] == "user")).alias("user_tokens"))


@q(
    _MEASURES
    + """, l as (select 'turns' as measure, turns::double as v from n union all select 'tokens', tokens from n union all select 'user_tokens', coalesce(user_tokens, 0) from n)
select measure, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, min(v) as least, quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, max(v) as most from l group by measure"""
)
def conv_turn_stats(spark, sf):
    d = stats.describe(conversation_sizes(spark, sf), ["turns", "tokens", "user_tokens"])
    return d.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@q(_MEASURES + " select count(*) filter (tokens > 512) as over_512, count(*) filter (tokens > 768) as over_768, count(*) filter (tokens > 1024) as over_1024, count(*) filter (tokens > 64) as over_64, count(*) as n from n")
def conv_over_thresholds(spark, sf):
    return stats.over_thresholds(conversation_sizes(spark, sf), "tokens", (512, 768, 1024, 64))


@q(_MEASURES + " select row_id, tokens::bigint as tokens from n order by tokens desc, row_id limit 100")
def conv_longest_topk(spark, sf):
    return stats.longest(conversation_sizes(spark, sf).select("row_id", F.col("tokens").cast("bigint").alias("tokens")), "row_id", "tokens", 100)


@q("select source, bin, count(*) as n from (select source, case when n_chars >= 0 and n_chars < 200 then 0 when n_chars < 500 then 1 when n_chars < 1000 then 2 when n_chars < 2000 then 3 when n_chars <= 50000 then 4 end as bin from documents) where bin is not null group by 1, 2")
def doc_length_histogram(spark, sf):
    return stats.histogram(read(spark, sf, "documents"), "source", "n_chars", [0, 200, 500, 1000, 2000, 50000])


@q("with c as (select coalesce(dataset, 'none') as d, count(*) as n from train_rows group by 1) select case when n >= 20 then d else 'Other' end as d, sum(n)::bigint as n from c group by 1")
def rare_datasets_to_other(spark, sf):
    d = train(spark, sf).select(F.coalesce("dataset", F.lit("none")).alias("d"))
    return stats.rare_to_other(d, "d", 20).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


_DS = f"nullif(lower(regexp_replace({strip_sql('regexp_replace(dataset, ' + chr(39) + '^.*/' + chr(39) + ', ' + chr(39) + chr(39) + ')')}, '-|_|{WS}', '_', 'g')), '')"


@q(f"with k as (select {_DS} as dataset, row_id from train_rows) select k.dataset, i.domain, count(*) as deliveries, count(distinct k.row_id) as examples from k left join dataset_info i on i.dataset = k.dataset group by 1, 2")
def dataset_sizes(spark, sf):
    k = train(spark, sf).select(dataset_key(F.col("dataset")).alias("dataset"), "row_id")
    return k.groupBy("dataset").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("row_id").alias("examples")).join(read(spark, sf, "dataset_info"), "dataset", "left").select("dataset", "domain", "deliveries", "examples")


@q(f"select count(*) as n, count(*) filter (x <> '') as kept, round(avg(len({words_sql('x')})), 6) as mean_words from {STIM}")
def text_summary(spark, sf):
    s = stimulated(spark, sf)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") != "").alias("kept"), F.round(F.avg(F.size(T.split_words(F.col("x")))), 6).alias("mean_words"))


# -- filters ------------------------------------------------------------------------------------


@q(f"select row_id, coalesce(len(list_filter(messages, lambda m: {strip_sql(chr(99) + 'oalesce(m.content, ' + chr(39) * 2 + ')')} = '')) > 0, false) as blank from train_rows")
def blank_messages(spark, sf):
    return train(spark, sf).select("row_id", filters.has_blank(F.col("messages")).alias("blank"))


_KEY_SQL = filters.KEYWORDS.replace("'", "''")


@q(f"select row_id from {STIM} where regexp_matches(lower(x), '\\b({_KEY_SQL})\\b')")
def keyword_filter(spark, sf):
    s = stimulated(spark, sf).withColumn("messages", F.array(F.struct(F.lit("assistant").alias("role"), F.col("x").alias("content"))))
    return s.where(filters.names_assistant(F.col("messages"))).select("row_id")


_ID_SQL = "|".join(filters.IDENTITY).replace("'", "''")


@q(f"select row_id from {STIM} where regexp_matches(x, '(?i)(?:{_ID_SQL})')")
def identity_filter(spark, sf):
    s = stimulated(spark, sf).withColumn("messages", F.array(F.struct(F.lit("assistant").alias("role"), F.col("x").alias("content"))))
    return s.where(filters.tells_provider(F.col("messages"))).select("row_id")


@q(f"select row_id, unnest(regexp_extract_all(x, '{filters.CUTOFF}', 1)) as mention from {STIM}")
def cutoff_dates(spark, sf):
    s = stimulated(spark, sf).withColumn("messages", F.array(F.struct(F.lit("assistant").alias("role"), F.col("x").alias("content"))))
    return s.select("row_id", F.explode(filters.cutoff_mentions(F.col("messages"))).alias("mention"))


@q(f"select row_id from {STIM} where not regexp_matches(x, '{filters.CUTOFF}')")
def cutoff_removal(spark, sf):
    s = stimulated(spark, sf)
    bad = s.where(F.size(F.regexp_extract_all("x", F.lit(filters.CUTOFF), F.lit(1))) > 0).select("row_id").distinct()
    return s.select("row_id").join(bad, "row_id", "left_anti")


@q(f"select row_id, round((length(x) - length(regexp_replace(x, '[一-鿿]', '', 'g'))) / length(x), 6) as ratio from {STIM} where length(x) > 0 and (length(x) - length(regexp_replace(x, '[一-鿿]', '', 'g'))) / length(x) >= 0.05")
def cjk_filter(spark, sf):
    s = stimulated(spark, sf).withColumn("ratio", filters.cjk_ratio(F.col("x")))
    return s.where("ratio >= 0.05").select("row_id", F.round("ratio", 6).alias("ratio"))


@q(f"select row_id, regexp_matches(x, '(?s)^<think>.*?</think>.*$') as think, regexp_matches(x, '(?s)^<think>.*?</think>\\s*<answer>.*?</answer>$') as think_answer from (select row_id, '<think>' || x || '</think> <answer>a</answer>' || (case when row_id % 2 = 0 then '' else ' ' end) as x from {STIM})")
def think_formats(spark, sf):
    x = F.concat(F.lit("<think>"), "x", F.lit("</think> <answer>a</answer>"), F.when(F.col("row_id") % 2 == 0, "").otherwise(" "))
    return stimulated(spark, sf).select("row_id", x.alias("x")).select("row_id", filters.think_format(F.col("x")).alias("think"), filters.think_answer_format(F.col("x")).alias("think_answer"))


@q(f"select row_id, replace(replace(replace(replace(x, '<think>', chr(10)), '</think>', ''), '<answer>', chr(10) || chr(10)), '</answer>', '') as x from {STIM}")
def special_token_strip(spark, sf):
    return stimulated(spark, sf).select("row_id", T.strip_special_tokens(F.col("x")).alias("x"))


@q("select row_id, case when lower(trim(coalesce(lang, ''))) in ('', 'und', 'unknown') then 'und' else coalesce(map_extract(map {'eng':'en','english':'en','deu':'de','german':'de','fra':'fr','french':'fr','spa':'es','spanish':'es','rus':'ru','russian':'ru','zho':'zh','chinese':'zh','jpn':'ja','japanese':'ja'}, regexp_extract(lower(trim(lang)), '^([^-_]*)', 1))[1], regexp_extract(lower(trim(lang)), '^([^-_]*)', 1)) end as lang from train_rows")
def language_keys(spark, sf):
    return train(spark, sf).select("row_id", lang_key(F.col("lang")).alias("lang"))


@q("select doc_id from documents where lower(coalesce(lang, '')) = 'en' and not coalesce(source like '%forum%', false) and not coalesce(kind = 'transcript', false)")
def toxic_language_filter(spark, sf):
    return read(spark, sf, "documents").where(filters.clean_metadata(F.col("source").contains("forum"), F.col("kind") == "transcript", F.col("lang"), "EN")).select("doc_id")


@q(f"select row_id, {LAST} as x from train_rows where {LAST} is not null")
def last_answers(spark, sf):
    return train(spark, sf).select("row_id", filters.last_content(F.col("messages")).alias("x")).where("x is not null")


@q(f"select row_id, unnest(regexp_extract_all(x, '(?s)<(code|search)>(.*?)</(?:code|search)>', 1)) as tool, unnest(regexp_extract_all(x, '(?s)<(code|search)>(.*?)</(?:code|search)>', 2)) as content from {STIM}")
def tool_calls(spark, sf):
    return stimulated(spark, sf).select("row_id", F.explode(joins.tool_calls(F.col("x"), ["code", "search"])).alias("c")).select("row_id", "c.tool", "c.content")


@q("select row_id, prompt_id from train_rows t where messages is not null and exists (select 1 from completions c where c.prompt_id = t.prompt_id)")
def prompts_with_completions(spark, sf):
    return train(spark, sf).where("messages is not null").join(read(spark, sf, "completions").select("prompt_id").distinct(), "prompt_id", "left_semi").select("row_id", "prompt_id")


# -- formats ------------------------------------------------------------------------------------


@q(f"select row_id, array_to_string(list_transform(list_filter(messages, lambda m: coalesce(m.content, '') <> ''), lambda m: upper(m.role[1]) || lower(m.role[2:]) || ': ' || m.content), chr(10) || chr(10)) as x from train_rows where messages is not null")
def messages_to_text(spark, sf):
    return train(spark, sf).where("messages is not null").select("row_id", messages.to_text(F.col("messages")).alias("x"))


@q("select row_id, array_to_string(list_transform(list_filter(messages, lambda m: m.content is not null), lambda m: (case when m.role = 'user' then 'User A: ' else 'User B: ' end) || m.content), chr(10)) as x from train_rows where messages is not null")
def messages_to_users(spark, sf):
    kept = F.filter("messages", lambda m: m["content"].isNotNull())
    return train(spark, sf).where("messages is not null").select("row_id", messages.to_users(kept).alias("x"))


@q("select row_id, array_to_string(list_transform(list_filter(messages, lambda m: m.content is not null), lambda m: m.role || ': ' || m.content), chr(10)) as x from train_rows where messages is not null")
def raw_prompts(spark, sf):
    kept = F.filter("messages", lambda m: m["content"].isNotNull())
    return train(spark, sf).where("messages is not null").select("row_id", messages.raw_prompt(kept).alias("x"))


_INSTR = messages.ALPACA_PLAIN.replace("{i}", "' || text || '").replace("\n", "' || chr(10) || '")
_INSTR_X = messages.ALPACA.replace("{i}", "' || text || '").replace("{x}", "' || dataset || '").replace("\n", "' || chr(10) || '")


@q(f"select gen_id, case when coalesce(dataset, '') <> '' then '{_INSTR_X}' else '{_INSTR}' end as prompt, coalesce(model, '-') as answer from completions")
def instruction_format(spark, sf):
    c = read(spark, sf, "completions").select("gen_id", messages.from_instruction(F.col("text"), F.col("dataset"), F.coalesce("model", F.lit("-"))).alias("m"))
    return c.select("gen_id", F.col("m")[0]["content"].alias("prompt"), F.col("m")[1]["content"].alias("answer"))


@q("select gen_id, o.n - 1 as place, case when (o.n - 1) % 2 = 0 then 'user' else 'assistant' end as role, o.t as content from (select gen_id, unnest(list_transform(range(1, len(outputs) - len(outputs) % 2 + 1), lambda i: {'n': i, 't': outputs[i].text})) as o from completions where outputs is not null)")
def positional_roles(spark, sf):
    c = read(spark, sf, "completions").where("outputs is not null").select("gen_id", messages.positional(F.transform("outputs", lambda o: o["text"])).alias("m"))
    return c.select("gen_id", F.posexplode("m").alias("place", "m")).select("gen_id", F.col("place").cast("bigint").alias("place"), "m.role", "m.content")


@q("select gen_id, array_to_string(list_transform(range(1, len(outputs) + 1), lambda i: i::varchar || '. ' || outputs[i].text), chr(10) || chr(10)) as x from completions where outputs is not null and len(list_filter(outputs, lambda o: o.text is null)) = 0")
def numbered_outputs(spark, sf):
    c = read(spark, sf, "completions").where("outputs is not null").where(~F.exists("outputs", lambda o: o["text"].isNull()))
    return c.select("gen_id", messages.numbered(F.transform("outputs", lambda o: o["text"])).alias("x"))


@q("select row_id, coalesce(len(messages) > 0 and len(list_filter(range(1, len(messages) + 1), lambda i: messages[i].role is distinct from (case when i % 2 = 1 then 'user' else 'assistant' end))) = 0, false) as alternates from train_rows")
def role_alternation(spark, sf):
    return train(spark, sf).select("row_id", messages.alternates(F.col("messages")).alias("alternates"))


@q("select row_id, case when len(list_filter(messages, lambda m: m.role = 'system')) > 0 then len(messages) else len(messages) + 1 end as n from train_rows where messages is not null")
def system_prepended(spark, sf):
    return train(spark, sf).where("messages is not null").select("row_id", F.size(messages.prepend_system(F.col("messages"), "You are helpful.")).cast("bigint").alias("n"))


def _template_sql(parts: dict[str, tuple[str, str, str]], messages_col: str = "messages") -> str:
    case = " ".join(f"when messages[i].role = '{r}' then {_lit(a)} || coalesce(messages[i].content, '') || (case when i = len(messages) then {_lit(z)} else {_lit(b)} end)" for r, (a, b, z) in parts.items())
    return f"array_to_string(list_transform(range(1, len(messages) + 1), lambda i: case {case} else '' end), '')"


@q("select row_id, " + _template_sql({"system": ("<|system|>\n", "\n", "\n"), "user": ("<|user|>\n", "\n", "\n"), "assistant": ("<|assistant|>\n", "</s>\n", "</s>")}) + " as x from train_rows where messages is not null")
def template_tagged(spark, sf):
    return train(spark, sf).where("messages is not null").select("row_id", tokenize.template("tagged", F.col("messages")).alias("x"))


@q("select row_id, " + _template_sql({r: (f"<|{r}|>\n", "</s>\n", "</s>\n") for r in ("system", "user", "assistant")}) + " || (case when len(messages) > 0 then '<|assistant|>' || chr(10) else '' end) as x from train_rows where messages is not null")
def template_tagged_eos(spark, sf):
    return train(spark, sf).where("messages is not null").select("row_id", tokenize.template("tagged_eos", F.col("messages"), generation=True).alias("x"))


@q("select row_id, " + _template_sql({"system": ("<|im_start|>system\n", "<|im_end|>\n", "<|im_end|>\n"), "user": ("<|im_start|>user\n", "<|im_end|>\n", "<|im_end|>\n"), "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n", "</s>")}) + " as x from train_rows where messages is not null")
def template_im(spark, sf):
    return train(spark, sf).where("messages is not null").select("row_id", tokenize.template("im", F.col("messages")).alias("x"))


@q("select row_id, array_to_string(list_transform(range(1, len(messages) + 1), lambda i: (case when i = 1 then '' else chr(10) || chr(10) end) || upper(messages[i].role[1]) || lower(messages[i].role[2:]) || ': ' || coalesce(messages[i].content, '')), '') || (case when len(messages) > 0 then '</s>' else '' end) as x from train_rows where messages is not null")
def template_simple_chat(spark, sf):
    return train(spark, sf).where("messages is not null").select("row_id", tokenize.template("simple_chat", F.col("messages")).alias("x"))


@q("select row_id, array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: coalesce(m.content, '')), '') as x from train_rows where messages is not null")
def template_assistant_only(spark, sf):
    return train(spark, sf).where("messages is not null").select("row_id", tokenize.template("assistant_only", F.col("messages")).alias("x"))


@q()
def sft_tokens(spark, sf):
    rows = train(spark, sf).select("row_id", "messages").where("messages is not null and size(messages) > 0")
    out = run_transforms(rows, [("drop_blank", {}), ("sft_tokenize", {"mask_prompt": True}), ("sft_filter", {"max_tokens": 4096})])
    return out.select("row_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != -100)).alias("trainable"))


@q()
def sft_masked_spans(spark, sf):
    rows = train(spark, sf).select("row_id", "messages").where("messages is not null and size(messages) > 0").where(~filters.has_blank(F.col("messages")))
    out = run_transforms(rows, [("sft_tokenize_assistant", {"limit": None})])
    return out.select("row_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != -100)).alias("trainable"))


@q()
def context_windows(spark, sf):
    rows = train(spark, sf).where("messages is not null")
    return rows.select("row_id", tokenize.fits_context(F.col("messages"), 64, 256).alias("fits"), F.size(tokenize.truncate_messages(F.col("messages"), 64)).alias("kept"))


# -- functions, verifiers, checks ---------------------------------------------------------------

_PUNCT = "[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]"


def norm_sql(x: str) -> str:
    return f"array_to_string({words_sql(f'regexp_replace(regexp_replace(lower({x}), {chr(39)}{_PUNCT}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)}), {chr(39)}\\b(a|an|the)\\b{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, ' ')"


# normalized_answers has plain ASCII texts only, as its SQL does; this has every item. SQL has no equal
# of Unicode white space and word borders, so none is given.
@q()
def normalized_answers_all(spark, sf):
    return read(spark, sf, "eval_items").select("item_id", T.normalize_answer(F.col("text")).alias("x"))


@q(f"select row_id, coalesce(lower(coalesce(regexp_extract_all(regexp_replace(x, '([0-9]),([0-9])', '\\1\\2', 'g'), '[-+]?(?:[0-9]*\\.[0-9]+|[0-9]+)')[-1], x)) = '1234', false)::int::double as score from {STIM}")
def verify_gsm8k(spark, sf):
    return stimulated(spark, sf).select("row_id", V.gsm8k(F.col("x"), F.lit("1234")).alias("score"))


@q(f"select row_id, case when contains(x, '<answer>') and contains(x, '</answer>') and {norm_sql('string_split(string_split(x, ' + chr(39) + '<answer>' + chr(39) + ')[-1], ' + chr(39) + '</answer>' + chr(39) + ')[1]')} = '42' then 1.0::double else 0.0::double end as score from {STIM}")
def verify_string_matcher(spark, sf):
    return stimulated(spark, sf).select("row_id", V.string_matcher(F.col("x"), F.lit("42")).alias("score"))


@q(f"select row_id, (regexp_matches(x, '(?s)^.*?</think>\\s*<answer>.*?</answer>'))::int::double as score from {STIM}")
def verify_soft_format(spark, sf):
    return stimulated(spark, sf).select("row_id", T.soft_format(F.col("x")).alias("score"))


@q(f"select row_id, round(1 - abs(len({words_sql('x')}) - 30) / 8192, 6)::double as exact, round(case when len({words_sql('x')}) < 30 then 1.0 else 1 - (len({words_sql('x')}) - 30) / 8192 end, 6)::double as at_most from {STIM}")
def verify_lengths(spark, sf):
    n = F.size(T.split_words(F.col("x")))
    return stimulated(spark, sf).select("row_id", F.round(V.max_length(n, F.lit(30)), 6).alias("exact"), F.round(V.up_to_max_length(n, F.lit(30)), 6).alias("at_most"))


def _thoughtless(x: str) -> str:
    tail = f"string_split(replace({x}, '<|assistant|>', ''), '</think>')[-1]"
    return strip_sql(f"replace(replace({tail}, '<answer>', ''), '</answer>', '')")


@q(
    f"""with o as (select gen_id, i - 1 as n, text, outputs[i].text as x from (select *, unnest(range(1, len(outputs) + 1)) as i from completions) where outputs[i].text is not null),
t as (select gen_id, n, {norm_sql(_thoughtless('x'))} as a, {norm_sql('text')} as b from o), w as (select *, list_filter(string_split(a, ' '), lambda v: v <> '') as p, list_filter(string_split(coalesce(b, ''), ' '), lambda v: v <> '') as q from t),
s as (select *, coalesce(list_sum(list_transform(list_distinct(p), lambda v: least(len(list_filter(p, lambda y: y = v)), len(list_filter(q, lambda y: y = v))))), 0) as same from w)
select gen_id, n::int as n, round(case when same = 0 then 0 else 2.0 * same / (len(p) + len(q)) end, 6)::double as f1, coalesce(a = b, false)::int::double as same from s"""
)
def verify_f1(spark, sf):
    c = read(spark, sf, "completions").where("outputs is not null").select("gen_id", "text", F.posexplode("outputs").alias("n", "o"))
    return c.where("o.text is not null").select("gen_id", "n", F.round(V.string_f1(F.col("o.text"), F.array("text")), 6).alias("f1"), V.puzzle(F.col("o.text"), F.col("text")).alias("same"))


@q()
def verify_math(spark, sf):
    c = read(spark, sf, "completions").where("outputs is not null").select("gen_id", F.posexplode("outputs").alias("n", "o"))
    answer = F.regexp_extract("o.text", r"boxed\{(-?\d+)\}|(-?\d+)\s*$", 1)
    return c.where("o.text is not null").select("gen_id", "n", V.math(F.col("o.text"), answer).alias("math"), V.strict_math(F.col("o.text"), answer).alias("strict"))


_B = lambda x: f"coalesce({x}, false)"
_low = "lower(x)"


def bools(df, key, **columns):
    return df.select(key, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in columns.items()])


@q(
    f"""select row_id, contains(lower(x), 'the') and contains(lower(x), 'loss') as keywords, not (contains(lower(x), 'shard') or contains(lower(x), 'mask')) as forbidden,
length(x) - length(replace(x, 'e', '')) = 12 as letters, len({words_sql('x')}) >= 20 as words_least, len({words_sql('x')}) <= 40 as words_most, abs(len({words_sql('x')}) - 30) <= 3 as words_around,
len(regexp_extract_all(x, '\\[(.*?)\\]')) >= 1 as placeholders, regexp_matches(x, '<<(.*?)>>') as title, contains(x, 'yes') or contains(x, 'no') as choice, len(regexp_extract_all(x, '\\*(.*?)\\*')) >= 1 as highlighted,
x = upper(x) as upper, x = lower(x) as lower, len(list_filter(regexp_extract_all(x, '{W}+'), lambda w: regexp_matches(w, '^[A-Z]+$'))) >= 2 as capitals, suffix(x, '.') as ends, prefix(x, '"') and suffix(x, '"') as quoted, not contains(x, ',') as no_commas,
prefix(x, 'The') as repeats, instr(x, 'P.S.') > 0 and length({strip_sql("substr(x, instr(x, 'P.S.') + 4)")}) > 0 as postscript,
len(list_filter(string_split(x, chr(10)), lambda s: prefix({strip_sql('s')}, '*') or prefix({strip_sql('s')}, '-'))) = 3 as bullets,
len(string_split(x, '******')) = 2 as two, len(string_split(x, chr(10) || chr(10))) = 2 and prefix(lower(trim(string_split(x, chr(10) || chr(10))[2])), 'the') as paragraph_starts from {STIM}"""
)
def instruction_functions(spark, sf):
    x = F.col("x")
    return bools(
        stimulated(spark, sf), "row_id", keywords=I.keywords_present(x, ["the", "loss"]), forbidden=I.no_forbidden(x, ["shard", "mask"]), letters=I.letter_frequency(x, "e", 12),
        words_least=I.word_constraint(x, 20, "at least"), words_most=I.word_constraint(x, 40, "at most"), words_around=I.word_constraint(x, 30, "around"), placeholders=I.placeholders(x, 1), title=I.has_title(x),
        choice=I.chooses(x, ["yes", "no"]), highlighted=I.highlighted(x, 1), upper=I.uppercase(x), lower=I.lowercase(x), capitals=I.capital_words(x, 2, "at least"), ends=I.ends_with(x, "."), quoted=I.quoted(x),
        no_commas=I.no_commas(x), repeats=I.repeats_prompt(x, F.lit("The")), postscript=I.postscript(x, "P.S."), bullets=I.bullet_points(x, 3), two=I.two_responses(x), paragraph_starts=I.paragraph_starts(x, 2, "the", 2),
    )


@q(
    f"""select row_id, regexp_matches(x, '(?i)loss') and regexp_matches(x, '(?i)rate') as existence, len(regexp_extract_all(x, '(?i)rate')) >= 1 as frequency,
length(lower(x)) - length(replace(lower(x), 'a', '')) < 10 as letter, len(regexp_extract_all(x, '{W}+')) >= 20 as words, len(regexp_extract_all(x, '\\[(.*?)\\]')) >= 1 as placeholders,
len(list_filter(regexp_extract_all(x, '<<([^\\n]+)>>', 1), lambda t: {strip_sql("t")} <> '')) > 0 as title, not contains(x, ',') as no_comma, not contains(x, '.') as no_dot, not contains(x, '!') as no_exclamation,
len(regexp_extract_all(x, '(?i)the')) = 1 as once, not contains(x, ' the ') as exclude, len(list_filter({words_sql('x')}, lambda w: w = reverse(w))) > 0 as palindrome,
len(list_filter(regexp_extract_all(x, '{W}+'), lambda w: regexp_matches(w, '^[a-z]+$'))) <= 30 as lowercase, len(regexp_extract_all(x, '[a-zA-Z]')) >= 100 as letters, len(regexp_extract_all(x, '{W}+')) = len(list_distinct(regexp_extract_all(x, '{W}+'))) as distinct_words,
len(list_filter(list_transform(string_split(x, chr(10) || chr(10)), lambda p: {strip_sql('p')}), lambda p: p <> '')) = 2 as paragraphs2,
len({words_sql('x')}) > 0 and len(list_filter({words_sql('x')}, lambda w: not (prefix(w, '[') and suffix(w, ']')))) = 0 or len({words_sql('x')}) = 0 as brackets, coalesce(lower({words_sql('x')}[1]) = 'the', false) as first_word,
length({strip_sql('x')}) > 1 and prefix({strip_sql('x')}, '"') and suffix({strip_sql('x')}, '"') as quotation, regexp_matches(lower(x), '(?m)\\s*p\\.\\s?s\\..*$') as postscript from {STIM}"""
)
def instruction_checks(spark, sf):
    x = F.col("x")
    c = I.CHECKS
    return bools(
        stimulated(spark, sf), "row_id", existence=c["keywords:existence"](x, ["loss", "rate"]), frequency=c["keywords:frequency"](x, "rate", 1, "at least"), letter=c["keywords:letter_frequency"](x, "a", 10, "less than"),
        words=c["length_constraints:number_words"](x, 20, "at least"), placeholders=c["detectable_content:number_placeholders"](x, 1), title=c["detectable_format:title"](x), no_comma=c["punctuation:no_comma"](x),
        no_dot=c["punctuation:punctuation_dot"](x), no_exclamation=c["punctuation:punctuation_exclamation"](x), once=c["keywords:word_once"](x, "the"), exclude=c["keywords:exclude_word_harder"](x, "the"),
        palindrome=c["keywords:palindrome"](x), lowercase=c["count:lowercase_counting"](x, 30), letters=c["letters:letter_counting"](x, 100, "at least"), distinct_words=c["count:count_unique"](x),
        paragraphs2=c["paragraphs:paragraphs2"](x), brackets=c["detectable_format:square_brackets"](x), first_word=c["first_word:first_word_answer"](x, "the"), quotation=c["startend:quotation"](x), postscript=c["detectable_content:postscript"](x, "P.S."),
    )


@q()
def instruction_checks_more(spark, sf):
    x = F.col("x")
    c = I.CHECKS
    return bools(
        stimulated(spark, sf), "row_id", json=c["detectable_format:json_format"](x), sentences=c["length_constraints:number_sentences"](x, 2, "at least"), paragraphs=c["length_constraints:number_paragraphs"](x, 2),
        nth=c["length_constraints:nth_paragraph_first_word"](x, 2, 1, "the"), forbidden=c["keywords:forbidden_words"](x, ["loss"]), language=c["language:response_language"](x, "en"), capital=c["change_case:capital_word_frequency"](x, 1, "at least"),
        two=c["combination:two_responses"](x), end=c["startend:end_checker"](x, "again."), hyphens=c["detectable_format:sentence_hyphens"](x), adjacent=c["keywords:no_adjacent_consecutive"](x), position=c["keywords:keyword_specific_position"](x, "loss", 1, 2),
        start_end=c["keywords:start_end"](x), first=c["first_word:first_word_sent"](x, "the"), last=c["last_word:last_word_answer"](x, "again"), composition=c["count:counting_composition"](x, 1, 3), phrase=c["copy:repeat_phrase"](x, "the loss curve", 1),
        bigrams=c["detectable_format:bigram_wrapping"](x), bullets=c["detectable_format:number_bullet_lists"](x, 2), sections=c["detectable_format:multiple_sections"](x, "Step", 1), highlights=c["detectable_format:number_highlighted_sections"](x, 1),
    )


# -- repetition ---------------------------------------------------------------------------------


@q(
    f"""with i as (select doc_id, unnest(list_transform(range(1, len(s) + 1), lambda k: {{'p': k, 'b': s[k]}})) as u from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda y: {strip_sql('y')}), lambda y: y <> '') as s from documents where text is not null)),
t as (select doc_id, u.p as p, u.b as b, u.p - row_number() over (partition by doc_id, u.b order by u.p) as g from i where length(u.b) >= 5),
r as (select doc_id, b, g, count(*) as run, min(p) as f from t group by 1, 2, 3)
select doc_id, b as block, (min(f) - 1)::bigint as first, sum(run)::bigint as total_count, max(run)::bigint as consecutive_count from r group by 1, 2 having sum(run) > 1"""
)
def repeated_lines(spark, sf):
    return repetition.block_runs(read(spark, sf, "documents"), "doc_id", "text", "line").withColumn("first", F.col("first").cast("bigint"))


@q(
    f"""with w as (select doc_id, {words_sql("lower(replace(text, 'İ', 'i̇'))")} as t from documents where text is not null),
g as (select doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: {{'p': i - 1, 'g': t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]}})) as u from w where len(t) >= 3)
select doc_id, u.g as ngram, count(*) as n, min(u.p)::bigint as first from g group by 1, 2 having count(*) >= 2"""
)
def repeated_ngrams(spark, sf):
    return repetition.repeated_ngrams(read(spark, sf, "documents"), "doc_id", "text", 3, 2).withColumn("first", F.col("first").cast("bigint"))


@q()
def repetition_decisions(spark, sf):
    return repetition.repetition_decision(read(spark, sf, "documents"), "doc_id", "text", 3, 6, 2)


# -- decontamination ----------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower({0}), '[ ,.?!:;()\"\\-]|\\n|\\\\'), lambda t: t <> '')"
_DOCS = f"d as (select row_id, i.p as place, {_TOK.format('i.c')} as t from (select row_id, unnest(list_transform(range(1, len(messages) + 1), lambda k: {{'p': k - 1, 'r': messages[k].role, 'c': messages[k].content}})) as i from train_rows where messages is not null) where i.r = 'user' and i.c is not null)"
_QS = f"qq as (select item_id, {_TOK.format('text')} as t from eval_items where text is not null)"


def user_docs(spark, sf):
    return decontam.user_documents(train(spark, sf), "row_id")


@q(f"with {_DOCS}, {_QS} select distinct d.row_id as original_id, qq.item_id from d join qq on len(qq.t) > 0 and contains(' ' || array_to_string(d.t, ' ') || ' ', ' ' || array_to_string(qq.t, ' ') || ' ')")
def decon_exact(spark, sf):
    return decontam.exact_matches(user_docs(spark, sf), "original_id", "text", read(spark, sf, "eval_items"), "item_id", "text")


def _gram(n: int, of: str) -> str:
    return f"array_to_string(list_slice({of}, i, i + {n - 1}), ' ')"


_SCORES = f"""dg as (select distinct row_id, unnest(list_transform(range(1, greatest(1, len(t) - 6)), lambda i: {_gram(8, 't')})) as g from d),
qg as (select item_id, len(t) as n, unnest(list_transform(range(1, greatest(1, len(t) - 6)), lambda i: {{'i': i, 'g': {_gram(8, 't')}}})) as u from qq),
h as (select distinct dg.row_id, qg.item_id, qg.n, qg.u.i as i from dg join qg on dg.g = qg.u.g),
c as (select row_id, item_id, n, unnest(range(i, i + 8)) as k from h),
s as (select row_id as original_id, item_id, round(count(distinct k) / n, 6)::double as score from c group by row_id, item_id, n)"""


def _ngram_scores(spark, sf):
    docs = user_docs(spark, sf)
    return decontam.ngram_scores(docs, "original_id", "text", read(spark, sf, "eval_items"), "item_id", "text", 8)


@q(f"with {_DOCS}, {_QS}, {_SCORES} select * from s")
def decon_ngram(spark, sf):
    return _ngram_scores(spark, sf).withColumn("score", F.round("score", 6))


@q(f"with {_DOCS}, {_QS}, {_SCORES} select row_id from train_rows where row_id not in (select original_id from s where score > 0.5)")
def decon_antijoin(spark, sf):
    bad = decontam.contaminated(_ngram_scores(spark, sf), "original_id", 0.5).withColumnRenamed("original_id", "row_id")
    return decontam.decontaminate(train(spark, sf), bad, "row_id").select("row_id")


@q(f"with {_DOCS}, {_QS}, {_SCORES}, b as (select e.eval_set, s.item_id, max(s.score) as score from s join eval_items e using (item_id) group by 1, 2) select eval_set, round(avg(score), 4) as mean_score from b group by 1")
def decon_matrix(spark, sf):
    best = _ngram_scores(spark, sf).groupBy("item_id").agg(F.max(F.round("score", 6)).alias("score"))
    scored = best.join(read(spark, sf, "eval_items").select("item_id", "eval_set"), "item_id").withColumn("index", F.lit("train_rows"))
    names = sorted(r[0] for r in read(spark, sf, "eval_items").select("eval_set").distinct().collect() if r[0])
    return decontam.score_matrix(scored, "index", "eval_set", names).select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))).alias("eval_set", "mean_score")).where("mean_score is not null")


@q(
    "with q as (select * from embeddings where vec_id % 50 = 0), s as (select q.vec_id as vec_id, e.vec_id as near, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as c from q, embeddings e), r as (select *, row_number() over (partition by vec_id order by c desc, near) as rank from s) select vec_id, near as vec_id_near, round(c, 6) as cosine, rank::int as rank from r where rank <= 5"
)
def decon_vector_top5(spark, sf):
    e = read(spark, sf, "embeddings")
    near = decontam.nearest(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return near.select("vec_id", "vec_id_near", F.round("cosine", 6).alias("cosine"), "rank")
