"""Further queries, each over its whole tables and with the same result in SQL: formats, filters, tokens,
verifiers, rewards, batches and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixloom.functions import rl
from mixloom.functions import text as T
from mixloom.functions import verifiers as V
from mixloom.operators import batches, constraints, decontam, filters, joins, messages, mixing, packing, preference, reformat, stats, tokenize
from mixloom.plans.queries_text import STIMULI, _lit, norm_sql, read, strip_sql, train
from mixloom.streaming import rollouts

QUERIES: dict = {}
SQL: dict[str, str] = {}
MD5 = lambda k: f"md5({k}::varchar || '42')"


def q(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def items(spark, sf):
    return read(spark, sf, "eval_items")


def outputs(spark, sf):
    """Every output of every row, with its place."""
    return read(spark, sf, "completions").select("gen_id", "ingested_at", "text", F.posexplode("outputs").alias("n", "o")).select("gen_id", "ingested_at", "text", "n", F.col("o.text").alias("x"), F.col("o.finish_reason").alias("reason"))


OUT = "(select gen_id, ingested_at, text, i - 1 as n, outputs[i].text as x, outputs[i].finish_reason as reason from (select *, unnest(range(1, len(outputs) + 1)) as i from completions)) o"

# -- whole conversations ------------------------------------------------------------------------

_EXTRA = f"(case row_id % {len(STIMULI)} " + " ".join(f"when {i} then {_lit(s)}" for i, s in enumerate(STIMULI)) + " end)"
CHAT = f"(select row_id, list_transform(messages, lambda m: {{'role': m.role, 'content': m.content || {_EXTRA}}}) as messages from train_rows) c"


def chat(spark, sf):
    """All messages of all rows; what the data lack is appended to every content, by the row's id."""
    extra = F.lit("")
    for i, s in enumerate(STIMULI):
        extra = F.when(F.pmod("row_id", F.lit(len(STIMULI))) == i, F.lit(s)).otherwise(extra)
    return train(spark, sf).select("row_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], extra).alias("content"))).alias("messages"))


def _some(predicate: str) -> str:
    return f"coalesce(len(list_filter(messages, lambda m: coalesce({predicate}, false))) > 0, false)"


_PROVIDER = "|".join(filters.IDENTITY).replace("'", "''")
_KEYS = filters.KEYWORDS.replace("'", "''")


@q(f"select row_id, {_some('m.role = ' + chr(39) + 'assistant' + chr(39) + ' and (m.content is null or regexp_matches(m.content, ' + chr(39) + '(?i)(?:' + _PROVIDER + ')' + chr(39) + '))')} as provider, {_some('m.role = ' + chr(39) + 'assistant' + chr(39) + ' and regexp_matches(lower(m.content), ' + chr(39) + chr(92) + 'b(' + _KEYS + ')' + chr(92) + 'b' + chr(39) + ')')} as named, coalesce(len(flatten(list_transform(messages, lambda m: coalesce(regexp_extract_all(m.content, '{filters.CUTOFF}', 1), [])))), 0) as cutoffs from {CHAT}")
def chat_filters(spark, sf):
    m = F.col("messages")
    return chat(spark, sf).select("row_id", filters.tells_provider(m).alias("provider"), filters.names_assistant(m).alias("named"), F.coalesce(F.size(filters.cutoff_mentions(m)), F.lit(0)).cast("bigint").alias("cutoffs"))


_RATIO = "(length(m.content) - length(regexp_replace(m.content, '[一-鿿]', '', 'g'))) / length(m.content)"


@q(f"select row_id, coalesce(len(list_filter(messages[-2:], lambda m: length(m.content) > 0 and {_RATIO} > 0 and {_RATIO} >= 0.05)) > 0, false) as last_two from {CHAT}")
def chat_chinese(spark, sf):
    return chat(spark, sf).select("row_id", filters.chinese(F.col("messages"), 0.05, True).alias("last_two"))


@q(f"select row_id, case when m.role = 'assistant' then replace(replace(m.content, '<answer>', ''), '</answer>', '') else m.content end as x from (select row_id, messages[-1] as m from {CHAT} where len(messages) > 0)")
def chat_without_answer_tags(spark, sf):
    return chat(spark, sf).where("size(messages) > 0").select("row_id", F.element_at(filters.remove_answer_tags(F.col("messages")), -1)["content"].alias("x"))


@q("select row_id, coalesce(messages is not null and len(list_filter(messages, lambda m: m is null or m.role is null or m.content is null)) = 0, false) as ok from train_rows")
def chat_is_chat(spark, sf):
    return train(spark, sf).select("row_id", messages.is_chat(F.col("messages")).alias("ok"))


@q(f"select row_id, {strip_sql('list_extract(string_split(replace(x, ' + chr(39) + '<|assistant|>' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '</think>' + chr(39) + '), -1)')} as x from (select row_id, messages[-1].content as x from {CHAT} where len(messages) > 0 and row_id % {len(STIMULI)} not in (1)) where x is not null union all select row_id, {strip_sql('replace(replace(list_extract(string_split(replace(x, ' + chr(39) + '<|assistant|>' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '</think>' + chr(39) + '), -1), ' + chr(39) + '<answer>' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '</answer>' + chr(39) + ', ' + chr(39) * 2 + ')')} from (select row_id, messages[-1].content as x from {CHAT} where len(messages) > 0 and row_id % {len(STIMULI)} = 1) where x is not null")
def chat_answers(spark, sf):
    c = chat(spark, sf).where("size(messages) > 0").select("row_id", F.element_at("messages", -1)["content"].alias("x"))
    return c.where("x is not null").select("row_id", T.remove_thinking(F.col("x")).alias("x"))


@q(f"select row_id, case when regexp_matches(x, '(?s)<answer>.*?</answer>') then {strip_sql('regexp_extract(x, ' + chr(39) + '(?s)<answer>(.*?)</answer>' + chr(39) + ', 1)')} when contains(x, '</think>') then {strip_sql('list_extract(string_split(x, ' + chr(39) + '</think>' + chr(39) + '), -1)')} else {strip_sql('replace(x, ' + chr(39) + '<answer>' + chr(39) + ', ' + chr(39) * 2 + ')')} end as answer from (select row_id, messages[-1].content as x from {CHAT} where len(messages) > 0) where x is not null")
def final_answers(spark, sf):
    c = chat(spark, sf).where("size(messages) > 0").select("row_id", F.element_at("messages", -1)["content"].alias("x")).where("x is not null")
    return c.select("row_id", T.final_answer(F.col("x")).alias("answer"))


@q("select row_id, len(messages) as n, len(list_filter(messages, lambda m: m.role = 'system')) as systems, messages[1].role as first from (select row_id, case when trim(coalesce(lang, '')) <> '' then list_concat([{'role': 'system', 'content': lang}], messages) else messages end as messages from train_rows where messages is not null)")
def optional_system(spark, sf):
    t = train(spark, sf).where("messages is not null").select("row_id", messages.optional_system(F.col("lang"), F.col("messages")).alias("messages"))
    return t.select("row_id", F.size("messages").cast("bigint").alias("n"), F.size(F.filter("messages", lambda m: m["role"] == "system")).cast("bigint").alias("systems"), F.try_element_at("messages", F.lit(1))["role"].alias("first"))


@q("select row_id, list_transform(messages, lambda m: replace(replace(coalesce(m.content, ''), 'the', 'THE'), 'a', '@')) as xs from train_rows where messages is not null")
def substituted(spark, sf):
    m = messages.substitute(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))), {"the": "THE", "a": "@"})
    return train(spark, sf).where("messages is not null").select("row_id", F.transform(m, lambda x: x["content"]).alias("xs"))


# -- formats ------------------------------------------------------------------------------------


@q("select item_id, text as user, answer as assistant, 2::bigint as n from eval_items")
def from_prompt_answer(spark, sf):
    m = items(spark, sf).select("item_id", messages.from_fields(user=F.col("text"), assistant=F.col("answer")).alias("m"))
    return m.select("item_id", F.col("m")[0]["content"].alias("user"), F.col("m")[1]["content"].alias("assistant"), F.size("m").cast("bigint").alias("n"))


@q("select item_id, 'system' as role, coalesce(eval_set, '') as system, text as user, answer as assistant from eval_items")
def from_three_fields(spark, sf):
    m = items(spark, sf).select("item_id", messages.from_fields(system=F.coalesce("eval_set", F.lit("")), user=F.col("text"), assistant=F.col("answer")).alias("m"))
    return m.select("item_id", F.col("m")[0]["role"].alias("role"), *[F.col("m")[i]["content"].alias(n) for i, n in enumerate(("system", "user", "assistant"))])


@q("select row_id, i - 1 as place, case messages[i].role when 'user' then 'user' when 'assistant' then 'assistant' else 'system' end as role, messages[i].content as content from (select *, unnest(range(1, len(messages) + 1)) as i from train_rows where len(list_filter(messages, lambda m: m.role is null)) = 0)")
def from_value_turns(spark, sf):
    t = train(spark, sf).where("messages is not null and not exists(messages, m -> m.role is null)")
    named = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise("system").alias("from"), m["content"].alias("value")))
    out = t.select("row_id", messages.from_conversations(named).alias("m")).select("row_id", F.posexplode("m").alias("place", "m"))
    return out.select("row_id", F.col("place").cast("bigint").alias("place"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@q("select item_id, text as question, answer from eval_items where trim(coalesce(text, '')) <> '' and trim(coalesce(answer, '')) <> ''")
def reformat_questions(spark, sf):
    m = reformat.reformat(items(spark, sf).select("item_id", F.col("text").alias("question"), "answer"), "item_id", "question")
    return m.select("item_id", F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


@q(f"select item_id, replace(list_extract(['Solve: {{question}}', 'Please answer. {{question}}', '{{question}} Explain.'], (('0x' || {MD5('item_id')}[1:8])::ubigint % 3 + 1)::bigint), '{{question}}', text) as question from eval_items where trim(coalesce(text, '')) <> '' and trim(coalesce(answer, '')) <> ''")
def reformat_templates(spark, sf):
    m = reformat.reformat(items(spark, sf).select("item_id", F.col("text").alias("question"), "answer"), "item_id", "question", ["Solve: {question}", "Please answer. {question}", "{question} Explain."])
    return m.select("item_id", F.col("messages")[0]["content"].alias("question"))


@q("select gen_id, len(outputs) as n, list_transform(outputs, lambda o: o.text) as xs from completions where len(outputs) > 1")
def reformat_turns(spark, sf):
    c = read(spark, sf, "completions").select("gen_id", F.transform("outputs", lambda o: o["text"]).alias("turns"))
    m = reformat.reformat(c, "gen_id", "turns")
    return m.select("gen_id", F.size("messages").cast("bigint").alias("n"), F.transform("messages", lambda x: x["content"]).alias("xs"))


@q("select gen_id, model from completions where regexp_matches(model, '[ab]')")
def model_regex(spark, sf):
    return reformat.model_matches(read(spark, sf, "completions"), "model", "[ab]").select("gen_id", "model")


@q("select gen_id, coalesce(outputs[1].text, '') || '|' || coalesce(outputs[2].text, '') as xs, 2::bigint as n from completions where len(outputs) > 1")
def pair_trajectories(spark, sf):
    c = read(spark, sf, "completions").where("size(outputs) > 1")
    base = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    w = c.select("gen_id", reformat.with_answers(base, F.col("outputs")[0]["text"], F.col("outputs")[1]["text"]).alias("w"))
    last = lambda s: F.coalesce(F.element_at(F.col(f"w.{s}"), -1)["content"], F.lit(""))
    return w.select("gen_id", F.concat(last("chosen"), F.lit("|"), last("rejected")).alias("xs"), F.size("w.chosen").cast("bigint").alias("n"))


@q("select count(*) as n, count(*) filter (text is null or answer is null) as lacking, count(*) filter (text is not null and answer is not null and coalesce(lang <> 'en', true)) as not_good from eval_items")
def skipped_rows(spark, sf):
    return reformat.skipped(items(spark, sf).withColumn("good", F.col("lang") == "en"), ["text", "answer"], "good")


@q("select item_id, text as question, answer from eval_items where text is not null and answer is not null and lang = 'en'")
def verifiable_to_sft(spark, sf):
    m = reformat.to_sft(items(spark, sf).withColumn("good", F.col("lang") == "en"), "item_id", ["text", "answer"], "text", "answer", "good")
    return m.select("item_id", F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


@q(f"select row_id, case when contains(x, '<answer>') and not contains(x, '</answer>') then x || '</answer>' else x end as x, {strip_sql('list_extract(string_split(x, ' + chr(39) + '</think>' + chr(39) + '), -1)')} as ground_truth from (select row_id, replace(messages[-1].content, '<code>', '<think>') as x from {CHAT} where len(messages) > 0)")
def thinker_rows(spark, sf):
    c = chat(spark, sf).where("size(messages) > 0").select("row_id", F.element_at("messages", -1)["content"].alias("x"))
    return reformat.thinker(c, "row_id", "x", {"<code>": "<think>"})


@q(f"select item_id, case when text is null or answer is null then null else '<think>' || text || '</think><answer>' || answer || '</answer>' end as x, {strip_sql('string_split(coalesce(text, ' + chr(39) * 2 + ') || ' + chr(39) + '#### 7 ' + chr(39) + ', ' + chr(39) + '####' + chr(39) + ')[-1]')} as gold from eval_items")
def reasoning_texts(spark, sf):
    return items(spark, sf).select("item_id", messages.reasoning(F.col("text"), F.col("answer")).alias("x"), messages.gsm_answer(F.concat(F.coalesce("text", F.lit("")), F.lit("#### 7 "))).alias("gold"))


@q("select user_id, event_id, chr((64 + list_position(list_sort(list_transform([event_type, 'Zeta', 'alpha', 'Mid'], lambda x: lower(x) || '|' || x)), lower(event_type) || '|' || event_type))::int) as letter from events where event_type is not null")
def multiple_choice(spark, sf):
    m = messages.multiple_choice(F.col("event_type"), F.array(F.lit("Zeta"), F.lit("alpha"), F.lit("Mid")))
    return read(spark, sf, "events").where("event_type is not null").select("user_id", "event_id", m["letter"].alias("letter"))


@q("select gen_id, n, 'Q: ' || coalesce(text, '') || ' A: ' || coalesce(x, '') as prompt from " + OUT)
def rendered_prompts(spark, sf):
    o = outputs(spark, sf)
    return o.select("gen_id", F.col("n").cast("bigint").alias("n"), messages.render("Q: {{ q }} A: {{a}}", {"q": F.coalesce("text", F.lit("")), "a": F.coalesce("x", F.lit(""))}).alias("prompt"))


@q(f"select gen_id, n, coalesce({strip_sql('coalesce(text, ' + chr(39) * 2 + ')')} <> '' and {strip_sql('coalesce(x, ' + chr(39) * 2 + ')')} <> '', false) as good from {OUT}")
def good_pairs(spark, sf):
    side = lambda c: F.array(F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content")))
    return outputs(spark, sf).select("gen_id", F.col("n").cast("bigint").alias("n"), messages.good_pair(side("text"), side("x")).alias("good"))


@q("select doc_id, source from documents where coalesce(lower(kind) not in ('note', 'report'), true)")
def tag_filtered(spark, sf):
    d = read(spark, sf, "documents").withColumn("tags", F.array("kind"))
    return messages.tag_filter(d, "tags", ["Note", "Report"]).select("doc_id", "source")


# -- sources, mixing ----------------------------------------------------------------------------


@q("select 'a' as name, 0.5::double as amount, false as counted union all select 'b', 25.0, true union all select 'c', 1.0, false")
def mixer_list(spark, sf):
    m = mixing.parse_mixer(["a", "0.5", "b", "25", "c", "1.0"])
    return spark.createDataFrame([(k, float(v), isinstance(v, int)) for k, v in m.items()], "name string, amount double, counted boolean")


@q(f"with a as (select doc_id, text, row_number() over (order by {MD5('doc_id')}, doc_id) - 1 as i, count(*) over () as n from documents), b as (select item_id, text, row_number() over (order by {MD5('item_id')}, item_id) - 1 as i, count(*) over () as n from eval_items) select 'docs_' || i as id, 'docs' as source, text from a where i < n // 4 union all select 'items_' || i, 'items', text from b where i < n // 2")
def legacy_mixture(spark, sf):
    d = mixing.legacy_mix({"docs": (read(spark, sf, "documents"), "doc_id", 0.25), "items": (items(spark, sf), "item_id", 0.5)}, ["text"])
    return d.select("id", "source", "text")


@q("select doc_id, lang from documents")
def projected(spark, sf):
    d = mixing.drop_present(read(spark, sf, "documents"), ["text", "no_such_column"])
    return mixing.project(d, ["doc_id", "lang"])


@q("select doc_id from documents where doc_id not in (select doc_id from documents where lang = 'en')")
def incremental_documents(spark, sf):
    d = read(spark, sf, "documents")
    return decontam.new_documents(d.where("lang = 'en'"), d, "doc_id").select("doc_id")


@q("with r as (select gen_id, model, row_number() over (partition by gen_id order by ingested_at desc) as rn from (select gen_id, max(model) as model, ingested_at from completions group by 1, 3)) select gen_id, model from r where rn = 1")
def latest_results(spark, sf):
    c = read(spark, sf, "completions").groupBy("gen_id", "ingested_at").agg(F.max("model").alias("model"))
    return joins.latest_result(c, "gen_id", "model", "ingested_at").select("gen_id", "model")


@q("select t.row_id, a.answer as content from (select distinct on (row_id) row_id, messages from train_rows where len(messages) > 1 order by row_id, ingested_at) t join eval_items a on t.row_id % 1000 = a.item_id")
def replaced_answers(spark, sf):
    t = mixing.first_per_key(train(spark, sf).where("size(messages) > 1"), ["row_id"], [F.asc("ingested_at")]).select(F.pmod("row_id", F.lit(1000)).alias("k"), "row_id", "messages")
    r = items(spark, sf).select(F.col("item_id").alias("k"), F.col("answer").alias("new"))
    return joins.replace_answer(t, r, "k", "messages", "new").select("row_id", F.col("messages")[1]["content"].alias("content"))


@q("select item_id, json_object('custom_id', item_id::varchar, 'method', 'POST', 'n', length(text))::varchar as key from eval_items where text is not null")
def request_bodies(spark, sf):
    i = items(spark, sf).where("text is not null")
    made = joins.request_rows(i, "item_id", "text", "m").select(F.from_json("value", "custom_id string, method string, body struct<messages:array<struct<content:string>>>").alias("r"))
    return made.select(F.col("r.custom_id").cast("bigint").alias("item_id"), F.to_json(F.struct(F.col("r.custom_id"), F.col("r.method"), F.length(F.col("r.body.messages")[0]["content"]).alias("n"))).alias("key"))


@q("select item_id, 'Question: a\nAnswer: b\n\nQuestion: ' || text || '\nAnswer:' as prompt from eval_items where text is not null")
def few_shot_prompts(spark, sf):
    return items(spark, sf).where("text is not null").select("item_id", joins.few_shot(F.col("text"), [("a", "b")]).alias("prompt"))


@q("select i as id, i % 10 + 1 as target, 'Reach the number ' || (i % 10 + 1) || '.' as prompt from range(0, 500) r(i)")
def environment_rows(spark, sf):
    return joins.environment_samples(spark, 500)


@q("select event_id, try_cast(v as bigint) as i, try_cast(v as double) as d, case when v in ('true', '1', 'yes') then true when v in ('false', '0', 'no') then false end as b from (select event_id, case event_id % 3 when 0 then 'true' when 1 then '1' else 'no' end as v from events)")
def coerced_arguments(spark, sf):
    k = F.pmod("event_id", F.lit(3))
    v = read(spark, sf, "events").select("event_id", F.when(k == 0, "true").when(k == 1, "1").otherwise("no").alias("v"))
    return v.select("event_id", joins.coerce(F.col("v"), "integer").alias("i"), joins.coerce(F.col("v"), "number").alias("d"), joins.coerce(F.col("v"), "boolean").alias("b"))


@q("select item_id, case when length(text) > 60 then text[1:60] || '... [' || (length(text) - 60) || ' more chars]' else text end as x from eval_items")
def truncated_outputs(spark, sf):
    return items(spark, sf).select("item_id", T.truncate_output(F.col("text"), 60).alias("x"))


@q(f"select gen_id, n, coalesce(list_max(list_transform(range(0, least(length(text), length(x)) + 1), lambda k: case when text[1:k] = x[1:k] then k else 0 end)), 0)::int as shared from {OUT} where text is not null and x is not null")
def shared_prefixes(spark, sf):
    return outputs(spark, sf).where("text is not null and x is not null").select("gen_id", F.col("n").cast("bigint").alias("n"), T.shared_prefix_length(F.col("text"), F.col("x")).cast("int").alias("shared"))


@q(f"select gen_id, n from {OUT} where lower(reason) = 'stop'")
def finished_outputs(spark, sf):
    return rollouts.keep_finished(outputs(spark, sf), "reason").select("gen_id", F.col("n").cast("bigint").alias("n"))


@q(f"select gen_id, n, x from {OUT} where gen_id in (select gen_id from {OUT} group by 1 having min(x) <> max(x))")
def differing_outputs(spark, sf):
    return filters.drop_identical(outputs(spark, sf), "gen_id", "x").select("gen_id", F.col("n").cast("bigint").alias("n"), "x")


# -- verifiers ----------------------------------------------------------------------------------


def _label(k: str = "n") -> str:
    return f"case {k} % 2 when 0 then coalesce(text, '') else 'other' end"


@q(f"select gen_id, n, coalesce(({norm_sql(strip_sql('string_split(x, ' + chr(39) + 'The answer is: ' + chr(39) + ')[-1]'))} = {norm_sql(_label())})::int, 0)::double as score from (select gen_id, n, text, coalesce(text, '') || ' The answer is: ' || {_label('gen_id')} as x from {OUT})")
def verify_flan(spark, sf):
    o = outputs(spark, sf)
    label = lambda k: F.when(F.pmod(k, F.lit(2)) == 0, F.coalesce("text", F.lit(""))).otherwise("other")
    x = F.concat(F.coalesce("text", F.lit("")), F.lit(" The answer is: "), label("gen_id"))
    return o.select("gen_id", F.col("n").cast("bigint").alias("n"), V.flan(x, label("n")).alias("score"))


@q(f"select gen_id, n, case when gen_id % 3 = 2 then 0.0 when gen_id % 3 = 0 then 1.0 else 0.1 end::double as f1, case when gen_id % 3 = 0 then 1.0 else 0.0 end::double as same from {OUT}")
def verify_search(spark, sf):
    k = F.pmod("gen_id", F.lit(3))
    x = F.when(k == 0, "so <finish>The Paris</finish>").when(k == 1, "so <finish>London</finish>").otherwise("Paris")
    label = F.lit('["paris", "lutetia"]')
    return outputs(spark, sf).select("gen_id", F.col("n").cast("bigint").alias("n"), V.re_search_f1(x, label).alias("f1"), V.re_search(x, label).alias("same"))


@q("select l_orderkey, case when avg((l_discount > 0.02)::int) >= 0.5 then round(avg((l_discount > 0.02)::int), 6) else 0 end::double as score from lineitem group by 1")
def verify_code(spark, sf):
    r = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") > 0.02).alias("results"))
    return r.select("l_orderkey", F.round(V.code(F.col("results"), 0.5), 6).alias("score"))


@q("select l_orderkey, round(case when sum(abs(l_linenumber - 3)) = 0 then 0 else sum(floor(l_quantity / 25) / 2.0 * (l_linenumber - 3)) / sum(abs(l_linenumber - 3)) end, 6)::double as score from lineitem group by 1")
def verify_rubric(spark, sf):
    r = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.floor(F.col("l_quantity") / 25).cast("double").alias("s"), (F.col("l_linenumber") - 3).cast("double").alias("w"))).alias("r"))
    return r.select("l_orderkey", F.round(V.rubric(F.transform("r", lambda x: x["s"]), F.transform("r", lambda x: x["w"])), 6).alias("score"))


@q("select event_id, case event_id % 6 when 0 then 0.8 when 1 then 0.5 when 2 then 7.0 when 3 then 1.0 else 0.0 end::double as score from events")
def judge_scores(spark, sf):
    k = F.pmod("event_id", F.lit(6))
    x = F.when(k == 0, "I give 8/10").when(k == 1, "about 50%").when(k == 2, "score: 7").when(k == 3, "Yes, it is correct").when(k == 4, "not correct").otherwise("no idea")
    return read(spark, sf, "events").select("event_id", T.judge_score(x).alias("score"))


@q(f"select row_id, case when regexp_matches(x, '(?s)```') then 'x = 1' else x end as code, case when row_id % 2 = 0 then '7' else '[invalidanswer]' end as minerva from (select row_id, coalesce(messages[1].content, '') as c, case when row_id % 2 = 0 then 'Final Answer: The final answer is 7. I hope it is correct.' || '```python' || 'x = 1' || '```' else replace(coalesce(messages[1].content, ''), '`', '') end as x from train_rows)")
def code_and_finals(spark, sf):
    even = F.pmod("row_id", F.lit(2)) == 0
    x = F.when(even, "Final Answer: The final answer is 7. I hope it is correct.```pythonx = 1```").otherwise(F.replace(F.coalesce(F.try_element_at("messages", F.lit(1))["content"], F.lit("")), F.lit("`"), F.lit("")))
    return train(spark, sf).select("row_id", T.python_code(x).alias("code"), F.when(even, T.minerva_answer(x)).otherwise("[invalidanswer]").alias("minerva"))


_PAIR_TRUTHS = "case gen_id % 3 when 0 then 2.0 when 1 then 0.5 else 0.0 end::double"


@q(f"select gen_id, {_PAIR_TRUTHS} as reward from (select distinct gen_id from completions)")
def rewards_by_verifier(spark, sf):
    k = F.pmod("gen_id", F.lit(3))
    c = read(spark, sf, "completions").select("gen_id").distinct()
    c = c.select("gen_id", F.when(k == 0, "so it is \\boxed{12}").otherwise("The answer is: x").alias("x"), F.when(k == 2, F.array(F.lit("zz"))).otherwise(F.array(F.when(k == 0, "12").otherwise("x"), F.lit("12"))).alias("truths"), F.when(k == 0, F.array(F.lit("OLD"), F.lit("math"))).when(k == 1, F.array(F.lit("Flan"), F.lit("unknown"))).otherwise(F.array(F.lit("flan"))).alias("names"))
    return V.apply_verifiers(c, "x", "truths", "names", {"old": "gsm8k"}, {"flan": 0.5}, 1.0, "gen_id").withColumn("reward", F.col("reward"))


@q(f"select gen_id, n, case when reason is null then -1.0 when gen_id % 2 = 0 then 0.75 + 1.0 else 0.0 end::double as reward from {OUT}")
def combined_rewards(spark, sf):
    fmt = F.when(F.pmod("gen_id", F.lit(2)) == 0, 1.0).otherwise(0.0)
    r = rl.combined_reward(F.lit(0.75), fmt, F.array(F.lit(5.0), F.lit(1.0)), "last", True, F.col("reason").isNotNull(), -1.0)
    return outputs(spark, sf).select("gen_id", F.col("n").cast("bigint").alias("n"), r.alias("reward"))


@q("select gen_id, case gen_id % 4 when 0 then (not contains(x, ','))::int when 1 then (len(regexp_extract_all(lower(x), '[^\\p{L}\\p{N}_]the[^\\p{L}\\p{N}_]')) >= 0)::int when 2 then (x <> '' and x = upper(x) and lower(x) <> upper(x))::int else 0 end::double as score from (select distinct gen_id, 'one, two and three' as x from completions)")
def verify_functions(spark, sf):
    k = F.pmod("gen_id", F.lit(4))
    label = F.when(k == 0, '{"func_name": "validate_no_commas"}').when(k == 1, '{"func_name": "validate_end", "end_phrase": "three"}').when(k == 2, '{"func_name": "validate_uppercase"}').otherwise('{"N": 3}')
    c = read(spark, sf, "completions").select("gen_id").distinct().select("gen_id", F.lit("one, two and three").alias("x"), label.alias("label"))
    return constraints.ifeval_old(c, "gen_id", "x", "label")


@q("select gen_id, case gen_id % 3 when 0 then 0.5 when 1 then 1.0 else 0.0 end::double as score from (select distinct gen_id from completions)")
def verify_constraints(spark, sf):
    k = F.pmod("gen_id", F.lit(3))
    two = "[{'instruction_id': ['punctuation:no_comma', 'keywords:existence'], 'kwargs': [None, {'keywords': ['two', 'three'], 'relation': None}]}]"
    one = "[{'instruction_id': ['length_constraints:number_words'], 'kwargs': [{'num_words': 3, 'relation': 'at least'}]}]"
    label = F.when(k == 0, two).when(k == 1, one).otherwise("no literal")
    c = read(spark, sf, "completions").select("gen_id").distinct().select("gen_id", F.lit("<think>hm</think> one, two and three").alias("x"), label.alias("label"))
    return constraints.ifeval(c, "gen_id", "x", "label")


# -- rewards and batches ------------------------------------------------------------------------


def orders_of(spark, sf):
    l = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("r"), F.min("l_tax").alias("v"))
    return l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "r", "v"))).alias("s"))


_LINES = "l as (select l_orderkey, l_linenumber, min(l_discount) as r, min(l_tax) as v, row_number() over (partition by l_orderkey order by l_linenumber) as i from lineitem group by 1, 2)"


@q(f"with {_LINES} select l_orderkey, list(round(r - v, 6) order by l_linenumber) as g from l group by 1")
def gae_dones(spark, sf):
    """Every place ends an episode, so an advantage is its reward less its value."""
    s = orders_of(spark, sf)
    ones = F.transform("s", lambda x: F.lit(1))
    g = rl.gae(F.transform("s", lambda x: x["v"]), F.transform("s", lambda x: x["r"]), 0.9, 0.95, ones, ones)
    return s.select("l_orderkey", F.transform(g, lambda x: F.round(x, 6)).alias("g"))


@q(f"with {_LINES} select l_orderkey, round(sum(r) filter (i < n and l_linenumber % 2 = 0), 6) as total from (select *, lead(l_linenumber) over (partition by l_orderkey order by i) % 2 = 0 as keep, count(*) over (partition by l_orderkey) as n from l) group by 1".replace("filter (i < n and l_linenumber % 2 = 0)", "filter (i < n and keep)"))
def sequence_logps(spark, sf):
    s = orders_of(spark, sf)
    labels = F.transform("s", lambda x: F.when(x["l_linenumber"] % 2 == 0, x["l_linenumber"].cast("int")).otherwise(-100))
    total = rl.sequence_logps(F.transform("s", lambda x: x["r"]), labels)
    return s.select("l_orderkey", F.when(F.exists(F.slice(labels, F.lit(2), F.greatest(F.lit(0), F.size(labels) - 1)), lambda y: y != -100), F.round(total, 6)).alias("total"))


@q(f"with {_LINES} select l_orderkey, coalesce(min(i) filter (r > 0.05) - 1, count(*))::int as first from l group by 1")
def first_true_places(spark, sf):
    s = orders_of(spark, sf)
    return s.select("l_orderkey", rl.first_true(F.transform("s", lambda x: x["r"] > 0.05)).cast("int").alias("first"))


@q("select l_orderkey, l_linenumber, round(greatest(-a * r, -a * greatest(0.8, least(1.2, r))), 6) as clipped, round(-a * least(1.2, r), 6) as capped from (select l_orderkey, l_linenumber, l_discount - 0.05 as a, 0.7 + l_tax * 8 as r from lineitem)")
def clipped_losses(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") - 0.05).alias("a"), (F.lit(0.7) + F.col("l_tax") * 8).alias("r"))
    return l.select("l_orderkey", "l_linenumber", F.round(rl.clipped_loss(F.col("r"), F.col("a")), 6).alias("clipped"), F.round(rl.clipped_loss(F.col("r"), F.col("a"), kind="cispo"), 6).alias("capped"))


@q("select l_orderkey, l_linenumber, round((l_quantity * case l_returnflag when 'A' then 1.5 else 3.0 end + l_linenumber * case l_returnflag when 'A' then 2.0 else 6.0 end) / 1e6, 9) as cost from lineitem where l_returnflag in ('A', 'R')")
def token_costs(spark, sf):
    l = read(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')")
    return l.select("l_orderkey", "l_linenumber", F.round(rl.token_cost(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_returnflag"), {"A": (1.5, 2.0), "R": (3.0, 6.0)}), 9).alias("cost"))


@q(f"with {_LINES} select l_orderkey, list_concat([0::bigint], list(e order by i)) as cu_seq_lens, flatten(list(range(0, l_linenumber::bigint) order by i)) as position_ids, sum(l_linenumber)::bigint as n from (select *, sum(l_linenumber) over (partition by l_orderkey order by i)::bigint as e from l) group by 1")
def packed_positions(spark, sf):
    n = F.transform("s", lambda x: x["l_linenumber"].cast("bigint"))
    s = orders_of(spark, sf)
    return s.select("l_orderkey", packing.boundaries(n).alias("cu_seq_lens"), packing.position_ids(n).alias("position_ids"), F.size(packing.sequence_ids(n)).cast("bigint").alias("n"))


@q(f"with {_LINES} select l_orderkey, list_concat(list(l_linenumber::bigint order by i), list((10 + l_linenumber)::bigint order by i)) as ids, (2 * count(*))::bigint as sequences, list_concat(range(0, count(*)), range(count(*), 2 * count(*))) as seq_idx from l group by 1")
def flattened_pairs(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    one = lambda x: F.array(x.cast("bigint"))
    n = F.col("l_linenumber")
    d = l.select("l_orderkey", "l_linenumber", one(n).alias("chosen_input_ids"), one(n).alias("chosen_labels"), one(n + 10).alias("rejected_input_ids"), one(n + 10).alias("rejected_labels"))
    f = batches.flatten_pairs(d, "l_orderkey", "l_linenumber")
    return f.select("l_orderkey", F.col("input_ids").alias("ids"), (F.size("cu_seq_lens") - 1).cast("bigint").alias("sequences"), F.transform("seq_idx", lambda x: x.cast("bigint")).alias("seq_idx"))


@q(f"with {_LINES} select l_orderkey, list(l_linenumber::bigint order by i) as lengths, sum(l_linenumber)::bigint as tokens, count(*) as sequences from l group by 1")
def unpacked_lengths(spark, sf):
    s = orders_of(spark, sf).select("l_orderkey", F.transform("s", lambda x: x["l_linenumber"].cast("bigint")).alias("n"))
    s = s.withColumn("cu", packing.boundaries(F.col("n"))).withColumn("ids", packing.position_ids(F.col("n")))
    counts = batches.sequence_counts(F.col("cu"), F.col("ids"), -1)
    return s.select("l_orderkey", F.transform(batches.unpack(F.col("ids"), F.col("cu")), lambda a: F.size(a).cast("bigint")).alias("lengths"), counts["tokens"].cast("bigint").alias("tokens"), counts["sequences"].cast("bigint").alias("sequences"))


@q("select o_orderkey, k as sample_no from orders, range(0, 3) r(k)")
def repeated_prompts(spark, sf):
    return batches.repeat_prompts(read(spark, sf, "orders").select("o_orderkey"), 3).select("o_orderkey", F.col("sample_no").cast("bigint").alias("sample_no"))


@q("select source, doc_id, row_number() over (partition by source order by n_chars, doc_id) - 1 as place, (row_number() over (partition by source order by n_chars, doc_id) - 1) // 8 as batch from documents")
def length_sorted_batches(spark, sf):
    return batches.length_batches(read(spark, sf, "documents"), "n_chars", "doc_id", 8, "source").select("source", "doc_id", F.col("place").cast("bigint").alias("place"), "batch")


@q("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def missing_references(spark, sf):
    cache = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return batches.missing_reference(cache, read(spark, sf, "orders"), "o_orderkey")


@q("select l.l_orderkey, l.l_linenumber, o.o_orderstatus from lineitem l join orders o on l.l_orderkey = o.o_orderkey")
def indexed_results(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return batches.by_index(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), rows, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderstatus")


# -- statistics ---------------------------------------------------------------------------------


@q("select 'l_quantity' as measure, round(avg(l_quantity), 6) as mean, max(l_quantity) as most, round(100 * avg((l_quantity > 25)::int), 6) as over_25_pct from lineitem union all select 'l_linenumber', round(avg(l_linenumber), 6), max(l_linenumber)::double, round(100 * avg((l_linenumber > 25)::int), 6) from lineitem")
def summary_table(spark, sf):
    s = stats.summary(read(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"], (25,))
    return s.select("measure", F.round("mean", 6).alias("mean"), "most", F.round("over_25_pct", 6).alias("over_25_pct"))


@q("select count(*) as batches, round(sum(l_quantity), 4) as tokens, round(sum(l_quantity) / sum(l_tax), 4) as tokens_per_second, round(avg(l_discount), 6) as mean_l_discount from lineitem")
def benchmark_totals(spark, sf):
    b = stats.benchmark_totals(read(spark, sf, "lineitem"), "l_quantity", "l_tax", ["l_discount"])
    return b.select("batches", F.round("tokens", 4).alias("tokens"), F.round("tokens_per_second", 4).alias("tokens_per_second"), F.round("mean_l_discount", 6).alias("mean_l_discount"))


@q("select source, count(*) as n, count(*) filter (lang = 'en') as hits from documents group by 1")
def hits_by_source(spark, sf):
    return stats.counts_by(read(spark, sf, "documents"), "source", F.col("lang") == "en")


@q("with s as (select user_id, event_type, round(stddev_pop(value), 6) as std, count(value) as n, row_number() over (partition by user_id order by stddev_pop(value) desc nulls last, event_type) as rank from events group by 1, 2) select user_id, event_type, std, n, rank::int as rank from s where rank <= 2")
def top_kinds_by_spread(spark, sf):
    return stats.top_by_spread(read(spark, sf, "events"), "user_id", "event_type", "value", 2).withColumn("std", F.round("std", 6)).select("user_id", "event_type", "std", "n", "rank")


@q("select o_custkey, list(o_orderkey order by o_totalprice desc, o_orderkey) as items from orders group by 1")
def sorted_lists(spark, sf):
    return stats.sorted_by_score(read(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@q("select eval_set, text from (select 'items' as eval_set, text from eval_items where split = 'test' union all select 'items', answer from eval_items where split = 'test' union all select 'docs', source from documents) where text is not null")
def benchmark_suite(spark, sf):
    return stats.benchmark_items({"items": items(spark, sf), "docs": read(spark, sf, "documents")}, [("items", "test", ["text", "answer"], None), ("docs", "", ["source"], None)])


@q("select source, count(*) as n, sum(n_chars)::bigint as tokens, sum(coalesce(n_chars, 0) % 7)::bigint as trainable, count(*) filter (coalesce(n_chars, 0) % 7 = 0) as without, round(100.0 * sum(n_chars) / (select sum(n_chars) from documents), 6) as share from documents group by 1")
def source_token_stats(spark, sf):
    d = read(spark, sf, "documents").withColumn("t", F.coalesce("n_chars", F.lit(0)) % 7)
    return stats.token_stats(d, "source", "n_chars", "t").withColumn("share", F.round("share", 6)).select("source", "n", "tokens", "trainable", "without", "share")


@q("select user_id, round(avg(value), 6) as correctness, count(value) as n from events group by 1")
def mean_correctness(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.collect_list("value").alias("scores"))
    return stats.mean_correctness(e, "user_id", "scores").withColumn("correctness", F.round("correctness", 6))


@q("select event_type, round(avg(value), 6) as value from events group by 1")
def merged_metrics(spark, sf):
    return stats.merged_metrics(read(spark, sf, "events"), "event_type", "value").withColumn("value", F.round("value", 6))


@q("select event_type, 'v' as metric, round(avg(value), 6) as mean from events group by 1")
def env_metrics(spark, sf):
    e = read(spark, sf, "events").withColumn("info", F.create_map(F.lit("v"), F.col("value").cast("string"), F.lit("t"), F.lit("word")))
    return stats.env_metrics(e, "event_type", "info").withColumn("mean", F.round("mean", 6))


@q("with p as (select user_id, (event_id % 4) as place, avg(case when event_type = 'error' then -1 else floor(value) end)::double as rating from events group by 1, 2) select user_id, place, round(rating, 6) as rating from p")
def rating_vectors(spark, sf):
    e = read(spark, sf, "events").withColumn("place0", F.pmod("event_id", F.lit(4)))
    v = F.when(F.col("event_type") == "error", "bad").otherwise(F.floor("value").cast("string"))
    lists = e.groupBy("user_id", "place0").agg(F.array_join(F.collect_list(v), ",").alias("r"))
    return preference.aspect_ratings(lists, "user_id", "place0", "r").groupBy("user_id").agg(F.count(F.lit(1)).alias("places")).join(
        e.withColumn("v", F.coalesce(v.try_cast("double"), F.lit(-1.0))).groupBy("user_id", F.col("place0").alias("place")).agg(F.round(F.avg("v"), 6).alias("rating")), "user_id"
    ).select("user_id", "place", "rating")


@q(f"with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by {MD5('event_id')}, event_id) as rn from events) select user_id, list(event_type order by event_id) as items from r where rn <= 4 group by 1")
def collected_groups(spark, sf):
    return preference.collect_group(read(spark, sf, "events"), "user_id", "event_type", "event_id", 4)


@q("select t.lang, t.\"from\", count(*) as n from (select lang, (n_chars // 500 * 500) as \"from\" from (select lang, coalesce(n_chars, 0) as n_chars from documents)) t group by 1, 2")
def length_bins(spark, sf):
    return stats.length_histogram(read(spark, sf, "documents"), "lang", F.col("n_chars"), 500)


@q()
def token_length_bins(spark, sf):
    d = tokenize.text_lengths(read(spark, sf, "documents").select("lang", "text"), "text")
    return stats.length_histogram(d, "lang", F.col("n_tokens"), 128)


@q()
def sft_last_turn(spark, sf):
    rows = train(spark, sf).select("row_id", "messages").where("size(messages) > 0")
    return tokenize.chat_tokens(rows, mask="last", limit=2048).select("row_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != -100)).alias("trainable"))


@q()
def preference_rows(spark, sf):
    from mixloom.plans.registry import run_transforms

    c = read(spark, sf, "completions").where("size(outputs) > 1 and outputs[0].text is not null and outputs[1].text is not null")
    chat_of = lambda i: F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("outputs")[i]["text"].alias("content")))
    pairs = c.select("gen_id", chat_of(0).alias("chosen"), chat_of(1).alias("rejected"))
    out = run_transforms(pairs, [("preference_tokenize", {}), ("preference_filter", {"max_tokens": 2048})])
    return out.select("gen_id", F.size("chosen_input_ids").alias("chosen"), F.size("rejected_input_ids").alias("rejected"))


@q()
def verifiable_rows(spark, sf):
    from mixloom.plans.registry import run_transforms

    rows = train(spark, sf).where("size(messages) > 0").select("row_id", "messages", "ground_truth", "dataset")
    out = run_transforms(rows, [("verifiable_tokenize", {}), ("verifiable_filter", {"max_prompt": 1024})])
    return out.select("row_id", F.size("prompt_ids").alias("n"), F.size("ground_truth").alias("truths"))
