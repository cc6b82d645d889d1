"""Queries over rows: mixing, sets, preferences, rewards, packing, judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from mixloom.functions import rl
from mixloom.functions.text import split_words
from mixloom.operators import filters, joins, mixing, packing, preference, stats
from mixloom.plans import registry
from mixloom.plans.queries_text import _DOCS, _QS, _SCORES, read, strip_sql, words_sql
from mixloom.streaming import rollouts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def docs(spark, sf):
    return read(spark, sf, "documents")


def events(spark, sf):
    return read(spark, sf, "events")


def H(key: str) -> str:
    return f"md5({key}::varchar || '42')"


# -- mixing and sets ----------------------------------------------------------------------------


@q(f"select doc_id from documents order by {H('doc_id')}, doc_id limit (select (count(*) * 0.3)::bigint - (case when (count(*) * 0.3)::bigint > count(*) * 0.3 then 1 else 0 end) from documents)")
def mix_fraction(spark, sf):
    d = docs(spark, sf).select("doc_id")
    return mixing.sample_n(d, "doc_id", mixing.target_size(0.3, d.count()))


@q(f"with n as (select count(*) as n from eval_items) select item_id, k as copy_no from eval_items, unnest(range(0, (select 1000 // n from n))) as u(k) union all (select item_id, (select 1000 // n from n) from eval_items order by {H('item_id')}, item_id limit (select 1000 % n from n))")
def mix_upsample(spark, sf):
    return mixing.upsample(read(spark, sf, "eval_items").select("item_id"), "item_id", 1000).withColumn("copy_no", F.col("copy_no").cast("bigint"))


@q(f"with r as (select doc_id, lang, row_number() over (partition by lang order by {H('doc_id')}, doc_id) as rn from documents) select doc_id, lang from r where rn <= case lang when 'en' then 250 when 'de' then 100 when 'fr' then 100 when 'es' then 50 end")
def stratified_by_lang(spark, sf):
    return mixing.stratified(docs(spark, sf).select("doc_id", "lang"), "lang", {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, 500, "doc_id")


@q("select row_id, prompt_id, ingested_at from (select *, row_number() over (partition by row_id order by ingested_at, dataset nulls first) as rn from train_rows) where rn = 1")
def dedup_keep_first(spark, sf):
    return mixing.first_per_key(read(spark, sf, "train_rows").select("row_id", "prompt_id", "ingested_at", "dataset"), ["row_id"], [F.col("ingested_at").asc_nulls_last(), F.col("dataset").asc_nulls_first()]).drop("dataset")


@q("select source, doc_id, n_chars from (select *, row_number() over (partition by source order by coalesce(n_chars, -1) desc, doc_id) as rn from documents) where rn = 1")
def dedup_keep_longest(spark, sf):
    return mixing.first_per_key(docs(spark, sf).select("source", "doc_id", "n_chars"), ["source"], [F.coalesce("n_chars", F.lit(-1)).desc(), F.col("doc_id")])


@q(f"select source, doc_id from (select *, row_number() over (partition by source order by {H('doc_id')}, doc_id) as rn from documents) where rn = 1")
def random_per_source(spark, sf):
    return mixing.random_per_key(docs(spark, sf).select("source", "doc_id"), ["source"], "doc_id")


@q("select doc_id, source from documents where coalesce(source not in ('forum_archive', 'note_book'), true)")
def source_except(spark, sf):
    return mixing.remove_sources(docs(spark, sf), "source", ["forum_archive", "note_book"]).select("doc_id", "source")


@q("select prompt_id from train_rows intersect select prompt_id from completions")
def key_intersect(spark, sf):
    return mixing.common_keys([read(spark, sf, "train_rows"), read(spark, sf, "completions")], "prompt_id")


@q(f"select doc_id from (select doc_id, row_number() over (order by {H('doc_id')}, doc_id) as rn from documents) where rn > 100 and rn <= 300")
def offset_slice(spark, sf):
    return mixing.offset_slice(docs(spark, sf).select("doc_id"), "doc_id", 100, 200)


@q(f"select doc_id, (row_number() over (order by {H('doc_id')}, doc_id) - 1)::bigint as index from documents")
def dense_reindex(spark, sf):
    return mixing.dense_index(docs(spark, sf).select("doc_id"), [mixing.seeded(F.col("doc_id")), F.col("doc_id")]).select("doc_id", F.col("index").cast("bigint").alias("index"))


@q(f"with r as (select prompt_id, gen_id, count(*) over (partition by prompt_id) as c, row_number() over (partition by prompt_id order by {H('gen_id')}, gen_id) as rn from (select distinct prompt_id, gen_id from completions)) select prompt_id, gen_id from r where c >= 2 and rn <= 2")
def n_outputs_per_id(spark, sf):
    return mixing.n_per_id(read(spark, sf, "completions").select("prompt_id", "gen_id").distinct(), "prompt_id", 2, "gen_id").select("prompt_id", "gen_id")


@q("select doc_id, coalesce(lang = 'en', false) as kept from documents")
def keep_and_reject(spark, sf):
    kept, rejected = mixing.split_by(docs(spark, sf).select("doc_id", "lang"), F.col("lang") == "en")
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False))).select("doc_id", "kept")


@q(f"with a as (select item_id as k from eval_items order by {H('item_id')}, item_id limit 100), b as (select doc_id as k from documents order by {H('doc_id')}, doc_id limit (select count(*) // 4 from documents)) select 'items' as source, count(*) as n from a union all select 'docs', count(*) from b")
def combined_sources(spark, sf):
    out = mixing.combine({"items": (read(spark, sf, "eval_items").select("item_id"), "item_id", 100), "docs": (docs(spark, sf).select("doc_id"), "doc_id", 0.25)})
    return out.groupBy(F.regexp_extract("id", "^([a-z]+)_", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@q("select p.place, count(*) as n from (select row_id, unnest(range(0, 3)) as place from train_rows) p group by 1")
def repeated_rows(spark, sf):
    return mixing.repeat_rows(read(spark, sf, "train_rows").select("row_id"), 3, "place").groupBy(F.col("place").cast("bigint").alias("place")).agg(F.count(F.lit(1)).alias("n"))


# -- joins --------------------------------------------------------------------------------------


# Pairs of a row and an output of its prompt would grow by the square of a hot prompt, so there is one
# row a train row with its number of outputs, and the outputs of each prompt.
@q("select t.row_id, t.prompt_id, c.num_outputs from (select distinct row_id, prompt_id from train_rows) t join (select prompt_id, count(distinct gen_id) + max((gen_id is null)::int) as num_outputs from completions group by 1) c using (prompt_id)")
def outputs_per_row(spark, sf):
    t = read(spark, sf, "train_rows").select("row_id", "prompt_id").distinct()
    c = read(spark, sf, "completions").select("gen_id", "prompt_id").distinct()
    return joins.row_group_size(t, c, "prompt_id").select("row_id", "prompt_id", "num_outputs")


@q("select distinct prompt_id, gen_id from completions where prompt_id is not null")
def prompt_outputs(spark, sf):
    return read(spark, sf, "completions").where("prompt_id is not null").select("prompt_id", "gen_id").distinct()


@q("with l as (select prompt_id, arg_max(model, gen_id) as model from completions where model is not null group by 1) select t.row_id, l.model from (select distinct row_id, prompt_id from train_rows) t join l using (prompt_id)")
def latest_model(spark, sf):
    t = read(spark, sf, "train_rows").select("row_id", "prompt_id").distinct()
    c = read(spark, sf, "completions").where("model is not null").select("prompt_id", "model", "gen_id")
    return joins.lookup_last(t, c, "prompt_id", "gen_id").select("row_id", "model")


@q("select e.id, c.model from human_evals e left join (select distinct gen_id, model from completions) c on e.instance_id = c.gen_id::varchar")
def judgement_models(spark, sf):
    c = read(spark, sf, "completions").select(F.col("gen_id").cast("string").alias("instance_id"), "model").distinct()
    return read(spark, sf, "human_evals").join(c, "instance_id", "left").select("id", "model")


@q("select gen_id, sha256(text) as key from completions")
def text_keys(spark, sf):
    return read(spark, sf, "completions").select("gen_id", joins.text_key(F.col("text")).alias("key"))


@q("select a.gen_id, (a.n - 1)::int as a, (b.n - 1)::int as b from (select gen_id, unnest(range(1, len(outputs) + 1)) as n from (select distinct on (gen_id) gen_id, outputs from completions)) a join (select gen_id, unnest(range(1, len(outputs) + 1)) as n from (select distinct on (gen_id) gen_id, outputs from completions)) b on a.gen_id = b.gen_id and a.n < b.n")
def completion_pairs(spark, sf):
    o = read(spark, sf, "completions").dropDuplicates(["gen_id"]).select("gen_id", F.posexplode("outputs").alias("n", "o")).select("gen_id", "n", F.length("o.text").alias("len"))
    return preference.all_pairs(o, "gen_id", "n", "len").select("gen_id", "a", "b")


# -- preferences --------------------------------------------------------------------------------


@q(
    "with s as (select o_custkey, o_orderkey, round(o_totalprice / 10000, 0)::double as v from orders), r as (select *, row_number() over (partition by o_custkey order by v desc, o_orderkey) as b, row_number() over (partition by o_custkey order by v, o_orderkey desc) as w, count(*) over (partition by o_custkey) as n from s) select o_custkey, max(case when b = 1 then o_orderkey end) as chosen, max(case when w = 1 then o_orderkey end) as rejected, max(v) as chosen_score, min(v) as rejected_score from r where n >= 2 group by 1 having max(v) > min(v) and max(v) - min(v) >= 5 and max(v) >= 10"
)
def pref_binarize(spark, sf):
    o = read(spark, sf, "orders").withColumn("v", F.round(F.col("o_totalprice") / 10000, 0))
    return preference.binarize(o, "o_custkey", "o_orderkey", F.col("v"), "o_orderkey", min_score=10, margin=5.0)


@q(
    "with s as (select l_orderkey, l_linenumber, (l_quantity * 2 + floor(l_extendedprice / 1000))::double as v from lineitem), r as (select *, row_number() over (partition by l_orderkey order by v desc, l_linenumber) as b, row_number() over (partition by l_orderkey order by v, l_linenumber desc) as w, count(*) over (partition by l_orderkey) as n from s) select l_orderkey, max(v) as chosen_score, min(v) as rejected_score from r where n >= 2 group by 1 having max(v) > min(v)"
)
def pref_weighted(spark, sf):
    l = read(spark, sf, "lineitem").withColumn("p", F.floor(F.col("l_extendedprice") / 1000).cast("double"))
    return preference.binarize(l, "l_orderkey", "l_linenumber", preference.weighted({"l_quantity": 2.0, "p": 1.0}), "l_linenumber").select("l_orderkey", "chosen_score", "rejected_score")


@q("select user_id, arg_min(event_id, (-value, event_id)) as best, arg_min(event_id, (value, event_id)) as worst, count(*) as n from (select user_id, event_id, value from events) group by 1")
def best_worst(spark, sf):
    return preference.best_worst(events(spark, sf), "user_id", "value", "event_id")


@q("with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events where event_type is not null group by 1, 2), m as (select *, max(n) over (partition by user_id) as most, count(*) over (partition by user_id) as kinds from c), r as (select *, row_number() over (partition by user_id order by n desc, (case when most = 1 and kinds > 1 then md5(user_id::varchar || event_type || '42') else '' end), f) as rn from m) select user_id, event_type as winner, n as votes from r where rn = 1")
def majority_vote(spark, sf):
    return preference.majority(events(spark, sf), "user_id", "event_type", "event_id")


@q("select avg((a > b)::int::double) as accuracy, round(avg(a - b), 6) as margin, round(avg(ln(1 + exp(-(a - b)))), 6) as loss, count(*) as n from (select l_quantity / 10 as a, l_discount * 20 as b from lineitem)")
def reward_accuracy(spark, sf):
    l = read(spark, sf, "lineitem").select((F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 20).alias("b"))
    return preference.reward_accuracy(l, "a", "b").withColumn("margin", F.round("margin", 6)).withColumn("loss", F.round("loss", 6))


# -- rewards ------------------------------------------------------------------------------------


@q("select event_id, round((value - avg(value) over (partition by user_id)) / (stddev_pop(value) over (partition by user_id) + 1e-8), 6) as advantage from events")
def group_advantage(spark, sf):
    return rl.advantages(events(spark, sf), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@q("select event_id, round(value - avg(value) over (partition by user_id), 6) as advantage from events")
def group_advantage_centered(spark, sf):
    return rl.advantages(events(spark, sf), "user_id", "value", "centered").select("event_id", F.round("advantage", 6).alias("advantage"))


@q("select l_orderkey, l_linenumber from (select *, max(l_returnflag = 'R') over (partition by l_orderkey) as hi, min(l_returnflag = 'R') over (partition by l_orderkey) as lo from lineitem) where hi <> lo")
def group_zero_std(spark, sf):
    l = read(spark, sf, "lineitem").withColumn("r", (F.col("l_returnflag") == "R").cast("double"))
    return filters.drop_flat_groups(l, "l_orderkey", "r").select("l_orderkey", "l_linenumber")


@q("with g as (select l_orderkey, count(*)::double as n, count(*) filter (l_returnflag = 'R')::double as c from lineitem group by 1) select l_orderkey, round(c / n, 6) as p1, case when n < 2 then null when n - c < 2 then 1.0::double else round(1 - ((n - c) / n) * ((n - c - 1) / (n - 1)), 6) end as p2 from g")
def pass_at_k(spark, sf):
    g = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    return g.select("l_orderkey", F.round(F.col("c") / F.col("n"), 6).alias("p1"), F.round(rl.pass_at_k(F.col("n"), F.col("c"), 2), 6).alias("p2"))


@q("select o_custkey, avg((o_orderstatus = 'F')::int::double) as pass_rate, count(*) as n from orders group by 1 having avg((o_orderstatus = 'F')::int::double) between 0.2 and 0.8")
def correctness_band(spark, sf):
    return filters.within_band(read(spark, sf, "orders").withColumn("s", (F.col("o_orderstatus") == "F").cast("double")), "o_custkey", "s", 0.2, 0.8)


@q("select l_orderkey from (select l_orderkey, avg((l_discount >= 0.05)::int::double) as s from lineitem group by 1) where s >= 0.75")
def solved_prompts(spark, sf):
    return rollouts.excluded(read(spark, sf, "lineitem").withColumn("r", (F.col("l_discount") >= 0.05).cast("int")), "l_orderkey", "r", 1, 0.75)


@q("select l_orderkey, max(case when i = 1 then round(g, 4) end) as first_advantage, count(*) as n from (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) as i, sum(l_discount) over (partition by l_orderkey order by l_linenumber rows between current row and unbounded following) - l_tax as g from (select l_orderkey, l_linenumber, min(l_discount) as l_discount, min(l_tax) as l_tax from lineitem group by 1, 2)) group by 1")
def gae(spark, sf):
    l = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("r"), F.min("l_tax").alias("v"))
    a = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "r", "v"))).alias("s"))
    out = a.withColumn("g", rl.gae(F.transform("s", lambda x: x["v"]), F.transform("s", lambda x: x["r"])))
    return out.select("l_orderkey", F.round(F.element_at("g", 1), 4).alias("first_advantage"), F.size("g").cast("bigint").alias("n"))


@q("select event_type, count(*) as calls, round(avg((value < 10)::int::double), 6) as failure_rate, round(avg(value), 6) as mean_runtime, round(count(*) / (select count(distinct user_id) from events), 6) as calls_per_rollout from events group by rollup (event_type)")
def tool_stats(spark, sf):
    t = stats.tool_stats(events(spark, sf).withColumn("ok", F.col("value") >= 10), "user_id", "event_type", "ok", "value")
    return t.select("event_type", "calls", *[F.round(c, 6).alias(c) for c in ("failure_rate", "mean_runtime", "calls_per_rollout")])


@q("with g as (select user_id, max(event_type = 'error') = min(event_type = 'error') as flat, avg((event_type = 'error')::int::double) as solved, min(event_id) as lo, max(event_id) as hi, avg(event_id) as mid from events group by 1) select count(*) as groups, avg(flat::int::double) as flat_share, round(avg(solved), 6) as percent_solved, min(lo) as step_min, max(hi) as step_max, round(avg(mid), 4) as step_mean from g")
def batch_stats(spark, sf):
    b = stats.batch_stats(events(spark, sf).withColumn("r", (F.col("event_type") == "error").cast("double")), "user_id", "r", "event_id", 100, 1.0)
    return b.select("groups", "flat_share", F.round("percent_solved", 6).alias("percent_solved"), "step_min", "step_max", F.round("step_mean", 4).alias("step_mean"))


@q("select round(avg(value), 6) as score, round(avg((event_type <> 'error')::int::double), 6) as stop_rate, round(avg(length(props)), 6) as length, count(*) filter (value >= 50) as n from events")
def step_metrics(spark, sf):
    m = stats.step_metrics(events(spark, sf).withColumn("len", F.length("props")), "value", "len", F.col("event_type") != "error", 1.0)
    n = events(spark, sf).agg(F.count_if(F.col("value") >= 50).alias("n"))
    return m.join(n).select(F.round("score", 6).alias("score"), F.round("stop_rate", 6).alias("stop_rate"), F.round("length", 6).alias("length"), "n")


@q("with e as (select user_id, event_type, sum(value) as s from events group by 1, 2) select event_type, round(avg(s), 4) as mean, avg((s > 0)::int::double) as correct_rate, count(*) as n from e group by 1")
def verifier_rewards(spark, sf):
    return stats.verifier_rewards(events(spark, sf), "user_id", "event_type", "value").withColumn("mean", F.round("mean", 4))


@q("select event_type, round(avg(value * 0.5), 6) as mean, round(stddev_pop(value * 0.5), 6) as std, count(*) as n from events group by 1")
def rubric_metrics(spark, sf):
    m = stats.rubric_metrics(events(spark, sf), "event_type", F.col("value"), F.lit(0.5))
    return m.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@q("select l_orderkey, l_linenumber, round(ln(1 + exp(-0.1 * ((l_quantity / 10 - l_tax) - (l_discount - l_tax)))), 6) as loss from lineitem")
def dpo_loss(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(rl.dpo_loss(F.col("l_quantity") / 10, F.col("l_discount"), F.col("l_tax"), F.col("l_tax"), 0.1), 6).alias("loss"))


@q("select l_orderkey, l_linenumber, round(d, 6) as linear, round(d * d / 2, 6) as quadratic, round(exp(-d) - 1 + d, 6) as third, round(exp(d) * d, 6) as weighted from (select l_orderkey, l_linenumber, l_discount - l_tax as d from lineitem)")
def kl_estimates(spark, sf):
    k = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rl.kl_estimates(F.col("l_discount"), F.col("l_tax")).alias("k"))
    return k.select("l_orderkey", "l_linenumber", *[F.round(F.col("k")[i], 6).alias(n) for i, n in enumerate(("linear", "quadratic", "third", "weighted"))])


@q("select l_orderkey, round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) as mean from lineitem group by 1")
def masked_mean(spark, sf):
    a = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_linenumber")).alias("s"))
    return a.select("l_orderkey", F.round(rl.masked_mean(F.transform("s", lambda x: x["l_quantity"]), F.transform("s", lambda x: x["l_linenumber"])), 6).alias("mean"))


# The step is the day, so the share of the table that is fresh doesn't shrink with its size.
@q("select e.event_id, round((value - m) / (d + 1e-8), 6) as advantage from (select *, avg(value) over (partition by user_id) as m, stddev_pop(value) over (partition by user_id) as d, max(value) over (partition by user_id) - min(value) over (partition by user_id) as w from (select * from events where (select max(ts)::date from events) - ts::date <= 14)) e where w > 0")
def rollout_batch_days(spark, sf):
    e = events(spark, sf).withColumn("day", F.unix_date(F.to_date("ts")))
    step = e.agg(F.max("day")).first()[0]
    return registry.rollout_batch(e, "user_id", "value", "day", step, 14).select("event_id", F.round("advantage", 6).alias("advantage"))


@q("with s as (select user_id, event_id, value, (row_number() over (partition by user_id order by event_id) - 1) // 4 as g from events) select user_id, g as group_no, round(avg(value), 6) as mean, round(max(value) - min(value), 6) as spread from s group by 1, 2 having count(*) = 4")
def rollout_groups(spark, sf):
    g = rollouts.batch_groups(events(spark, sf), "user_id", "event_id", "value", 4)
    return g.select("user_id", "group_no", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


# -- packing ------------------------------------------------------------------------------------

_W = f"len({words_sql('text')})"


@q(f"select source, doc_id, (sum({_W}) over w - {_W})::bigint as start, (sum({_W}) over w)::bigint as \"end\" from documents where text is not null window w as (partition by source order by doc_id rows between unbounded preceding and current row)")
def token_offsets(spark, sf):
    d = docs(spark, sf).where("text is not null").withColumn("n", F.size(split_words(F.col("text"))))
    return packing.token_offsets(d, "source", "doc_id", "n").select("source", "doc_id", "start", "end")


@q(
    f"""with recursive d as (select source, doc_id, len({words_sql('text')})::bigint as n, row_number() over (partition by source order by doc_id) as i, least(sum(len({words_sql('text')})) over (partition by source), 1024) as cap from documents where text is not null),
f(source, i, pack, used, place) as (select source, i, 0::bigint, n, 0::bigint from d where i = 1 union all select d.source, d.i, case when f.used + d.n > greatest(d.cap, 1) then f.pack + 1 else f.pack end, case when f.used + d.n > greatest(d.cap, 1) then d.n else f.used + d.n end, case when f.used + d.n > greatest(d.cap, 1) then 0 else f.place + 1 end from f join d on d.source is not distinct from f.source and d.i = f.i + 1)
select d.source, d.doc_id, d.n, f.pack as pack_id, f.place from d join f on d.source is not distinct from f.source and d.i = f.i"""
)
def pack_greedy(spark, sf):
    d = docs(spark, sf).where("text is not null").withColumn("n", F.size(split_words(F.col("text"))))
    return packing.pack_greedy(d, "source", "doc_id", "n", 1024)


@q(
    f"""with recursive d as (select source, doc_id, len({words_sql('text')})::bigint as a, length(text)::bigint as b, row_number() over (partition by source order by doc_id) as i from documents where text is not null),
f(source, i, pack, a, b, n) as (select source, i, 0::bigint, a, b, 1 from d where i = 1 union all select d.source, d.i, case when f.a + d.a > 4096 or f.b + d.b > 4096 or f.n >= 16 then f.pack + 1 else f.pack end, case when f.a + d.a > 4096 or f.b + d.b > 4096 or f.n >= 16 then d.a else f.a + d.a end, case when f.a + d.a > 4096 or f.b + d.b > 4096 or f.n >= 16 then d.b else f.b + d.b end, case when f.a + d.a > 4096 or f.b + d.b > 4096 or f.n >= 16 then 1 else f.n + 1 end from f join d on d.source is not distinct from f.source and d.i = f.i + 1)
select d.source, d.doc_id, f.pack as pack_id, f.pack % 4 as rank from d join f on d.source is not distinct from f.source and d.i = f.i"""
)
def pack_two_stream(spark, sf):
    d = docs(spark, sf).where("text is not null").select("source", "doc_id", F.size(split_words(F.col("text"))).alias("a"), F.length("text").alias("b"))
    return packing.pack_two(d, "source", "doc_id", ("a", "b"), 4096, 16, 4)


@q(f"with s as (select source, sum({_W}) over (partition by source order by doc_id rows between unbounded preceding and current row) as s from documents where text is not null) select source, count(*) filter (s <= 2000) as fitting from s group by 1")
def within_budget(spark, sf):
    d = docs(spark, sf).where("text is not null").withColumn("n", F.size(split_words(F.col("text"))))
    return packing.within_budget(d, "source", "doc_id", "n", 2000)


@q("with i as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents) select doc_id, (i % 4)::int as rank, i // 4 as batch from i where i < n - n % 4")
def strided_ranks(spark, sf):
    d = mixing.dense_index(docs(spark, sf).select("doc_id"), [F.col("doc_id")])
    return packing.strided_ranks(d, "index", 4, d.count()).select("doc_id", "rank", "batch")


@q("with i as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents) select doc_id, (i // (n // 3))::int as worker from i where i < (n // 3) * 3")
def worker_blocks(spark, sf):
    d = mixing.dense_index(docs(spark, sf).select("doc_id"), [F.col("doc_id")])
    return packing.worker_blocks(d, "index", d.count(), 3).select("doc_id", "worker")


@q("select l_orderkey, count(*) as n, sum(l_linenumber)::bigint as positions, count(distinct l_linenumber) filter (l_linenumber > 0) as kinds from lineitem group by 1")
def collated_orders(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_linenumber")).alias("ids"))
    c = packing.collate(l.withColumn("labels", F.col("ids")), "l_orderkey", "l_linenumber", "ids", "labels")
    return c.select("l_orderkey", F.size("input_ids").cast("bigint").alias("n"), F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("positions"), F.size(F.array_distinct("input_ids")).cast("bigint").alias("kinds"))


# -- judgements ---------------------------------------------------------------------------------

_AT = "coalesce(try_strptime(timestamp, '%Y-%m-%d %H:%M:%S'), try_strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(timestamp, '%d/%m/%Y %H:%M'))"
_PK = "nullif(lower(trim(preference)), '')"


@q(f"select id, instance_id, evaluator from (select *, row_number() over (partition by instance_id, evaluator order by {_AT} desc nulls last, id desc) as rn from human_evals) where rn = 1")
def latest_judgements(spark, sf):
    return stats.latest_judgements(read(spark, sf, "human_evals")).select("id", "instance_id", "evaluator")


@q(f"with d as (select {_PK} as outcome from human_evals), c as (select outcome, case when prefix(outcome, 'a-is') then 'a' when prefix(outcome, 'b-is') then 'b' else 'tie' end as winner, count(*) as n from d where outcome is not null group by 1, 2) select outcome, winner, n, round(n / sum(n) over (), 6) as share, round(sum(n) over (partition by winner) / sum(n) over (), 6) as winner_share from c")
def win_rates(spark, sf):
    w = stats.win_rates(read(spark, sf, "human_evals"))
    return w.select("outcome", "winner", "n", F.round("share", 6).alias("share"), F.round("winner_share", 6).alias("winner_share"))


@q(f"with f as (select instance_id, case when prefix({_PK}, 'a-is') then 'a' when prefix({_PK}, 'b-is') then 'b' else 'tie' end as side, row_number() over (partition by instance_id order by {_AT} nulls last, id) as r from human_evals where {_PK} is not null), p as (select instance_id, max(case when r = 1 then side end) as x, max(case when r = 2 then side end) as y from f where r <= 2 group by 1 having max(case when r = 2 then side end) is not null) select count(*) as pairs, round(avg((x = y)::int::double), 6) as strict, round(avg(case when x = y then 1.0 when x = 'tie' or y = 'tie' then 0.5 else 0.0 end), 6)::double as relaxed from p")
def judgement_agreement(spark, sf):
    a = stats.preference_agreement(read(spark, sf, "human_evals"))
    return a.select("pairs", F.round("strict", 6).alias("strict"), F.round("relaxed", 6).alias("relaxed"))


@q(f"with f as (select *, row_number() over (partition by instance_id order by {_AT} nulls last, id) as r from human_evals), s as (select model_a as model, lower(trim(completion_a_is_acceptable)) as ok from f where r = 1 union all select model_b, lower(trim(completion_b_is_acceptable)) from f where r = 1) select model, count(*) as n, round(avg((ok = 'yes')::int::double), 6) as accepted from s where ok in ('yes', 'no') and model is not null group by 1")
def model_acceptance(spark, sf):
    return stats.acceptance(read(spark, sf, "human_evals")).withColumn("accepted", F.round("accepted", 6))


@q("select model_a, evaluator, round_even(avg(length(prompt)), 4) as mean from human_evals group by 1, 2")
def eval_summary_long(spark, sf):
    d = read(spark, sf, "human_evals").withColumn("v", F.length("prompt"))
    return stats.eval_means(d, "model_a", "evaluator", "v")


@q("select h.evaluator, count(*) as n, count(distinct instance_id) as instances from human_evals h group by 1")
def judgements_by_rater(spark, sf):
    return read(spark, sf, "human_evals").groupBy("evaluator").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("instance_id").alias("instances"))


@q("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark, sf):
    return rollouts.windowed_counts(events(spark, sf), "ts", "event_type", "1 hour")


@q("select dataset, count(*) as initial, count(*) filter (m > 1) as final, count(*) - count(*) filter (m > 1) as filtered from (select coalesce(dataset, 'none') as dataset, coalesce(len(messages), 0) as m from train_rows) group by 1")
def transform_stats(spark, sf):
    t = read(spark, sf, "train_rows").select(F.coalesce("dataset", F.lit("none")).alias("dataset"), F.coalesce(F.size("messages"), F.lit(0)).alias("tokens"))
    t = t.withColumn("trainable", F.col("tokens"))
    return stats.transform_stats(t, t.where("tokens > 1"), "dataset", "tokens", "trainable").select("dataset", "initial", "final", F.col("filtered").cast("bigint").alias("filtered"))


@q(
    """with d as (select *, l_orderkey::varchar || '-' || l_linenumber::varchar as k from lineitem), r as (select *, row_number() over (partition by l_orderkey order by l_quantity, k) as r, md5(k || '42') as h from d),
c as (select *, row_number() over (partition by l_orderkey order by case when r <= 4 then 0 else 1 end, h, k) as c from r), x as (select *, row_number() over (partition by l_orderkey order by case when c = 1 then 1 else 0 end, h desc, k) as x from c)
select l_orderkey, max(case when c = 1 then l_linenumber end) as chosen, max(case when x = 1 and c <> 1 then l_linenumber end) as rejected from x group by 1 having max(case when c = 1 then l_linenumber end) <> max(case when x = 1 and c <> 1 then l_linenumber end)"""
)
def rank_pairs(spark, sf):
    return preference.ranked_pair(read(spark, sf, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber")), "l_orderkey", "l_linenumber", "l_quantity", "k").select("l_orderkey", "chosen", "rejected")


_BLANK = f"len(list_filter(m, lambda x: {strip_sql('coalesce(x.content, ' + chr(39) * 2 + ')')} = '')) > 0"
_NAMED = f"len(list_filter(m, lambda x: x.role = 'assistant' and regexp_matches(lower(coalesce(x.content, '')), '\\b({filters.KEYWORDS})\\b'))) > 0"


@q(
    f"""with r as (select row_id, any_value(messages) as m from train_rows where messages is not null group by 1), few as (select * from r order by {H('row_id')}, row_id limit 100),
p as (select 0 as place, row_id, 'all' as dataset_source from r where not ({_BLANK}) and not ({_NAMED}) union all select 1, row_id, 'few' from few where not ({_BLANK}))
select row_number() over (order by place, row_id) - 1 as index, row_id, dataset_source from p"""
)
def mixture_plan(spark, sf):
    rows = read(spark, sf, "train_rows").dropDuplicates(["row_id"]).select("row_id", "messages").where("messages is not null")
    out = registry.mixture([registry.Source("all", rows, "row_id", 1.0, [("drop_blank", {}), ("drop_assistant_names", {})]), registry.Source("few", rows, "row_id", 100, [("drop_blank", {})])])
    return out.select("index", "row_id", "dataset_source")


@q(f"with {_DOCS}, {_QS}, {_SCORES} select row_id from train_rows where row_id not in (select original_id from s where score > 0.5)")
def decontamination_plan(spark, sf):
    return registry.decontamination(read(spark, sf, "train_rows").where("row_id is not null"), "row_id", read(spark, sf, "eval_items"), "item_id", "text").select("row_id")
