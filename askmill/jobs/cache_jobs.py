"""Queries of the answer cache and its session log, of dialogues and of snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.config import SearchConfig
from askmill.functions.hooks import generate
from askmill.functions.text import clean_answer
from askmill.functions.text import clean_messages as clean
from askmill.operators import cache, chat, snapshots
from askmill.sources import tables

CFG = SearchConfig(cache_threshold=0.3)
GAP = "12 hours"
FLUSHED = "2024-01-20 00:00:00"
NOW = "1998-06-15T12:00:00"
STAMP = "yyyy-MM-dd HH:mm:ss"


def _cached(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return cache.cached_answers(tables.vector_queries(spark, sf_dir), tables.cache(spark, sf_dir), mode, CFG, others=True).withColumn("score", F.round("score", 6))


def cached_answers_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir, "top1")


def cached_answers_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir, "first_rated")


def cached_answers_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir, "best_rated")


def route_cache_or_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.route(tables.vector_queries(spark, sf_dir), cached_answers_top1(spark, sf_dir))


def _echo(prompt: str) -> str:
    """A stand-in for a model: its thoughts, then the prompt's checksum."""
    return f"<think>about {len(prompt)}\n</think>\n {hashlib.md5(prompt.encode()).hexdigest()}"


def answered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers, and for the other questions generated ones, without their thoughts."""
    routes = route_cache_or_search(spark, sf_dir)
    texts = tables.corpus(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    rest = routes.filter("route = 'search'").select("query_id").join(texts, "query_id", "left")
    prompts = chat.build_prompts(rest.withColumns({"context": F.lit(None).cast("string"), "history": F.lit(None).cast("string")}), "short")
    made = generate(prompts, lambda: _echo, spark.sparkContext.defaultParallelism)
    return cache.answered(routes, tables.cache(spark, sf_dir), made).select("query_id", "route", "answer", "display_docs", "error")


def session_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as JSON entries, decoded again."""
    log = tables.ratings(spark, sf_dir)
    rows = cache.read_sessions(log.select(F.to_json(F.struct(*log.columns)).alias("entry")))
    return rows.select("session_id", "question_id", "msg", "answer", "display_docs", F.round("rating", 6).alias("rating"), F.date_format("ts", STAMP).alias("ts"), "seq")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cache.sessions(tables.ratings(spark, sf_dir), GAP)
    return rows.select("session_id", F.date_format("start", STAMP).alias("start"), F.date_format("last", STAMP).alias("last"), "entries")


def _flushed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.date_format("start", STAMP))


def session_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flushed(cache.flush(tables.ratings(spark, sf_dir), GAP, now=FLUSHED))


def session_flush_immediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flushed(cache.flush(tables.ratings(spark, sf_dir), GAP, immediate=True))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.latest_ratings(tables.ratings(spark, sf_dir))[0]


def latest_rating_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).withColumn("ts", F.date_format("ts", STAMP))


def cache_rating_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.apply_ratings(tables.rated(spark, sf_dir), _latest(spark, sf_dir))[0].withColumn("rating", F.round("rating", 6))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.upsert(tables.rated(spark, sf_dir), _latest(spark, sf_dir)).withColumn("rating", F.round("rating", 6))


def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(tables.turns(spark, sf_dir).filter("role = 'user'")).select("conv_id", "turn", "text")


def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prompt_history(tables.turns(spark, sf_dir))


def prompt_history_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prompt_history(tables.cleared_turns(spark, sf_dir), clear=chat.CLEAR)


def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = tables.turns(spark, sf_dir).filter("role = 'assistant'")
    thought = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("<think>a\nb</think>  \n "), "text")).otherwise(F.col("text"))
    return answers.select("conv_id", "turn", clean_answer(thought).alias("answer"))


def snapshots_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.old_snapshots(tables.snapshots(spark, sf_dir), NOW, 30)


def snapshots_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = tables.snapshots(spark, sf_dir)
    # Collections are priorities and order states, so that some have no snapshot at all.
    states = tables.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("collection"))
    return snapshots.due_collections(catalog.select("collection").union(states), catalog, NOW)


def snapshots_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.latest_snapshots(tables.snapshots(spark, sf_dir))


def snapshots_to_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collection's newest, each customer's first order by name, and names that don't exist."""
    catalog = tables.snapshots(spark, sf_dir)
    orders = tables.table(spark, sf_dir, "orders")
    named = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "o_orderpriority")).alias("f"))
    wanted = catalog.select("collection", F.lit(None).cast("string").alias("name")).distinct()
    wanted = wanted.unionByName(named.select(F.col("f.o_orderpriority").alias("collection"), F.concat(F.lit("snap-"), "f.o_orderkey").alias("name")))
    wanted = wanted.unionByName(catalog.select("collection", F.concat(F.lit("gone-"), "collection").alias("name")).distinct())
    return snapshots.select_snapshots(wanted, catalog)


_HEADS = [h.replace("'", "''") for h in chat.PROMPT]
CACHE = """with v as (select vec_id::varchar id, embedding::double[] e, 1.0::double + floor(vec_id / 10) % 5 rating from embeddings),
scored as (select q.id query_id, v.id question_id, list_cosine_similarity(q.e, v.e) score, v.rating from v q, v where q.id::bigint % 100 = 0 and q.id <> v.id),
near as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, question_id) rank from scored) where rank <= 5 and round(score, 9) >= 0.3),
top1 as (select query_id, question_id, round(score, 6) score, rating from near where rank = 1)"""

LOG = """log as (
    select user_id::varchar session_id, case when event_type <> 'signup' then json_extract_string(props, '$.k') end question_id,
           concat_ws('', event_type, json_extract_string(props, '$.k')) msg, 'answer ' || event_id answer, case when event_id % 2 = 0 then '/docs/' || json_extract_string(props, '$.k') end display_docs,
           case when event_id % 7 <> 0 then value % 6 end rating, ts, event_id seq from events)"""
SESSIONS = f"""with {LOG},
marked as (select *, case when ts - lag(ts) over w < interval 12 hours then 0 else 1 end fresh from log window w as (partition by session_id order by ts, seq)),
numbered as (select *, sum(fresh) over (partition by session_id order by ts, seq rows unbounded preceding) s from marked),
spans as (select session_id, s, min(ts) start, max(ts) last, count(*) entries from numbered group by session_id, s)"""
#: Each entry renews its session; the newest of its rated ones are flushed.
FLUSH = f"""{SESSIONS},
timed as (select n.*, start, last from numbered n join spans using (session_id, s)),
newest as (select *, row_number() over (partition by session_id, s, question_id order by ts desc, seq) r from timed where rating is not null)
select session_id, strftime(start, '%Y-%m-%d %H:%M:%S') start, question_id, msg, answer, display_docs, trunc(rating)::int rating from newest where r = 1"""
LATEST = f"""with {LOG},
latest as (select * from (select *, row_number() over (partition by session_id, question_id order by ts desc, seq) r from log where rating is not null) where r = 1),
rated as (select question_id, 'question ' || question_id question, 'old answer ' || question_id answer, null::varchar display_docs, 3.0::double + question_id::bigint % 3 rating, 1 + question_id::bigint % 5 rating_count from (select distinct question_id from log where question_id::bigint < 80)),
sums as (select question_id, sum(trunc(rating)::int) added, count(*) m from latest where question_id is not null group by question_id),
updated as (select question_id, question, answer, display_docs, round((rating * rating_count + added) / (rating_count + m), 6) rating, rating_count + m rating_count from rated join sums using (question_id))"""
TURNS = "turns as (select conv_id, turn, role, case when role = 'user' and conv_id % 7 = 0 and turn % 4 = 0 then '  ' || chr(10) || ' ' else text end text from conversations)"
SNAPSHOTS = """catalog as (
    select *, try_cast(rtrim(creation_time, 'Z') as timestamp) created_at from (
        select o_orderpriority collection, 'snap-' || o_orderkey as name, case when o_orderkey % 101 = 0 then 'bad' else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || case when o_orderkey % 2 = 0 then 'Z' else '' end end creation_time from orders)),
newest as (select collection, arg_max(name, (created_at, name)) as name from catalog where created_at is not null group by collection)"""

QUERIES = {
    f.__name__: f
    for f in (
        cached_answers_top1, cached_answers_first, cached_answers_best, route_cache_or_search, answered_union, session_entries, session_windows, session_flush, session_flush_immediate, latest_rating_per_question,
        cache_rating_update, cache_upsert, clean_messages, prompt_history, prompt_history_cleared, clean_answers, snapshots_expired, snapshots_due, snapshots_latest, snapshots_to_recover,
    )
}
ORACLE_SQL = {
    "cached_answers_top1": f"{CACHE} select * from top1",
    "cached_answers_first": f"{CACHE} select * from top1 where rating > 3",
    "cached_answers_best": f"{CACHE} select query_id, question_id, round(score, 6) score, rating from (select *, row_number() over (partition by query_id order by rating desc, rank) r from near where rating > 3) where r = 1",
    "route_cache_or_search": f"{CACHE} select q.id query_id, case when question_id is null then 'search' else 'cache' end route, question_id from (select id from v where id::bigint % 100 = 0) q left join top1 on q.id = query_id",
    "answered_union": f"""{CACHE}, routed as (select q.id query_id, question_id from (select id from v where id::bigint % 100 = 0) q left join top1 on q.id = query_id)
        select query_id, 'cache' route, 'answer ' || question_id answer, case when question_id::bigint % 4 <> 0 then '/docs/' || question_id end display_docs, null::varchar error from routed where question_id is not null
        union all select query_id, 'search', md5('{_HEADS[0]}' || 'short' || '{_HEADS[1]}' || '—' || '{_HEADS[2]}' || '—' || '{_HEADS[3]}' || coalesce(text, '')), null, null from routed left join documents on doc_id = query_id::bigint where question_id is null""",
    "session_entries": f"with {LOG} select session_id, question_id, msg, answer, display_docs, round(rating, 6) rating, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, seq from log",
    "session_windows": f"{SESSIONS} select session_id, strftime(start, '%Y-%m-%d %H:%M:%S') start, strftime(last, '%Y-%m-%d %H:%M:%S') \"last\", entries from spans",
    "session_flush": f"{FLUSH} and last + interval 12 hours <= timestamp '{FLUSHED}'",
    "session_flush_immediate": FLUSH,
    "latest_rating_per_question": f"{LATEST} select session_id, question_id, msg, answer, display_docs, trunc(rating)::int rating, strftime(ts, '%Y-%m-%d %H:%M:%S') ts from latest",
    "cache_rating_update": f"{LATEST} select * from updated",
    "cache_upsert": f"""{LATEST} select *, 'updated' status from updated
        union all select md5(concat_ws('|', session_id, msg)), msg, answer, display_docs, trunc(rating)::double, 1, 'new' from latest where question_id is null
        union all select *, 'untouched' from rated where question_id not in (select question_id from updated)""",
    "clean_messages": f"with {TURNS} select * from (select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') text from turns where role = 'user') where length(text) > 0",
    "prompt_history": f"""with {TURNS},
        pairs as (select conv_id, turn, text u, case when next_role = 'assistant' then next_text end b from (
            select *, lead(role) over w next_role, lead(text) over w next_text from turns window w as (partition by conv_id order by turn)) where role = 'user')
        select conv_id, turn, coalesce((select string_agg('Юзер: ' || u || ' | Бот: ' || b, chr(10) order by turn) from pairs x where x.conv_id = p.conv_id and x.turn < p.turn and b is not null), '—') history from pairs p""",
    "prompt_history_cleared": f"""with {TURNS},
        marked as (select *, role = 'user' and (conv_id + turn) % 5 = 0 cleared from turns),
        counted as (select *, sum(cleared::int) over (partition by conv_id order by turn) epoch from marked),
        pairs as (select conv_id, epoch, turn, text u, case when next_role = 'assistant' then next_text end b from (
            select *, lead(role) over w next_role, lead(text) over w next_text from counted window w as (partition by conv_id, epoch order by turn)) where role = 'user' and not cleared)
        select conv_id, turn, coalesce((select string_agg('Юзер: ' || u || ' | Бот: ' || b, chr(10) order by turn) from pairs x where x.conv_id = p.conv_id and x.epoch = p.epoch and x.turn < p.turn and b is not null), '—') history from pairs p""",
    "clean_answers": "select conv_id, turn, text answer from conversations where role = 'assistant' and not starts_with(text, '<think>') union all select conv_id, turn, regexp_replace(text, '^<think>.*?</think>\\s*', '', 's') from conversations where role = 'assistant' and starts_with(text, '<think>')",
    "snapshots_expired": f"with {SNAPSHOTS} select collection, name, creation_time from catalog where created_at < timestamp '{NOW}' - interval 30 days",
    "snapshots_due": f"with {SNAPSHOTS} select collection from (select collection from catalog union select o_orderstatus from orders) where collection not in (select collection from catalog where created_at::date = date '{NOW[:10]}')",
    "snapshots_latest": f"with {SNAPSHOTS} select * from newest",
    "snapshots_to_recover": f"""with {SNAPSHOTS}, first_orders as (select o_custkey, arg_min(o_orderpriority, o_orderkey) collection, 'snap-' || min(o_orderkey) as name from orders group by o_custkey)
        select collection, name, 'ok' status from newest union all select collection, name, 'ok' from first_orders union all select distinct collection, 'gone-' || collection, 'missing' from catalog""",
}
