"""Queries of retrieval: lexical, dense, hybrid and late, and what is made of their hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.config import SearchConfig
from askmill.functions.text import normalize_queries as normalize
from askmill.functions.text import tokens
from askmill.operators import chat, dense, ingest, lexical, search
from askmill.sources import tables
from askmill.sources.shared import new_folder

#: Nearest neighbours in the test vectors are far apart, and their texts' BM25 scores are large; the thresholds are set so that both filters bite.
CFG = SearchConfig(dense_threshold=0.2, sparse_threshold=90.0, threshold=0.3)
# Words without meaning of their own, and the system text of the retrieval chat.
STOPWORDS = ("the", "of", "and", "to", "in", "de", "la", "der", "die", "und", "el", "que", "le", "les")
SYSTEM = (
    "Ты отвечаешь коротко только на вопрос пользователя и останавливаешься, отвечаешь ВСЕГДА только по-русски, даже если вопрос задан на другом языке, "
    "ничего не уточняешь и не переспрашиваешь. Если в контексте нерелевантные данные или нет данных, то отвечай, что не знаешь."
)
CODE = "Ты помогаешь писать и объяснять программы."


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_index(tables.corpus(spark, sf_dir).select("collection", "id", "text"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once for the index; the searches read that."""
    path = lexical.write_index(tables.corpus(spark, sf_dir).select("collection", "id", "text"), new_folder(spark, "index"))
    return lexical.sparse_topk(lexical.query_terms(tables.questions(spark, sf_dir)), lexical.read_index(spark, path), CFG.sparse_limit, others=True)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_topk(tables.questions(spark, sf_dir), tables.corpus(spark, sf_dir), CFG.dense_limit, others=True)


def _rounded(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.withColumns({c: F.round(c, 6) for c in columns})


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse(_dense(spark, sf_dir), _sparse(spark, sf_dir), CFG)


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.build_postings(_index(spark, sf_dir))


def bm25_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequencies(_index(spark, sf_dir))


def normalize_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("query_id"), "text")
    items = tables.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("query_id"), "text")
    every = docs.unionByName(items)
    words = every.select(F.explode(tokens("text")).alias("word")).distinct()
    lemmas = words.filter(F.length("word") > 5).select("word", F.regexp_replace("word", "(ing|ed|en)$", "").alias("lemma")).filter("word <> lemma")
    stop = spark.createDataFrame([(w,) for w in STOPWORDS], "word string")
    return normalize(every, stop, lemmas)


def vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = ingest.check_vectors(tables.table(spark, sf_dir, "embeddings"), 64, "embedding")
    return good.select("vec_id", F.lit(True).alias("ok")).unionByName(bad.select("vec_id", F.lit(False).alias("ok")))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dense.dense_topk(tables.vector_queries(spark, sf_dir), tables.vectors(spark, sf_dir), 20, others=True), "score")


def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_topk(spark, sf_dir).filter(F.col("score") >= 0.3)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_sparse(spark, sf_dir), "score")


def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _dense(spark, sf_dir).withColumn("side", F.lit("dense")).unionByName(_sparse(spark, sf_dir).withColumn("side", F.lit("sparse")))
    return _rounded(search.minmax_scores(hits), "score", "scaled")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_hybrid(spark, sf_dir), "score", "dense_score", "sparse_score")


def hybrid_sparse_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.fuse(None, _sparse(spark, sf_dir), CFG), "score", "dense_score", "sparse_score")


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.candidate_union(_dense(spark, sf_dir), _sparse(spark, sf_dir))


def late_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = tables.late(tables.questions(spark, sf_dir), "qvec", "qlate").select("query_id", "qlate")
    vectors = tables.late(tables.corpus(spark, sf_dir), "dense", "late").select("id", "late")
    return _rounded(search.late_rerank(candidate_union(spark, sf_dir), queries, vectors, CFG), "score")


def _payload(spark: SparkSession, sf_dir: str, but: tuple[str, ...] = ()) -> DataFrame:
    return search.attach_payload(_hybrid(spark, sf_dir), tables.corpus(spark, sf_dir), but)


def hits_with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payload(spark, sf_dir).withColumns({c: F.round(F.col("payload")[f"_{c}"].cast("double"), 6) for c in ("dense_score", "sparse_score")})
    return rows.select("query_id", "id", "rank", "file_path", F.md5("document").alias("document_md5"), "display_docs", "rating", "rating_count", F.col("payload")["source"].alias("payload_source"), "dense_score", "sparse_score")


def context_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.context_per_query(_payload(spark, sf_dir, ("document",)), tables.questions(spark, sf_dir))


def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = tables.questions(spark, sf_dir)
    rows = chat.context_per_query(_payload(spark, sf_dir, ("document",)), queries).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return chat.build_prompts(rows.withColumn("history", F.lit(chat.NONE)), SYSTEM)


def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_report(_dense(spark, sf_dir).filter(F.col("score") >= CFG.dense_threshold), _sparse(spark, sf_dir).filter(F.col("score") >= CFG.sparse_threshold))


def hits_per_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _dense(spark, sf_dir).select("query_id", F.lit("dense").alias("method")).unionByName(_sparse(spark, sf_dir).select("query_id", F.lit("sparse").alias("method")))
    return search.hit_counts(hits, tables.questions(spark, sf_dir))


def prompts_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each user's turn: without search, so without context, but with the dialogue before it and the system text of the conversation's tab."""
    turns = tables.turns(spark, sf_dir)
    history = chat.prompt_history(turns).withColumn("session_id", F.concat(F.when(F.col("conv_id") % 2 == 0, "chat_").otherwise("code_"), F.col("conv_id").cast("string")))
    tabs = spark.createDataFrame([("chat", SYSTEM), ("code", CODE)], "prefix string, system string")
    asked = chat.pairs(turns).select("conv_id", "turn", F.col("u").alias("query"))
    rows = chat.system_prompts(history, tabs).join(asked, ["conv_id", "turn"])
    return chat.build_prompts(rows.select(F.concat_ws("/", "session_id", F.col("turn").cast("string")).alias("query_id"), "system", F.lit(None).cast("string").alias("context"), "history", "query"))


def decode_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _rounded(_sparse(spark, sf_dir), "score").groupBy("query_id").agg(F.collect_list(F.struct("id", "score", F.lit("sparse").alias("source"))).alias("documents"))
    replies = hits.select("query_id", F.to_json(F.struct("documents")).alias("reply"))
    return search.explode_hits(replies)


TOKENS = """list_filter(list_transform(regexp_extract_all({t}, '([\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)*)', 1), lambda t: lower(t)), lambda t: regexp_matches(t, '^\\p{{L}}{{2,}}$'))"""

CORPUS = f"""corpus as (
    select 'docs' collection, doc_id::varchar id, text, case when doc_id % 7 <> 0 then '/docs/' || coalesce(lang, 'xx') || '/' || doc_id end path, case when doc_id % 2 <> 0 then 'see ' || doc_id end docs,
           case when doc_id % 3 <> 0 then 1.0::double + doc_id % 5 end stars, case when doc_id % 3 <> 0 then doc_id % 4 end votes, source, embedding::double[] dense, coalesce({TOKENS.format(t="text")}, []) ts
    from documents left join embeddings on doc_id = vec_id),
postings as (select collection, id, term, count(*)::int tf, dl from (select collection, id, unnest(ts) term, len(ts)::int dl from corpus) group by all)"""
QUESTIONS = """,
questions as (select id query_id, coalesce(text, '') text, dense qvec from corpus where id::bigint % 100 = 0)"""
SPARSE = f""",
terms as (select query_id, unnest(list_distinct({TOKENS.format(t="text")})) term from questions),
freq as (select term, count(*) df from postings group by term),
stats as (select count(*) n, avg(len(ts)) avgdl from corpus),
sparse_all as (
    select query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) score
    from terms join postings using (term) join freq using (term), stats where id <> query_id group by query_id, id),
sparse as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int rank from sparse_all) where rank <= 20)"""
DENSE = """,
dense_all as (select query_id, id, case when list_dot_product(qvec, qvec) = 0 or list_dot_product(c.dense, c.dense) = 0 then 0.0 else list_cosine_similarity(qvec, c.dense) end score
    from questions, corpus c where id <> query_id and qvec is not null and c.dense is not null),
dense as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int rank from dense_all) where rank <= 20)"""


def _fusion(with_dense: bool) -> str:
    sides = f"select query_id, id, score, rank, 'sparse' side from sparse where score >= {CFG.sparse_threshold}"
    if with_dense:
        sides += f" union all select query_id, id, score, rank, 'dense' from dense where score >= {CFG.dense_threshold}"
    return f""",
scaled as (select *, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end v
    from ({sides}) window w as (partition by query_id, side)),
fused as (
    select query_id, id, coalesce(d.v, 0) dv, coalesce(s.v, 0) sv, coalesce(d.score, 0) dense_score, coalesce(s.score, 0) sparse_score, d.rank dr, s.rank sr
    from (select * from scaled where side = 'dense') d full join (select * from scaled where side = 'sparse') s using (query_id, id)),
hybrid as (
    select query_id, id, round(score, 6) score, case when dv >= sv then 'dense' else 'sparse' end source, round(dense_score, 6) dense_score, round(sparse_score, 6) sparse_score, rank from (
        select *, row_number() over (partition by query_id order by round(score, 9) desc, dr asc nulls last, sr asc nulls last)::int rank
        from (select *, 0.5 * dv + 0.5 * sv score from fused) where round(score, 9) >= {CFG.threshold}) where rank <= 10)"""


ALL = f"with {CORPUS}{QUESTIONS}{SPARSE}{DENSE}"
VECTORS = """with v as (select vec_id::varchar id, embedding::double[] e from embeddings),
scored as (select q.id query_id, v.id, list_cosine_similarity(q.e, v.e) score from v q, v where q.id::bigint % 100 = 0 and q.id <> v.id),
top as (select query_id, id, round(score, 6) score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int rank from scored) where rank <= 20)"""
CONTEXT = """,
context as (
    select q.query_id, coalesce(c, '—') context, case when c is null then null else 'Релевантные документы:' || chr(10) || chr(10) || p end display, case when c is null then 'no_documents' else 'ok' end status, q.text query
    from questions q left join (
        select query_id, string_agg(distinct text, chr(10) order by text) c, string_agg(distinct coalesce(path, '—'), chr(10) || chr(10) order by coalesce(path, '—')) p from hybrid join corpus using (id) group by query_id) using (query_id))"""

# Dialogues, as cache_jobs has them too.
TURNS = "turns as (select conv_id, turn, role, case when role = 'user' and conv_id % 7 = 0 and turn % 4 = 0 then '  ' || chr(10) || ' ' else text end text from conversations)"
HISTORY = """pairs as (select conv_id, turn, text u, case when next_role = 'assistant' then next_text end b from (
    select *, lead(role) over w next_role, lead(text) over w next_text from turns window w as (partition by conv_id order by turn)) where role = 'user')"""
LINES = "coalesce((select string_agg('Юзер: ' || u || ' | Бот: ' || b, chr(10) order by turn) from pairs x where x.conv_id = p.conv_id and x.turn < p.turn and b is not null), '—')"

_HEADS = [h.replace("'", "''") for h in chat.PROMPT]
QUERIES = {
    f.__name__: f
    for f in (
        bm25_postings, bm25_df, normalize_queries, vector_dim_check, dense_topk, dense_threshold, bm25_topk, minmax_scores, hybrid_search, hybrid_sparse_only, candidate_union, late_rerank,
        hits_with_payload, hits_per_method, context_per_query, build_prompts, prompts_with_history, search_report, decode_hits,
    )
}
ORACLE_SQL = {
    "bm25_postings": f"with {CORPUS} select * from postings",
    "bm25_df": f"with {CORPUS} select collection, term, count(*) df from postings group by all",
    "normalize_queries": f"""with every as (select 'd' || doc_id query_id, text from documents union all select 'b' || item_id, text from benchmark),
        words as (select query_id, unnest(list_zip(ts, range(len(ts)))) x from (select query_id, {TOKENS.format(t="text")} ts from every)),
        kept as (select query_id, x[1] w, x[2] p from words where x[1] not in {STOPWORDS}),
        done as (select query_id, string_agg(case when length(w) > 5 then regexp_replace(w, '(ing|ed|en)$', '') else w end, ' ' order by p) t from kept group by query_id)
        select query_id, coalesce(trim(t), '') normalized from (select distinct query_id from every) left join done using (query_id)""",
    "vector_dim_check": "select vec_id, coalesce(len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null)) = 0, false) ok from embeddings",
    "dense_topk": f"{VECTORS} select * from top",
    "dense_threshold": f"{VECTORS} select * from top where score >= 0.3",
    "bm25_topk": f"with {CORPUS}{QUESTIONS}{SPARSE} select query_id, id, round(score, 6) score, rank from sparse",
    "minmax_scores": f"""{ALL} select query_id, id, round(score, 6) score, rank, side, round(case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 6) scaled
        from (select *, 'dense' side from dense union all select *, 'sparse' from sparse) window w as (partition by query_id, side)""",
    "hybrid_search": f"{ALL}{_fusion(True)} select * from hybrid",
    "hybrid_sparse_only": f"{ALL}{_fusion(False)} select * from hybrid",
    "candidate_union": f"{ALL} select query_id, id from dense union select query_id, id from sparse",
    "late_rerank": f"""{ALL},
        cut as (select id, list_transform(range(8), lambda k: dense[k * 8 + 1:k * 8 + 8]) late from corpus where dense is not null),
        units as (select id, list_transform(late, lambda v: case when list_dot_product(v, v) = 0 then v else list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) end) late from cut),
        found as (select query_id, id from dense union select query_id, id from sparse),
        scored as (select query_id, f.id, list_sum(list_transform(q.late, lambda a: list_max(list_transform(c.late, lambda b: list_dot_product(a, b))))) score
            from found f join units c on f.id = c.id join units q on q.id = f.query_id)
        select query_id, id, round(score, 6) score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int rank from scored) where rank <= 5""",
    "hits_with_payload": f"""{ALL}{_fusion(True)} select query_id, id, rank, coalesce(path, '—') file_path, md5(coalesce(text, '')) document_md5, coalesce(docs, '') display_docs, coalesce(stars, 0.0) rating, coalesce(votes, 0) rating_count,
        source payload_source, dense_score, sparse_score from (select query_id, id, rank, dense_score, sparse_score from hybrid) join corpus using (id)""",
    "hits_per_method": f"{ALL} select 'docs' collection, 'dense' as method, count(*) hits from dense having count(*) > 0 union all select 'docs', 'sparse', count(*) from sparse having count(*) > 0",
    "prompts_with_history": f"""with {TURNS}, {HISTORY}
        select case when conv_id % 2 = 0 then 'chat_' else 'code_' end || conv_id || '/' || turn query_id,
               '{_HEADS[0]}' || case when conv_id % 2 = 0 then '{SYSTEM}' else '{CODE}' end || '{_HEADS[1]}' || '—' || '{_HEADS[2]}' || history || '{_HEADS[3]}' || coalesce(u, '') prompt
        from (select conv_id, turn, u, {LINES} history from pairs p)""",
    "context_per_query": f"{ALL}{_fusion(True)}{CONTEXT} select query_id, context, display, status from context",
    "build_prompts": f"{ALL}{_fusion(True)}{CONTEXT} select query_id, '{_HEADS[0]}' || '{SYSTEM}' || '{_HEADS[1]}' || context || '{_HEADS[2]}' || '—' || '{_HEADS[3]}' || query prompt from context",
    "search_report": f"""{ALL} select query_id, sum(d)::bigint dense_hits, sum(s)::bigint sparse_hits from (
        select query_id, 1 d, 0 s from dense where score >= {CFG.dense_threshold} union all select query_id, 0, 1 from sparse where score >= {CFG.sparse_threshold}) group by query_id""",
    "decode_hits": f"with {CORPUS}{QUESTIONS}{SPARSE} select query_id, id, round(score, 6) score, 'sparse' source from sparse",
}
