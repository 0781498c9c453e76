"""Queries of the way from folders to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.functions.text import chunk_documents as chunk
from askmill.operators import ingest
from askmill.sources import tables
from askmill.sources.shared import cut

SIZE, OVERLAP = 128, 1

FILES = """files as (
    select doc_id, lang, case when doc_id % 97 = 0 then '/docs/' || doc_id || '.pdf'
           else '/docs/' || lang || '/' || source || '/' || doc_id || (['.pdf', '.PDF', '.docx', '.doc', '.txt'])[doc_id % 5 + 1] end path
    from (select doc_id, coalesce(lang, 'xx') lang, coalesce(source, 'none') source from documents)),
current_files as (
    select doc_id, lang collection, path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) suffix
    from files where doc_id % 97 <> 0 and lower(regexp_extract(path, '(\\.[^./]*)$', 1)) in ('.pdf', '.doc', '.docx'))"""

INDEXED = """,
index_files as (
    select doc_id, collection, path file_path from current_files where doc_id % 3 <> 0
    union all select doc_id, lang, '/docs/' || lang || '/gone/' || doc_id || '.pdf' from files where doc_id % 10 = 0),
indexed as (select collection, file_path, unnest(range(0, doc_id % 4 + 1))::int chunk_index from index_files)"""

CHUNKS = f"""
split as (
    select *, list_filter(list_transform(regexp_extract_all(text, '([^.!?\\n]+[.!?]*)', 1), lambda x: trim(x)), lambda x: length(x) > 0) ss from source_docs),
sized as (select *, len(ss) n, list_transform(ss, lambda x: len(regexp_extract_all(x, '[^\\s]+'))) sz from split where len(ss) > 0),
summed as (select *, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(sz[1:i]), 0)::bigint) pre from sized),
walk as (
    select doc_id, 0 chunk_index, 0::bigint s, greatest(1, len(list_filter(pre, lambda v: v <= {SIZE})) - 1)::bigint e from summed
    union all
    select doc_id, chunk_index, s, greatest(s + 1, len(list_filter(pre, lambda v: v <= pre[s + 1] + {SIZE})) - 1) e
    from (select w.doc_id, w.chunk_index + 1 chunk_index, greatest(w.s + 1, w.e - {OVERLAP}) s, m.pre from walk w join summed m using (doc_id) where w.e < m.n)),
chunked as (
    select w.doc_id, m.collection, m.file_path, w.chunk_index, array_to_string(m.ss[w.s + 1:w.e], ' ') document,
           md5(concat_ws('|', m.collection, m.file_path, w.chunk_index::varchar)) id
    from walk w join summed m using (doc_id))"""


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.with_collection(ingest.filter_formats(tables.files(spark, sf_dir)), "/docs")


def _sync(spark: SparkSession, sf_dir: str):
    return ingest.sync(_current(spark, sf_dir), tables.indexed(spark, sf_dir))


def files_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir).groupBy("collection", "suffix").agg(F.count("*").alias("n_files"))


def sync_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir)[0].select("collection", "path")


def sync_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir)[1].select("collection", "file_path", "chunk_index")


def sync_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir)[2].select("collection", "file_path", "chunk_index")


def _chunks(spark: SparkSession, sf_dir: str, which: DataFrame) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = which.select("doc_id", "collection", F.col("path").alias("file_path")).join(docs, "doc_id")
    return chunk(rows, SIZE, OVERLAP)


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = tables.files(spark, sf_dir).select("doc_id", F.col("lang").alias("collection"), "path")
    return _chunks(spark, sf_dir, every).select("doc_id", "collection", "file_path", "chunk_index", "document", "id")


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, orphans, _ = _sync(spark, sf_dir)
    return ingest.ingest_report(new, _chunks(spark, sf_dir, new), orphans)


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with the chunks of all current files: those of known files replace what is there."""
    key = F.md5(F.concat_ws("|", "collection", "file_path", F.col("chunk_index").cast("string")))
    existing = tables.indexed(spark, sf_dir).withColumns({"id": key, "document": F.lit("old")})
    incoming = _chunks(spark, sf_dir, _current(spark, sf_dir)).select("collection", "file_path", "chunk_index", "id", "document")
    return ingest.upsert_collection(existing, incoming)


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The current files with their texts, and the texts that were indexed: of known and gone files, some with another ending than now."""
    texts = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    now = _current(spark, sf_dir).join(texts, "doc_id").select("doc_id", "collection", "path", "text")
    old = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" An old ending."), F.repeat(F.lit(" More of it."), 200))).otherwise(F.col("text"))
    path = F.when(F.col("doc_id") % 11 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    return now, now.filter("doc_id % 3 <> 0").select("collection", path.alias("path"), old.alias("text"))


def _chunked(rows: DataFrame) -> DataFrame:
    """Chunks with the fingerprint of their file."""
    return chunk(rows.select("collection", F.col("path").alias("file_path"), "text", ingest.fingerprint("text").alias("fingerprint")), SIZE, OVERLAP)


def _synced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    now, old = _versions(spark, sf_dir)
    index = _chunked(old)
    return now, index, ingest.sync_content(now.select("collection", "path", ingest.fingerprint("text").alias("fingerprint")), index)


def sync_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir)[2]


def resync_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after the edited files were chunked again: no chunk of an old ending is left."""
    now, index, status = _synced(spark, sf_dir)
    status = cut(status, "status")
    due = now.join(status.filter("status in ('new', 'changed')").select("collection", "path"), ["collection", "path"], "left_semi")
    return ingest.resync(index, status, _chunked(due)).select("collection", "file_path", "chunk_index", "id", "fingerprint", F.md5("document").alias("document_md5"))


_SOURCE = "source_docs as (select d.doc_id, f.{c} collection, f.path file_path, d.text from documents d join {f} f using (doc_id)),"

VERSIONS = """,
now_docs as (select doc_id, f.collection, f.path, coalesce(text, '') t, text from current_files f join documents using (doc_id)),
old_docs as (
    select doc_id, collection, case when doc_id % 11 = 0 then path || '.gone' else path end path,
           case when doc_id % 5 = 0 then text || ' An old ending.' || repeat(' More of it.', 200) else text end text
    from now_docs where doc_id % 3 <> 0),
kinds as (
    select coalesce(n.collection, o.collection) collection, coalesce(n.path, o.path) path,
           case when n.path is null then 'gone' when o.path is null then 'new' when coalesce(o.text, '') = n.t then 'same' else 'changed' end status
    from now_docs n full join (select * from old_docs where len(list_filter(regexp_extract_all(text, '([^.!?\\n]+[.!?]*)', 1), lambda x: length(trim(x)) > 0)) > 0) o on o.collection = n.collection and o.path = n.path)"""

QUERIES = {f.__name__: f for f in (files_by_collection, sync_new_files, sync_orphans, sync_survivors, chunk_documents, ingest_report, upsert_chunks, sync_by_content, resync_chunks)}
ORACLE_SQL = {
    "files_by_collection": f"with {FILES} select collection, suffix, count(*) n_files from current_files group by all",
    "sync_new_files": f"with {FILES}{INDEXED} select collection, path from current_files c where not exists (select 1 from indexed i where i.collection = c.collection and i.file_path = c.path)",
    "sync_orphans": f"with {FILES}{INDEXED} select * from indexed i where not exists (select 1 from current_files c where i.collection = c.collection and i.file_path = c.path)",
    "sync_survivors": f"with {FILES}{INDEXED} select * from indexed i where exists (select 1 from current_files c where i.collection = c.collection and i.file_path = c.path)",
    "chunk_documents": f"with recursive {FILES}, {_SOURCE.format(c='lang', f='files')} {CHUNKS} select * from chunked",
    "ingest_report": f"""with recursive {FILES}{INDEXED},
        new_files as (select * from current_files c where not exists (select 1 from indexed i where i.collection = c.collection and i.file_path = c.path)),
        {_SOURCE.format(c='collection', f='new_files')} {CHUNKS}
        select collection, sum(a)::bigint new_files, sum(b)::bigint chunks, sum(o)::bigint orphans from (
            select collection, 1 a, 0 b, 0 o from new_files union all select collection, 0, 1, 0 from chunked
            union all select collection, 0, 0, 1 from indexed i where not exists (select 1 from current_files c where i.collection = c.collection and i.file_path = c.path))
        group by collection""",
    "sync_by_content": f"""with recursive {FILES}{VERSIONS}, source_docs as (select doc_id, collection, path file_path, text from old_docs), {CHUNKS},
        had as (select collection, file_path path, count(*) chunks from chunked group by all)
        select collection, path, status, coalesce(chunks, 0)::bigint chunks from kinds left join had using (collection, path)""",
    "resync_chunks": f"""with recursive {FILES}{VERSIONS}, source_docs as (select doc_id, collection, path file_path, text from now_docs), {CHUNKS}
        select c.collection, file_path, chunk_index, id, sha256(coalesce(d.text, '')) fingerprint, md5(document) document_md5 from chunked c join now_docs d using (doc_id)""",
    "upsert_chunks": f"""with recursive {FILES}{INDEXED}, {_SOURCE.format(c='collection', f='current_files')} {CHUNKS},
        old as (select *, md5(concat_ws('|', collection, file_path, chunk_index::varchar)) id from indexed)
        select collection, file_path, chunk_index, id, document from chunked
        union all select collection, file_path, chunk_index, id, 'old' from old where id not in (select id from chunked)""",
}
