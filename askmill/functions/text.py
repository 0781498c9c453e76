"""Tokens, sentences, chunks and answers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: Tokens of two letters or more and nothing else. A hyphenated compound is one token, and so none of these.
TOKEN = r"(?<![\p{L}\p{N}_])(?<![\p{L}\p{N}_]-)\p{L}{2,}+(?![\p{L}\p{N}_])(?!-[\p{L}\p{N}_])"
SENTENCE = r"([^.!?\n]+[.!?]*)"


def tokens(text: Column | str) -> Column:
    """The kept tokens of a text in small letters, in order, with repeats."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


#: Tokens, or sentences, of a batch that a helper holds unpacked at once.
AT_ONCE = 1 << 18


def few_at_once(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of the lists, in order, with at most AT_ONCE values, or one list: so what is made of a batch's values stays small, however long its texts are."""
    ends, a = np.asarray(lists.offsets)[1:], 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, lists.offsets[a].as_py() + AT_ONCE, "right")))
        yield a, b
        a = b


def clean_answer(text: Column | str) -> Column:
    """Without one leading block of the model's thoughts and the white space after it."""
    return F.regexp_replace(text, r"(?s)^<think>.*?</think>\s*", "")


#: Words with a stopword's or a lemma's entry that each executor may be sent (some 30 bytes each); more are joined by shuffle.
MOST_WORDS = 400_000


def normalize_queries(queries: DataFrame, stopwords: DataFrame | None = None, lemmas: DataFrame | None = None, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, normalized: tokens without stopwords, each replaced by its lemma, joined by a space; a row for each query.

    ``stopwords``: word; ``lemmas``: word, lemma (the least of several). A stopword goes even if it has a lemma. While both tables are few they are sent
    to where the texts are, and a batch's distinct tokens are looked up once: no token is shuffled. Queries without tokens have an empty text.
    """
    rows = queries.select(F.col(query_id).alias("query_id"), F.coalesce(tokens(text), F.array().cast("array<string>")).alias("ws"))
    stop = [] if stopwords is None else [stopwords.select("word", F.lit(True).alias("stop"), F.lit(None).cast("string").alias("lemma"))]
    forms = [] if lemmas is None else [lemmas.filter("lemma is not null").select("word", F.lit(False).alias("stop"), "lemma")]
    if not stop + forms:
        return rows.select("query_id", F.array_join("ws", " ").alias("normalized"))
    changed = functools.reduce(DataFrame.unionByName, stop + forms).filter("word is not null").groupBy("word").agg(F.max("stop").alias("stop"), F.min("lemma").alias("lemma"))
    found = changed.limit(MOST_WORDS + 1).select("word", F.when(~F.col("stop"), F.col("lemma")).alias("to")).toArrow()
    if len(found) > MOST_WORDS:
        return _normalized_by_join(rows, changed)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    sent = queries.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        word, to = (pa.concat_arrays([pa.array([], pa.string()), *forms.column(c).chunks]) for c in ("word", "to"))
        for batch in batches:
            for a, b in few_at_once(batch.column(1)):
                part = batch.slice(a, b - a)
                flat = part.column(1).flatten().dictionary_encode()
                at = pc.index_in(flat.dictionary, word)
                changed_to = pc.if_else(pc.is_null(at), flat.dictionary, to.take(at))
                values = changed_to.take(flat.indices)
                on = np.asarray(values.is_valid())  # a stopword's form is null
                ends = np.r_[0, np.cumsum(on)][np.asarray(part.column(1).offsets) - part.column(1).offsets[0].as_py()].astype(np.int32)
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), values.drop_null()), " ")
                yield pa.RecordBatch.from_arrays([part.column(0), pc.utf8_trim(texts, " ")], names=["query_id", "normalized"])

    return rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, normalized string")


def _normalized_by_join(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """As above for any number of words. A text's distinct tokens alone meet the words, and what changes of them comes back to it; Spark splits the tasks of common ones."""
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    few = rows.select("__row", F.explode(F.array_distinct("ws")).alias("word")).join(changed, "word")
    own = few.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("word", F.when(~F.col("stop"), F.col("lemma"))))).alias("to"))
    out = rows.join(own, "__row", "left").withColumn("to", F.coalesce("to", F.expr("cast(map() as map<string, string>)")))
    kept = F.transform("ws", lambda w: F.when(F.map_contains_key("to", w), F.element_at("to", w)).otherwise(w))
    return out.select("query_id", F.trim(F.array_join(kept, " ")).alias("normalized"))


def clean_messages(rows: DataFrame, text: str = "text") -> DataFrame:
    """Messages stripped of white space at both ends; blank ones go."""
    return rows.withColumn(text, F.regexp_replace(text, r"^\s+|\s+$", "")).filter(F.length(text) > 0)


def runs(sizes: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """Runs [s, e) of sentences with at most ``most`` tokens, a sentence at least; the next starts ``overlap`` sentences before the end."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    out, s, n = [], 0, len(sizes)
    while s < n:
        e = max(s + 1, int(np.searchsorted(total, total[s] + most, "right")) - 1)
        out.append((s, e))
        if e >= n:
            break
        s = max(s + 1, e - overlap)
    return out


def words(sentence: str) -> int:
    return len(sentence.split())


def _word_counts(texts: pa.Array) -> np.ndarray:
    """``words`` of each text, for all at once."""
    trimmed = pc.utf8_trim_whitespace(texts)
    n = np.asarray(pc.list_value_length(pc.utf8_split_whitespace(trimmed)))
    return np.where(np.asarray(pc.equal(pc.binary_length(trimmed), 0)), 0, n)


def chunks(most: int, overlap: int, count_tokens: Callable[[str], int] = words):
    """An Arrow UDF: a document's sentences -> its chunks. ``count_tokens`` counts a sentence's tokens, by white space if not given.

    How far a chunk reaches is found for all sentences of a batch at once, and texts are joined by Arrow; only the way from chunk to chunk is walked.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.concat_arrays([pa.array([], pa.list_(pa.string())), *(cut(lists.slice(a, b - a)) for a, b in few_at_once(lists))])

    def cut(lists: pa.ListArray) -> pa.ListArray:
        flat, n = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        sizes = _word_counts(flat) if count_tokens is words else np.fromiter(map(count_tokens, flat.to_pylist()), np.int64, len(flat))
        ends, total = np.cumsum(n), np.r_[0, np.cumsum(sizes)]
        reach = np.maximum(np.searchsorted(total, total[:-1] + most, "right") - 1, np.arange(1, len(flat) + 1))
        reach = np.minimum(reach, np.repeat(ends, n)).tolist()
        first, last, per = [], [], [0]
        for s, end in zip((ends - n).tolist(), ends.tolist(), strict=True):
            while s < end:
                first.append(s)
                last.append(reach[s])
                s = end if reach[s] >= end else max(s + 1, reach[s] - overlap)
            per.append(len(first))
        length = np.array(last, np.int64) - np.array(first, np.int64)
        upto = np.cumsum(length)
        at = np.repeat(np.array(first, np.int64) - (upto - length), length) + np.arange(length.sum())
        held = pa.LargeListArray.from_arrays(pa.array(np.r_[0, upto], pa.int64()), flat.take(pa.array(at, pa.int64())))
        return pa.ListArray.from_arrays(pa.array(per, pa.int32()), pc.binary_join(held, " ").cast(pa.string()))

    return arrow_udf(run, "array<string>")


def sentences(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1)), lambda s: F.trim(s))
    return F.filter(found, lambda s: F.length(s) > 0)


def chunk_documents(docs: DataFrame, most: int = 512, overlap: int = 1, text: str = "text", count_tokens: Callable[[str], int] = words) -> DataFrame:
    """The rows of ``docs`` without their text, one for each chunk: chunk_index, document, id.

    ``docs`` needs collection and file_path. The id is made of collection, path and chunk number.
    """
    rows = docs.select(*[c for c in docs.columns if c != text], F.posexplode(chunks(most, overlap, count_tokens)(sentences(text))).alias("chunk_index", "document"))
    return rows.withColumn("id", F.md5(F.concat_ws("|", "collection", "file_path", F.col("chunk_index").cast("string"))))
