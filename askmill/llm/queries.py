"""One query for each operator of the subpackage, over its whole table, with its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.llm import chat, classifier, collocations, language, minhash, mixing, packing, quality, shards, template, tokens, trie, vectors
from askmill.llm.common import table


def op1_template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(table(spark, sf_dir, "pages"))


def op2_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.fair_queue(table(spark, sf_dir, "documents"))
    first = mixing.mix_order(plan).filter("copy = 0")
    return first.select("doc_id", "size", "source_size", "target", "taken", F.round("first_finish", 6).alias("first_finish"), F.coalesce("position", F.lit(-1)).alias("position"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judge(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shards.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, shards.new_folder(spark))
    return shards.read_shards(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


#: WFQ by windows: the same hash order, running totals and finish time.
OP2_SQL = """
with sized as (
    select doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]', '', 'g')), 0)::bigint size,
           md5('mix|' || doc_id::varchar) shuffle
    from documents),
sources as (
    select source, sum(size)::bigint source_size, ((row_number() over (order by source nulls last)) - 1) % 3 + 1 weight
    from sized group by source),
lasting as (select *, 3 * source_size whole, (3 * source_size)::double / weight runs_out from sources),
served as (
    select *, coalesce(sum(whole) over (order by runs_out, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint spent,
           sum(weight) over (order by runs_out, source nulls last rows between current row and unbounded following)::bigint rest_weight,
           sum(source_size) over ()::bigint budget
    from lasting),
fin as (select arg_min(v, runs_out) finish from (select (budget - spent)::double / rest_weight v, runs_out from served) where v <= runs_out),
targets as (select source, source_size, weight, case when runs_out <= finish then whole::double else weight * finish end target from served, fin),
placed as (
    select s.*, coalesce(sum(size) over (partition by source order by shuffle, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint ahead
    from sized s),
plan as (
    select p.doc_id, p.size, t.source_size, t.target, p.shuffle, t.weight, (p.ahead + p.size / 2.0)::double / t.weight first_finish,
           (case when p.size = 0 or t.source_size = 0 then 0
            else greatest(0, least(3, floor((t.target - (p.ahead + p.size / 2.0)) / t.source_size) + 1)) end)::bigint copies
    from placed p join targets t on p.source is not distinct from t.source),
copied as (select *, unnest(range(greatest(copies, 1))) as copy from plan),
ordered as (
    select *, sum(case when copies > 0 then 1 else 0 end) over (
        order by first_finish + (copy * source_size)::double / weight, shuffle, doc_id, copy rows between unbounded preceding and current row)::bigint - 1 place
    from copied)
select doc_id, size, source_size, target, size * copies taken, round(first_finish, 6) first_finish, case when copies > 0 then place else -1 end as position from ordered where copy = 0
"""


#: Phrases by windows over words: all n-grams are counted, without bitmaps or pruning.
OP13_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
    from documents),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from pieces),
grams as (
    select lang, m, array_to_string(ws[i:i + m - 1], ' ') phrase from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) i from split, (select unnest([1, 2, 3, 4]) m))),
counted as (select lang, m, phrase, count(*) f from grams group by all),
totals as (select lang, sum(f)::bigint n from counted where m = 1 group by lang),
candidates as (select lang, m, phrase, f a, string_split(phrase, ' ') ws from counted where m > 1 and f >= 30),
cuts as (
    select c.lang, c.phrase, c.m, c.a, k, x.f l, y.f r, ((2000000::hugeint * c.a) // (x.f + y.f))::bigint score
    from (select *, unnest(range(1, m)) k from candidates) c
    join counted x on x.lang = c.lang and x.m = k and x.phrase = array_to_string(c.ws[1:k], ' ')
    join counted y on y.lang = c.lang and y.m = c.m - k and y.phrase = array_to_string(c.ws[k + 1:c.m], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
    select lang, array_to_string(ws[i:i + s - 1], ' ') phrase, max(a) f
    from (select *, unnest(range(1, m - s + 2)) i from (select *, unnest(range(2, m)) s from candidates)) group by all),
kept as (select b.* from best b left join inner_parts p using (lang, phrase) where p.f is null or 100::hugeint * p.f < 80::hugeint * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select lang, rank, phrase, a, l::bigint l, r::bigint r, n, score from ranked join totals using (lang) where rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_template_slots, op2_fair_mix, op3_hyperminhash, op4_token_counts, op5_role_repair, op6_divergence_rules, op7_language_id, op8_token_shards, op9_sum_of_squares, op10_binary_codes, op11_prefix_trie, op12_ftrl_quality, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    return {"op2_fair_mix": OP2_SQL, "op13_phrases": OP13_SQL}
