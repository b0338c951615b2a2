"""The operators applied to the given tables, and the SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyqa.functions.frames import scratch_path
from skyqa.llm import (
    decontaminate,
    divergence,
    embedding_dedup,
    filter_audit,
    jaccard,
    language,
    licenses,
    neighbours,
    packing,
    quality,
    secret_scan,
    substrings,
    token_files,
)
from skyqa.llm.tokens import tokenizer_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeated(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    names, model = language.train(_table(spark, folder, "documents"))
    return language.identify(_table(spark, folder, "pages"), names, model)


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, folder, "documents"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer_path())


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, folder, "documents"), F.col("source"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(_table(spark, folder, "documents"), path, tokenizer_path())
    return token_files.token_index(spark, path)


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op11_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_language_id,
        op3_benchmark_decontamination,
        op4_ngram_jaccard_join,
        op5_best_fit_packing,
        op6_secret_scan,
        op7_quality_classifier,
        op8_nearest_neighbours,
        op9_token_files,
        op10_license_scan,
        op11_embedding_dedup,
        op12_filter_audit,
        op13_source_divergence,
        pipeline,
    )
}

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
with words as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), windows as (
  select doc_id, unnest(range(1, len(w) - 11)) as i, w from words where len(w) >= 13
), marked as (
  select doc_id, i, min(doc_id) over (partition by array_to_string(w[i:i + 12], ' ')) as lo from windows
), gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as i from marked where lo < doc_id
), gone_lists as (
  select doc_id, list(i) as g from gone group by doc_id
), kept as (
  select doc_id, w, coalesce(g, []) as g from words left join gone_lists using (doc_id)
)
select doc_id, len(w)::bigint as n_words, len(g)::bigint as n_removed,
  sha256(coalesce(array_to_string(list_filter(w, (x, k) -> not list_contains(g, k)), ' '), '')) as kept_sha256
from kept""",
    "op11_embedding_dedup": """
with recursive vectors as (
  select vec_id, embedding::double[] as v from embeddings
), usable as (
  select * from vectors where vec_id is not null and len(v) > 0
    and len([x for x in v if x is null or not isfinite(x)]) = 0 and len([x for x in v if x <> 0]) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.9
), reached as (
  select vec_id as a, vec_id as b from usable union select r.a, l.b from reached r join links l on l.a = r.b
), lowest as (
  select a, min(b) as component_id from reached group by a
), counted as (
  select a, count(*) as n_links from links group by a
)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id,
  coalesce(component_id, vec_id) is not distinct from vec_id as kept
from vectors left join lowest l on l.a = vec_id left join counted c on c.a = vec_id""",
    "op12_filter_audit": r"""
with docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), said as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [x for x in [
      case when len(w) < 50 then 'A' end,
      case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' end,
      case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' end,
      case when regexp_matches(t, '[#$%&*|]') then 'D' end,
      case when min(docs.doc_id) over (partition by t) < docs.doc_id then 'E' end] if x is not null] as f
  from docs left join said using (doc_id)
), sets as (
  select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, f
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), gone as (
  select *, coalesce(list_min([instr(filter_order, x) for x in f]), 6) as lost from sets, orders
), steps as (
  select *, filter_order[step] as letter from gone, (select unnest(range(1, 6))::int as step)
), counts as (
  select part, filter_order, step, letter, sum(n) filter (lost > step) as kept, sum(n) filter (lost = step) as removed,
    sum(n) filter (lost < step and list_contains(f, letter)) as redundant, sum(n) filter (f = [letter]) as unique_fails,
    sum(good) filter (lost = step) as good_lost, sum(toxic) filter (lost = step) as toxic_lost
  from steps group by all
), shapley as (
  select part, letter, sum(removed) as shapley from counts group by part, letter
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(shapley, 0)::bigint as shapley
from counts join shapley using (part, letter)""",
    "op13_source_divergence": r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), terms as (
  select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), vocabulary as (
  select lang, term, count(*) as n from terms group by lang, term having count(distinct r) >= 30
), whole as (
  select lang, sum(n)::hugeint as total, count(*)::hugeint as v from vocabulary group by lang
), sources as (
  select distinct lang, source from docs
), counts as (
  select lang, source, term, count(*) as n from terms semi join vocabulary using (lang, term) group by all
), totals as (
  select lang, source, sum(n)::hugeint as total from counts group by all
), shares as (
  select s.lang, s.source, w.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) as p,
    1 + (1000000000::hugeint * (w.n + 5)) // (l.total + 5 * l.v) as q
  from sources s join whole l using (lang) join vocabulary w using (lang)
    left join totals t on t.lang = s.lang and t.source = s.source
    left join counts c on c.lang = s.lang and c.source = s.source and c.term = w.term
), differences as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
  from sources a join sources b on a.lang = b.lang and a.source <> b.source
    left join differences d on d.lang = a.lang and d.source = a.source and d.item = b.source
), ranked as (
  select lang, source, 'pair' as part, item, value,
    row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
  union all
  select lang, source, 'term', term, (p - q)::bigint,
    row_number() over (partition by lang, source order by p - q desc, term)::int from shares where n > 0 and p > q
)
select * from ranked where part = 'pair' or rank <= 50""",
}
