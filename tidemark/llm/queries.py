"""One query per operator over the whole documents table, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, fingerprint, jaccard, langid, lines, mixing, pii, secrets, toxicity
from .shared import documents

Query = Callable[[SparkSession, str], DataFrame]


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(documents(spark, sf_dir))


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), "assign_log10")


def _of(kind: str):
    return lambda span: span["kind"] == kind


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.counted(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "max_score")


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(documents(spark, sf_dir))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(documents(spark, sf_dir))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_language_id": language_id,
    "op2_mix_sources": mix_sources,
    "op3_exact_dedup": exact_dedup,
    "op4_toxicity": toxic_scores,
    "op5_secret_scan": secret_scan,
    "op6_pii": pii_scan,
    "op7_jaccard_join": jaccard_join,
    "op8_fingerprints": document_fingerprints,
    "op9_line_dedup": line_dedup,
    "op10_byte_bpe": byte_bpe,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
        with t as (
          select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
            md5('17:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as place
          from documents
        ), s as (
          select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as i from t group by source
        ), w as (
          select *, case i when 0 then 3.0 when 1 then 1.0 else 2.0 end::double as weight, 2.0::double * source_size as cap from s
        ), l as (
          select *, (1.5::double * (select sum(source_size)::double from w) - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level, row_number() over (order by cap / weight, source nulls last) as nth from w
        ), f as (
          select source, source_size, least(cap, coalesce((select arg_min(level, nth) filter (level <= cap / weight) from l) * weight, cap)) as target from l
        ), p as (
          select t.*, f.source_size, f.target, sum(size) over (partition by t.source order by place, doc_id)::bigint as reach
          from t join f on t.source is not distinct from f.source
        ), o as (
          select doc_id, source, size, place, r, (reach + r * source_size)::double / target as finish from p, (values (0), (1)) x(r) where size > 0 and target > 0
        ), q as (
          select doc_id, size, sum(size) over (order by finish, source nulls last, r, place, doc_id) - size / 2.0 as middle from o
        ), n as (
          select doc_id, count(*)::int as times from q where middle <= 1.5 * (select sum(source_size) from s) group by doc_id
        )
        select p.doc_id, p.size, p.source_size, p.target, coalesce(n.times, 0) * p.size as taken, p.source, coalesce(n.times, 0)::int as times
        from p left join n on n.doc_id = p.doc_id
    """,
    "op3_exact_dedup": r"""
        with t as (
          select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
        ), g as (
          select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
        from t join g using (norm)
    """,
    "op7_jaccard_join": rf"""
        with recursive w as (
          select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents
        ), s as (
          select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from w
        ), n as (
          select doc_id, count(*) as n from s group by doc_id
        ), pairs as (
          select a.doc_id as a, b.doc_id as b, count(*) as common
          from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
        ), links as (
          select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)
        ), reach(doc_id, other) as (
          select doc_id, doc_id from documents
          union
          select reach.doc_id, links.b from reach join links on links.a = reach.other
        )
        select d.doc_id, coalesce(n.n, 0) as n_shingles, r.component_id
        from documents d left join n on n.doc_id = d.doc_id
        join (select doc_id, min(other) as component_id from reach group by doc_id) r on r.doc_id = d.doc_id
    """,
    "op9_line_dedup": rf"""
        with l as (
          select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
            unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place
          from documents
        ), k as (
          select *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l
        ), r as (
          select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
        ), m as (
          select k.doc_id, k.place, k.line, r.key is not null and k.doc_id <> r.keeper as gone from k left join r on r.key = k.key
        )
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
          sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
        from m group by doc_id
    """,
}
