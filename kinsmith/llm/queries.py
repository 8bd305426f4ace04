"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinsmith.llm.bpe import round_trip
from kinsmith.llm.chat import fit_hmm, format_transcripts, raw_transcripts
from kinsmith.llm.common import table
from kinsmith.llm.decontam import contaminated
from kinsmith.llm.importance import importance_sample
from kinsmith.llm.kdtree import top_k
from kinsmith.llm.lm import score_documents
from kinsmith.llm.minhash import near_duplicates
from kinsmith.llm.secrets import scan_secrets
from kinsmith.llm.urls import filter_urls
from kinsmith.llm.warc import archive_round_trip


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op6_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_transcripts(table(spark, sf_dir, "conversations"))
    return format_transcripts(raw, fit_hmm(raw)).withColumnRenamed("seq", "turn")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Every document's set of word shingles, links by counting shared shingles, and reachability.
_OP2 = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+', 0) w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) s from w),
n as (select doc_id, len(s) n from s), e as (select doc_id, unnest(s) x from s),
shared as (select a.doc_id a, b.doc_id b, count(*) k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 75 * (na.n + nb.n - k)),
twoway as (select a, b from links union all select b, a from links),
reach as (select doc_id a, doc_id b from n union select reach.a, twoway.b from reach join twoway on twoway.a = reach.b)
select n.doc_id, n.n n_shingles, c.component_id, n.doc_id = c.component_id kept from n join (select a doc_id, min(b) component_id from reach group by 1) c using (doc_id)"""

#: Base 32 of the SHA-1 from its hexadecimal digits, five bits at a time.
_OP5 = """with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d from pages), o as (select h, max(page_id) owner from p group by 1)
select page_id, strlen(h) payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1) for i in range(32)], '') payload_digest,
case when page_id = owner then 'response' else 'revisit' end record_type, case when page_id <> owner then owner end refers_to from p join o using (h)"""

_OP6 = """with v as (select vec_id, [floor(64 * x::double)::bigint for x in embedding] v from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 20"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force or exact round trips."""
    return {"op2_minhash_near_dedup": _OP2, "op5_warc_archive": _OP5, "op6_kdtree_top_k": _OP6}
