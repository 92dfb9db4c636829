"""Queries of the operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.llm import chat
from lexframe.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations (a record per turn) and conversation -7 (a record of messages)."""
    rows = read(spark, sf_dir, "conversations").select(
        F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record")
    )
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.to_json(F.struct(
        F.lit(-7).alias("conversation_id"),
        F.array(*[F.struct(F.lit(who).alias("role"), F.lit(said).alias("content")) for who in ("user", "assistant")]).alias("messages"),
    )).alias("record"))
    return chat.digest(chat.format_chat(chat.canonical_turns(rows.unionByName(extra))))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.suffixdup import dedup

    return dedup(read(spark, sf_dir, "documents")).drop("kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from lexframe.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.pii import find, fit

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.linededup import dedup_lines

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines_removed")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.langid import fit, predict

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.vectordup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.decontam import find

    found = find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_items").alias("item_ids"),
                        F.col("_share").alias("share"), (F.size("_items") == 0).alias("kept"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.lexsearch import search

    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.spelling import variants

    return variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexframe.llm.sharding import shard

    placed = shard(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_OP4_SQL = r"""
with lines as (
  select doc_id, text, x.line, x.i, regexp_matches(x.line, '\S') as visible
  from documents, lateral (select unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i) x
), numbered as (
  select *, cast(sum(case when visible then 1 else 0 end) over (partition by doc_id order by i) as bigint) as n from lines
), windows as (
  select doc_id, n, line as a, lead(line) over w as b, lead(line, 2) over w as c from numbered where visible window w as (partition by doc_id order by n)
), later as (
  select doc_id, n, row_number() over (partition by a, b, c order by doc_id, n) as k from windows where c is not null
), covered as (
  select distinct doc_id, n + d as n from later, range(3) r(d) where k > 1
)
select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (not gone), any_value(case when text is null then null else '' end)) as text,
       count(*) filter (gone and visible) as n_lines_removed
from (select l.*, c.n is not null as gone from numbered l left join covered c using (doc_id, n))
group by doc_id
"""

_OP1_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' from range(2) r(i)
), sized as (
  select *, length(regexp_replace(replace(text, '\', '\b'), '<(/?turn)', '\\l\1', 'g')) as body,
         length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '>', ''), chr(10), '')) as head
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(head + body + 16) as bigint) as formatted_chars
from sized group by conv_id
"""


_OP11_SQL = r"""
with words as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), held as (
  select doc_id, r, w, cast(len(w) as hugeint) as n from words where len(w) > 0
), total as (
  select count(*) as docs, sum(n) as terms from held
), wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from benchmark
), freq as (
  select doc_id, r, n, t, count(*) as tf from (select doc_id, r, n, unnest(w) as t from held) where t in (select t from wanted) group by all
), weight as (
  select t, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as hugeint) as w from freq, total group by t, docs
), scored as (
  select item_id, doc_id, r, sum(w * ((cast(1000000000 as hugeint) * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) as score
  from wanted join freq using (t) join weight using (t), total group by item_id, doc_id, r
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from ranked where rank <= 50
"""


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_quality": op2_quality,
        "op3_pii": op3_pii,
        "op4_line_dedup": op4_line_dedup,
        "op5_language_id": op5_language_id,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_packing": op9_packing,
        "op10_simhash": op10_simhash,
        "op11_lexical_search": op11_lexical_search,
        "op12_spelling": op12_spelling,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": _OP1_SQL,
        "op4_line_dedup": _OP4_SQL,
        "op11_lexical_search": _OP11_SQL,
    }
