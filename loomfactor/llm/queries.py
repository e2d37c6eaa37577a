"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfactor.llm import ann, chat, decontaminate, divergence, fim, html, licenses, mixing, oracle, pii, simhash, substring, suffix_array, toxicity
from loomfactor.llm.common import table


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tk")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labels, mixing.TARGETS, keep=["doc_id"])


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    roles = F.array(F.lit("user"), F.lit("assistant"))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(roles).alias("turn", "role"))
    extra = extra.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", said.alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mixing": op2_mixing,
    "op3_substring": op3_substring,
    "op4_toxicity": op4_toxicity,
    "op5_html": op5_html,
    "op6_ann": op6_ann,
    "op7_simhash": op7_simhash,
    "op8_chat": op8_chat,
    "op9_suffix_array": op9_suffix_array,
    "op10_licenses": op10_licenses,
    "op11_fim": op11_fim,
    "op12_pii": op12_pii,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op11_fim": oracle.FIM,
    "op12_pii": oracle.PII,
    "op13_divergence": oracle.DIVERGENCE,
    "op8_chat": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *,
    length(replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c'))
    + length('### : ') + length(' </turn>') + 1
    + case when role in ('system', 'user', 'assistant', 'tool') then length(role)
        else 1 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c')) end as chars,
    coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text), 'start') as before,
    row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as back
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars,
  bool_and(before || '>' || role in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user',
    'assistant>tool', 'tool>assistant', 'tool>tool')) and max(case when back = 1 then role end) = 'assistant' as valid_order
from sized group by conv_id
""",
}
