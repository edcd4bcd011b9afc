"""The operators' queries, with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontamination, exact_dedup, line_dedup, sharding, simhash, substring_dedup, token_counts, toxicity
from .common import new_dir, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that the result hangs on nothing left behind."""
    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), tokenizer_path(), new_dir(spark, "token-cache"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(spark, docs, toxicity.learn(spark, docs, table(spark, sf_dir, "labels")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))


#: The tools that a call may name in production, with their arguments' JSON schemas.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "read_file": {"type": "object", "properties": {"path": {"type": ["string", "object"]}}, "required": ["path"], "additionalProperties": False},
    "run_code": {"type": "object", "properties": {"language": {"enum": ["python", "sql", "shell"]}, "code": {}}, "required": ["language", "code"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {}}, "required": ["expression"], "additionalProperties": False},
}


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"), TOOLS)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(decontamination.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def contaminated(found: DataFrame) -> DataFrame:
    """The verdicts: a document is contaminated if a twentieth of its words is hit."""
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def digested(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_token_counts, op2_toxicity, op3_sharding, op4_substring_dedup, op5_line_dedup, op6_chat_format, op7_exact_dedup, op8_decontamination, op9_bpe, op10_simhash, pipeline)
    return {f.__name__: f for f in ops}


OP5_SQL = rf"""
with lines as (
  select row_number() over () as r, page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) as host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '{line_dedup.DROPPED}', chr(10), 'g'), '{line_dedup.COMMENT}', '', 'g'), '{line_dedup.BLOCK}', chr(10), 'g'), '{line_dedup.TAG}', '', 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '') as lines
  from pages),
per as (select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from lines) group by 1, 2),
total as (select host, count(*) as pages from lines group by 1),
boiler as (select host, list(line) as bad from per join total using (host) where n >= {line_dedup.MIN_PAGES} and n > {line_dedup.MAX_RATIO} * pages group by 1),
kept as (select page_id, host, lines, list_filter(lines, lambda x: bad is null or not list_contains(bad, x)) as kept from lines left join boiler using (host))
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped, coalesce(array_to_string(kept, chr(10)), '') as text from kept
"""
OP7_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op7_exact_dedup": OP7_SQL}
