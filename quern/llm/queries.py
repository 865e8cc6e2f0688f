"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.inner_product import search
from quern.llm.merkle import edit_fingerprints
from quern.llm.mixing import mix
from quern.llm.packing import pack
from quern.llm.pii import pii_report
from quern.llm.simhash import near_duplicates
from quern.llm.suffix_dedup import remove_repeats
from quern.llm.token_counts import token_counts
from quern.llm.toxicity import judge_toxicity, train
from quern.llm.url_filter import Rule, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op4_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=512)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), max_tokens=1024).drop("ids")


URL_RULES = (
    Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)


# What SQL can state of three operators' results, from the same operators.


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_merkle_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", (F.col("fingerprint") == F.col("edited_fingerprint")).alias("unchanged"), F.col("first_edit").isNull().alias("no_edit"))


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")} | {f.__name__: f for f in (edited_texts, mix_sizes, url_rules)}


def _fits(rule: Rule) -> str:
    return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a result; the operators as wholes are held against brute force in the tests."""
    longest = sorted(URL_RULES, key=lambda r: -len(r.text))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {
        "edited_texts": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
  e AS (SELECT doc_id, n, t, left(t, n - n // 2) || left(coalesce(lead(t) OVER w, first_value(t) OVER w), n // 2) AS e FROM t WINDOW w AS (ORDER BY doc_id))
  SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, e = t AS unchanged, e = t AS no_edit FROM e""",
        "mix_sizes": r"""WITH s AS (SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)
  SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::BIGINT AS source_size FROM s""",
        "url_rules": f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
  h AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM u),
  p AS (SELECT page_id, translate(raw, '{upper}', '{lower}') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h)
  SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in longest)} END AS rule, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in longest)} END AS verdict FROM p""",
    }
