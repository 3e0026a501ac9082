"""Queries of the tokenizers: how often each token occurs in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, literals, scalars
from .base import TOKENS, query, table


def _counts(spark: SparkSession, sf_dir: str, name: str, column: str, config: str | dict) -> DataFrame:
    return analysis.analyze(table(spark, sf_dir, name), column, config).groupBy("token").agg(F.count("*").alias("n"))


def _sql(tokens: str, name: str = "documents") -> str:
    return f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({tokens}) AS token FROM {name}) GROUP BY token"


@query(_sql(TOKENS))
def tokens_default(spark, sf_dir):
    return _counts(spark, sf_dir, "documents", "text", "default")


@query(_sql("CASE WHEN strlen(text) <= 255 THEN [text] ELSE [] END"))
def tokens_raw(spark, sf_dir):
    return _counts(spark, sf_dir, "documents", "text", "raw")


@query(_sql("CASE WHEN strlen(lower(text)) <= 255 THEN [lower(text)] ELSE [] END"))
def tokens_lowercase(spark, sf_dir):
    return _counts(spark, sf_dir, "documents", "text", "lowercase")


@query(_sql(r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '' AND strlen(x) <= 255)"))
def tokens_whitespace(spark, sf_dir):
    return _counts(spark, sf_dir, "documents", "text", "whitespace")


@query("SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT substr(p_brand, i, n) AS token FROM part, range(1, 40) a(i), range(2, 4) b(n) WHERE i + n - 1 <= length(p_brand)) GROUP BY token")
def tokens_ngram(spark, sf_dir):
    return _counts(spark, sf_dir, "part", "p_brand", {"type": "ngram", "min_gram": 2, "max_gram": 3})


@query("SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT substr(lower(p_brand), 1, n) AS token FROM part, range(1, 6) b(n) WHERE n <= length(p_brand)) GROUP BY token")
def tokens_ngram_prefix(spark, sf_dir):
    return _counts(spark, sf_dir, "part", "p_brand", {"type": "ngram", "min_gram": 1, "max_gram": 5, "prefix_only": True, "filters": ["lower_caser"]})


@query(_sql(r"regexp_extract_all(text, '[0-9]+')"))
def tokens_regex(spark, sf_dir):
    return _counts(spark, sf_dir, "documents", "text", {"type": "regex", "pattern": r"[0-9]+"})


@query(_sql(TOKENS))
def tokens_cjk(spark, sf_dir):
    """Without such characters in a table it equals the default; tests have texts with them."""
    return _counts(spark, sf_dir, "documents", "text", "chinese_compatible")


@query()
def tokens_source_code(spark, sf_dir):
    return _counts(spark, sf_dir, "part", "p_name", "source_code_default")


@query()
def tokens_en_stem(spark, sf_dir):
    """Tokens are counted before they are stemmed, so that Python gets each of them once."""
    token = analysis.stemmed(F.array("token"))[0]
    return _counts(spark, sf_dir, "documents", "text", "default").select(token.alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


@query(_sql("list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND strlen(x) <= 255)", "(SELECT text FROM documents WHERE lang = 'en')"))
def tokens_filters(spark, sf_dir):
    df = table(spark, sf_dir, "documents").where("lang = 'en'")
    return analysis.analyze(df, "text", {"type": "simple", "filters": ["remove_long", "lower_caser"]}).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT event_type, lower(event_type) AS lowered, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def normalizer_lowercase(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", analysis.NORMALIZERS["lowercase"](F.col("event_type")).alias("lowered"), "n")


@query(
    "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS from_text, CAST((epoch_us(ts) // 1000) * 1000 AS BIGINT) AS from_millis, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS hour_us FROM events"
)
def datetime_functions(spark, sf_dir):
    """Dates written as text and as numbers of unknown unit, read back, and truncated."""
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select("event_id", scalars.format_datetime(ts).alias("text"), F.unix_millis(ts).alias("ms"), ts.alias("t"))
    return e.select(
        "event_id", F.unix_micros(scalars.parse_datetime(F.col("text"))).alias("from_text"), F.unix_micros(scalars.timestamp_of_number(F.col("ms"))).alias("from_millis"),
        F.unix_micros(scalars.truncate_datetime(F.col("t"), "hours")).alias("hour_us"),
    )


@query("SELECT event_id, lower(hex(props)) AS hexed, props AS back, '10.0.0.' || (user_id % 256)::VARCHAR AS ip, printf('00000000000000000000ffff0a0000%02x', user_id % 256) AS ip_hex FROM events")
def bytes_and_addresses(spark, sf_dir):
    raw = F.to_binary(F.col("props"), F.lit("utf-8"))
    ip = F.concat(F.lit("10.0.0."), F.pmod("user_id", F.lit(256)).cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", scalars.encode_bytes(raw, "hex").alias("hexed"), scalars.encode_bytes(raw).alias("b64"), ip.alias("ip"))
    return e.select("event_id", "hexed", F.decode(scalars.decode_bytes(F.rtrim(F.col("b64"), F.lit("="))), "utf-8").alias("back"), "ip", scalars.ip_to_hex(F.col("ip")).alias("ip_hex"))


@query("SELECT CAST(5400000 AS BIGINT) AS fixed_ms, CAST(604800000 AS BIGINT) AS human_ms")
def durations(spark, sf_dir):
    row = [(literals.fixed_interval_ms("90m"), literals.human_duration_ms("1 week"))]
    return spark.createDataFrame(row, "fixed_ms long, human_ms long")
