"""Streaming queries over events and conversations; the SQL states the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("select user_id, arg_max(event_type, (ts, event_id)) event_type, count(*) n from events group by 1")
def live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.latest_state(live.stream(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])
    return live.run_available(spark, out, "live-status", "complete")


@query("select user_id, epoch(time_bucket(interval 10 minutes, ts))::bigint starts, count(*) n from events group by all")
def rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: events per user in ten-minute windows."""
    out = live.rates(live.stream(spark, sf_dir, "events"), "user_id", "ts", "10 minutes", "1 day")
    return live.run_available(spark, out, "rate-stream", "complete").withColumn("starts", F.unix_seconds("starts"))


@query("select distinct user_id, event_type from events")
def resume_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.once(live.stream(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "400 days")
    return live.run_available(spark, out, "resume-dedup", "append")


@query("select user_id * 24 + hour(ts) visit, count(*) n from events group by 1 having count(*) filter (event_type = 'purchase') = 0")
def stream_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits (a user within an hour of the day) that ended without a purchase."""
    visits = live.stream(spark, sf_dir, "events").withColumn("visit", F.col("user_id") * 24 + F.hour("ts"))
    out = live.unfinished(visits, "visit", "event_type", "purchase")
    return live.run_available(spark, out, "unfinished", "complete")


@query("""select conv_id, md5(coalesce(string_agg(text, '' order by turn) filter (turn > u), '')) digest, count(*) updates
from (select *, max(turn) filter (role = 'user') over (partition by conv_id) u from conversations) group by conv_id""")
def delta_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the assistant said since the last user turn, which clears what came before."""
    turns = live.stream(spark, sf_dir, "conversations")
    deltas = turns.withColumn("delta", F.when(F.col("role") == "user", F.lit(live.RESTART)).otherwise(F.col("text")))
    out = live.run_updates(spark, live.fold_text(deltas, "conv_id", "turn", "delta"), "delta-fold", "conv_id", "updates")
    return out.select("conv_id", F.md5("text").alias("digest"), "updates")


@query("""with j as (select doc_id, '{"lang":"' || coalesce(lang, '') || '"' a, ',"source":"' || coalesce(source, '') || '"' b, ',"n_chars":' || coalesce(n_chars, 0) || '}' c from documents)
select doc_id, (length(a) - 1) // 7 seq, 'lang' field, substr(a, 9) "value" from j union all select doc_id, (length(a || b) - 1) // 7, 'source', substr(b, 11) from j
union all select doc_id, (length(a || b || c) - 1) // 7, 'n_chars', replace(substr(c, 12), '}', '') from j""")
def partial_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's head as JSON that comes in pieces of seven characters: its fields as they end."""
    docs = live.stream(spark, sf_dir, "documents")
    head = F.concat(
        F.lit('{"lang":"'), F.coalesce("lang", F.lit("")), F.lit('","source":"'), F.coalesce("source", F.lit("")), F.lit('","n_chars":'), F.coalesce("n_chars", F.lit(0)), F.lit("}")
    )
    pieces = docs.select("doc_id", F.posexplode(F.regexp_extract_all(head, F.lit("(?s)(.{1,7})"), F.lit(1))).alias("n", "delta"))
    out = live.fields_as_they_end(pieces, "doc_id", "n", "delta")
    return live.run_available(spark, out, "partial-fields", "append")


@query(r"""with p as (select conv_id, turn page, coalesce(text, '') text from conversations where role = 'user'),
m as (select conv_id, turn - 1 page, regexp_extract(text, '(\p{L}+)', 1) find from conversations where role <> 'user')
select p.conv_id, p.page, md5(p.text) digest, case when contains(p.text, find) then find else '' end marks from p left join m using (conv_id, page)""")
def live_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as pages and the first words of the answers as pieces to be marked on them, as one live state."""
    turns = live.stream(spark, sf_dir, "conversations")
    page = F.col("role") == "user"
    events = turns.select(
        "conv_id", F.when(page, F.col("turn")).otherwise(F.col("turn") - 1).alias("page"), F.col("turn").alias("seq"),
        F.when(page, F.coalesce("text", F.lit(""))).alias("text"), F.when(~page, F.regexp_extract("text", r"(\p{L}+)", 1)).alias("find"),
    )
    out = live.run_updates(spark, live.live_pages(events, "conv_id"), "live-preview", ["conv_id", "page"], "version")
    return out.select("conv_id", "page", F.md5("text").alias("digest"), F.array_join("marks", " ").alias("marks"))
