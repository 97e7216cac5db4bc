"""Sessions, messages, documents and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import sessions as S
from ..operators.positions import positions
from .base import register, sql_in, sql_strip, table
from .fixtures import CATEGORY, FILE_NAME, LOGS, STATUS, TURNS, documents, logs, turns

DOCS_SQL = f"""select doc_id as document_id, doc_id % 97 as session_id, doc_id % 31 as user_id, {FILE_NAME} as file_name, {STATUS} as status,
    {CATEGORY} as category, timestamp '2024-01-01 00:00:00' + to_minutes(doc_id) as created_at from documents"""
TURN_AT = "timestamp '2024-01-01 00:00:00' + to_minutes(turn)"


def users(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"),
                                               F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))


def chats(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"),
                                             F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("updated_at"))


def timed_turns(spark, sf):
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(turn as int))")
    return turns(spark, sf).withColumn("question_at", at)


@register("scan_users", "user_id long, user_name str, balance dbl",
          "select c_custkey as user_id, c_name as user_name, c_acctbal as balance from customer")
def scan_users(spark, sf):
    return users(spark, sf)


@register("scan_sessions", "session_id long, user_id long, title str, updated_at ts",
          "select o_orderkey as session_id, o_custkey as user_id, o_orderpriority as title, o_orderdate as updated_at from orders")
def scan_sessions(spark, sf):
    return chats(spark, sf)


@register("scan_messages", "session_id long, turn long, message_id long, question str, answer str", TURNS)
def scan_messages(spark, sf):
    return turns(spark, sf)


@register("scan_documents", "document_id long, session_id long, user_id long, file_name str, status str, category str, created_at ts", DOCS_SQL)
def scan_documents(spark, sf):
    return documents(spark, sf)


@register("scan_logs", "log_id long, user_id long, level str, endpoint str, created_at ts", LOGS)
def scan_logs(spark, sf):
    return logs(spark, sf)


def placed(df, *order):
    """A listing: every row with its place (from 1) in the order, instead of a sort that a reader of the table cannot see."""
    return positions(df, list(order)).withColumn("position", F.col("position") + 1)


def sql_placed(sql: str, order: str, by: str = "") -> str:
    return f"select *, row_number() over ({by} order by {order}) as position from ({sql}) as listed"


@register("list_users", "position long, user_id long, user_name str, balance dbl", sql_placed(
    "select c_custkey as user_id, c_name as user_name, c_acctbal as balance from customer", "balance desc, user_id"))
def list_users(spark, sf):
    return placed(users(spark, sf), F.desc("balance"), F.asc("user_id"))


@register("list_documents", "position long, document_id long, status str, created_at ts", sql_placed(
    f"select document_id, status, created_at from ({DOCS_SQL}) as d", "created_at, document_id"))
def list_documents(spark, sf):
    return placed(documents(spark, sf).select("document_id", "status", "created_at"), F.asc("created_at"), F.asc("document_id"))


@register("sessions_users", "position long, session_id long, user_id long, user_name str, title str, updated_at ts", sql_placed("""
    select o_orderkey as session_id, o_custkey as user_id, c_name as user_name, o_orderpriority as title, o_orderdate as updated_at
    from orders join customer on c_custkey = o_custkey""", "updated_at desc, session_id"))
def sessions_users(spark, sf):
    return placed(chats(spark, sf).join(users(spark, sf), "user_id"), F.desc("updated_at"), F.asc("session_id"))


@register("messages_users", "position long, message_id long, user_id long, user_name str, question_at ts", sql_placed(
    "select event_id as message_id, user_id, c_name as user_name, ts as question_at from events join customer on c_custkey = user_id",
    "question_at, message_id"))
def messages_users(spark, sf):
    asked = logs(spark, sf).select(F.col("log_id").alias("message_id"), "user_id", F.col("created_at").alias("question_at"))
    return placed(asked.join(users(spark, sf), "user_id"), F.asc("question_at"), F.asc("message_id"))


@register("owned_docs", "document_id long, session_id long, owner long, status str", f"""
    select document_id, d.session_id, o_custkey as owner, status from ({DOCS_SQL}) as d join orders on o_orderkey = d.session_id
    where d.status <> 'DELETED'""")
def owned_docs(spark, sf):
    owners = chats(spark, sf).select("session_id", F.col("user_id").alias("owner"))
    return documents(spark, sf).filter("status <> 'DELETED'").join(owners, "session_id")


@register("docs_by_user", "position long, user_id long, session_id long, document_id long, created_at ts", sql_placed(f"""
    select user_id, session_id, document_id, created_at from ({DOCS_SQL}) as d where exists (
      select 1 from orders where o_orderkey = d.session_id and o_custkey % 31 = d.user_id)""", "user_id, created_at, document_id"))
def docs_by_user(spark, sf):
    mine = chats(spark, sf).select("session_id", (F.col("user_id") % 31).alias("user_id")).distinct()
    found = documents(spark, sf).join(mine, ["session_id", "user_id"], "left_semi")
    return placed(found, F.asc("user_id"), F.asc("created_at"), F.asc("document_id"))


@register("context_mode", "session_id long, context_mode str", f"""
    select o_orderkey as session_id, case when exists (select 1 from ({DOCS_SQL}) as d where d.session_id = o_orderkey
      and {sql_in('status', S.READY_STATES)}) then 'hybrid' else 'general' end as context_mode from orders""")
def context_mode(spark, sf):
    return S.context_mode(chats(spark, sf).select("session_id"), documents(spark, sf))


@register("session_counts", "session_id long, document_count long, message_count long", f"""
    select coalesce(d.session_id, m.session_id) as session_id, coalesce(dc, 0) as document_count, coalesce(mc, 0) as message_count
    from (select session_id, count(*) as dc from ({DOCS_SQL}) as a group by session_id) as d full outer join
      (select l_orderkey as session_id, count(*) as mc from lineitem group by l_orderkey) as m on m.session_id = d.session_id""")
def session_counts(spark, sf):
    messages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    return S.session_counts(documents(spark, sf), messages)


@register("orphan_sessions", "session_id long, user_id long", f"""
    select o_orderkey as session_id, o_custkey as user_id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
      and not exists (select 1 from ({DOCS_SQL}) as d where d.session_id = o_orderkey)""")
def orphan_sessions(spark, sf):
    messages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    return S.orphan_sessions(chats(spark, sf), documents(spark, sf), messages)


@register("cascade_delete", "child str, remaining long", """
    select 'sessions' as child, count(*) as remaining from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)
    union all select 'messages', count(*) from lineitem where l_orderkey not in (
      select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0))
    union all select 'logs', count(*) from events where user_id not in (select c_custkey from customer where c_acctbal < 0)""")
def cascade_delete(spark, sf):
    gone = users(spark, sf).filter("balance < 0").select("user_id")
    kept = S.cascade_delete(gone, {
        "sessions": (chats(spark, sf), "", "user_id", "session_id"),
        "messages": (table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id")), "sessions", "session_id", ""),
        "logs": (logs(spark, sf), "", "user_id", ""),
    })
    counts = [df.agg(F.count("*").alias("remaining")).select(F.lit(n).alias("child"), "remaining") for n, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("timeline", "session_id long, position long, type str, created_at ts, item_id long, label str", sql_placed(f"""
    select session_id, 'message' as type, {TURN_AT} as created_at, message_id as item_id, question as label from ({TURNS}) as t
    union all select session_id, 'document', created_at, document_id, file_name from ({DOCS_SQL}) as d""",
    "created_at, type desc, item_id", "partition by session_id"))
def timeline(spark, sf):
    rows = S.timeline(timed_turns(spark, sf), documents(spark, sf))
    return rows.select(
        "session_id", "position", "type", "created_at", F.coalesce("message.message_id", "document.document_id").alias("item_id"),
        F.coalesce("message.question", "document.file_name").alias("label"))


@register("log_info", "position long, log_id long, level str, endpoint str, created_at ts", sql_placed(
    f"select * from ({LOGS}) as l where level = 'INFO'", "created_at desc, log_id"))
def log_info(spark, sf):
    return placed(S.info_logs(logs(spark, sf)), F.desc("created_at"), F.asc("log_id"))


@register("log_errors", "position long, log_id long, level str, endpoint str, created_at ts", sql_placed(
    f"select * from ({LOGS}) as l where level in ('WARN', 'ERROR') and endpoint ilike '%document%'", "created_at desc, log_id"))
def log_errors(spark, sf):
    return placed(S.document_errors(logs(spark, sf)), F.desc("created_at"), F.asc("log_id"))


@register("log_window", "start ts, level str, n long", f"""
    select date_trunc('hour', created_at) as start, level, count(*) as n from ({LOGS}) as l
    where level in ('WARN', 'ERROR') and endpoint ilike '%document%' group by 1, 2""")
def log_window(spark, sf):
    rows = S.document_errors(logs(spark, sf)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return rows.groupBy(F.window("created_at", "1 hour"), "level").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "level", "n")


@register("recent_turns", "session_id long, message_id long, recency long, question str, answer str", f"""
    select * from (select *, row_number() over (partition by session_id order by turn desc) as recency from ({TURNS}) as t) as r
    where recency <= {K.HISTORY_TURNS}""")
def recent_turns(spark, sf):
    return S.recent_turns(turns(spark, sf), at="turn")


@register("query_expand", "session_id long, message_id long, search_text str", f"""
    select session_id, message_id, case when coalesce(p, '') = '' then question else concat(p, ' ', question) end as search_text
    from (select *, lag(question) over (partition by session_id order by turn) as p from ({TURNS}) as t) as l""")
def query_expand(spark, sf):
    return S.expand_questions(turns(spark, sf), F.floor(F.col("turn") / 1024), at="turn")


@register("session_rollup", "session_id long, title str, last_turn long, turns long", f"""
    select session_id, substr({sql_strip('arg_min(question, turn)')}, 1, 20) as title, max(turn) as last_turn, count(*) as turns
    from ({TURNS}) as t group by session_id""")
def session_rollup(spark, sf):
    return S.session_rollup(turns(spark, sf), at="turn").withColumnRenamed("last_message_at", "last_turn")
