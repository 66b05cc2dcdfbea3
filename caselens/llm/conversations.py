"""Problem 3: conversations from message rows.

Rows of a session are sorted by time and split at inactivity gaps longer than a gap calibrated on all rows; roles
come from their spellings; conversations without reciprocal replies are dropped. A gap is no boundary inside an
exchange: it splits only where a reply stands before it and a question behind it, so a late reply stays with its
question and the faults of a session are those of its conversations.

A session may hold any share of the rows: rows are ordered within (session, hour) blocks, and only one summary row
per block is ordered within a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caselens.session import Scratch

# Spellings of the speaker roles.
USER_ROLES = ["user", "human", "customer", "client"]
REPLY_ROLES = ["assistant", "ai", "bot", "model", "agent"]
#: Characters without a visible mark: separators, controls, formats and fillers.
INVISIBLE = r"[\p{Z}\p{C}\s͏ᅟᅠㅤﾠ⠀︀-️᠋-᠏]"


def session_key(c: Column) -> Column:
    """A session id in lower case without braces, blanks or prefixes; a value that holds no UUID is only trimmed."""
    low = F.lower(c)
    uuid = F.regexp_extract(low, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", 0)
    return F.when(uuid != "", uuid).otherwise(F.nullif(F.trim(low), F.lit("")))


def speaker(c: Column) -> Column:
    """``user``, ``assistant`` or null for a role without a usable value."""
    r = F.lower(F.regexp_replace(c, INVISIBLE, ""))
    return F.when(r.isin(USER_ROLES), "user").when(r.isin(REPLY_ROLES), "assistant")


def clean_messages(messages: DataFrame) -> DataFrame:
    """One row per message with a visible character: ``(session_id, message_id, role, content, created_at)``.

    Rows delivered again (same message_id) count once, the last one loaded; rows without a session are no messages of
    any conversation. Null content is empty.
    """
    m = messages.select(
        session_key(F.col("session_id")).alias("session_id"),
        "message_id",
        speaker(F.col("role")).alias("role"),
        "content",
        "created_at",
        "loaded_at",
    ).where(F.col("session_id").isNotNull())
    m = m.where(F.length(F.regexp_replace(F.coalesce("content", F.lit("")), INVISIBLE, "")) > 0)
    last = F.max_by(F.struct("session_id", "role", "content", "created_at"), F.struct("loaded_at", "created_at", "session_id"))
    keyed = m.where(F.col("message_id").isNotNull()).groupBy("message_id").agg(last.alias("r")).select("r.*", "message_id")
    return keyed.select("session_id", "message_id", "role", "content", "created_at").unionByName(
        m.where(F.col("message_id").isNull()).select("session_id", "message_id", "role", "content", "created_at")
    )


def ordered(messages: DataFrame) -> DataFrame:
    """Cleaned messages with the role and time of their neighbours and their place in the session.

    Adds ``prev_role, prev_at, next_role, pos`` (from 1). Ties of created_at are ordered by message_id.
    """
    m = messages.withColumn("block", F.date_trunc("hour", "created_at"))
    by = W.partitionBy("session_id", "block").orderBy(F.col("created_at").asc_nulls_first(), F.col("message_id").asc_nulls_first())
    m = m.select(
        "*",
        F.lag(F.struct("role", "created_at")).over(by).alias("p"),
        F.lead(F.struct("role")).over(by).alias("n"),
        F.row_number().over(by).alias("k"),
    )
    at = F.struct("created_at", "message_id")
    blocks = m.groupBy("session_id", "block").agg(
        F.min_by(F.struct("role"), at).alias("first"),
        F.max_by(F.struct("role", "created_at"), at).alias("last"),
        F.count(F.lit(1)).alias("size"),
    )
    over = W.partitionBy("session_id").orderBy(F.col("block").asc_nulls_first())
    blocks = blocks.select(
        "session_id",
        F.col("block").alias("b"),
        F.lag("last").over(over).alias("bp"),
        F.lead("first").over(over).alias("bn"),
        (F.sum("size").over(over) - F.col("size")).alias("before"),
    )
    m = m.join(blocks.withColumnRenamed("session_id", "s"), (F.col("session_id") == F.col("s")) & F.col("block").eqNullSafe(F.col("b")))
    prev = F.coalesce("p", "bp")
    return m.select(
        "session_id",
        "message_id",
        "role",
        "content",
        "created_at",
        (F.col("before") + F.col("k")).alias("pos"),
        prev.isNull().alias("is_first"),
        prev["role"].alias("prev_role"),
        prev["created_at"].alias("prev_at"),
        F.coalesce("n", "bn").isNull().alias("is_last"),
        F.coalesce("n", "bn")["role"].alias("next_role"),
    )


def calibrated_gap(rows: DataFrame) -> DataFrame:
    """One row ``(gap_s)``: the inactivity that separates conversations, from all gaps between neighbouring messages.

    Gaps are counted in half-octave classes; the gap is the lower edge of the class that best separates short from
    long gaps (largest variance between the two sides of the logarithm). Null without gaps.
    """
    secs = F.unix_timestamp("created_at") - F.unix_timestamp("prev_at")
    h = rows.select(F.floor(2 * F.log2(F.greatest(secs, F.lit(1)))).alias("c")).where("c is not null")
    h = h.groupBy("c").agg(F.count(F.lit(1)).alias("n"))  # at most some 70 classes
    up = W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)
    all_ = W.orderBy("c").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    h = h.select(
        "c",
        F.sum("n").over(up).alias("n0"),
        F.sum(F.col("n") * F.col("c")).over(up).alias("s0"),
        F.sum("n").over(all_).alias("nt"),
        F.sum(F.col("n") * F.col("c")).over(all_).alias("st"),
    )
    n1, m0 = F.col("nt") - F.col("n0"), F.col("s0") / F.col("n0")
    between = F.col("n0") * n1 * F.pow(m0 - (F.col("st") - F.col("s0")) / n1, 2)
    return h.where("n0 > 0").select(F.max_by(F.pow(2.0, F.col("c") / 2), F.struct(between, -F.col("c"))).alias("gap_s"))


def conversations(messages: DataFrame, gap_s: float | None = None) -> DataFrame:
    """Messages of the conversations kept: ``(session_id, conversation_no, turn_no, role, message_id, content)``.

    ``gap_s`` is the inactivity in seconds that splits a session; by default it is calibrated. Sessions with a fault
    (see ``session_faults``) are left out.
    """
    rows = Scratch(messages.sparkSession, "conversations").save(ordered(clean_messages(messages)), "rows")  # read three times
    kept = rows.join(_faults(rows).where("fault is not null"), "session_id", "left_anti")
    gap = F.lit(float(gap_s)) if gap_s else F.coalesce("gap_s", F.lit(float("inf")))
    if not gap_s:
        kept = kept.crossJoin(F.broadcast(calibrated_gap(rows)))  # one row
    starts = F.col("is_first") | (
        (F.unix_timestamp("created_at") - F.unix_timestamp("prev_at") > gap) & (F.col("role") == "user") & (F.col("prev_role") == "assistant")
    )
    kept = kept.withColumn("starts", starts)
    # the first messages of conversations are few; they number the others through their places
    firsts = kept.where("starts").groupBy("session_id", F.date_trunc("hour", "created_at").alias("block")).agg(
        F.array_sort(F.collect_list("pos")).alias("at")
    )
    over = W.partitionBy("session_id").orderBy("block")
    firsts = firsts.select(
        "session_id",
        F.coalesce("block", F.timestamp_seconds(F.lit(0))).alias("block"),
        "at",
        (F.sum(F.size("at")).over(over) - F.size("at")).alias("earlier"),
        F.lag(F.try_element_at("at", F.lit(-1))).over(over).alias("last_before"),
    )
    # blocks without a first message take the last block that has one
    blocks = kept.select("session_id", F.coalesce(F.date_trunc("hour", "created_at"), F.timestamp_seconds(F.lit(0))).alias("block")).distinct()
    known = blocks.join(firsts, ["session_id", "block"], "left")
    known = known.select(
        "session_id",
        "block",
        F.coalesce("at", F.array().cast("array<bigint>")).alias("at"),
        F.coalesce("earlier", F.last(F.col("earlier") + F.size("at"), ignorenulls=True).over(over)).alias("earlier"),
        F.coalesce("last_before", F.last(F.try_element_at("at", F.lit(-1)), ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1))).alias("last_before"),
    )
    kept = kept.withColumn("block", F.coalesce(F.date_trunc("hour", "created_at"), F.timestamp_seconds(F.lit(0))))
    out = kept.join(known, ["session_id", "block"])
    seen = F.filter("at", lambda p: p <= F.col("pos"))
    start = F.when(F.size(seen) > 0, F.try_element_at(seen, F.lit(-1))).otherwise(F.col("last_before"))
    return out.select(
        "session_id",
        (F.col("earlier") + F.size(seen)).cast("int").alias("conversation_no"),
        (F.col("pos") - start + 1).cast("int").alias("turn_no"),
        "role",
        "message_id",
        "content",
    )


def _faults(rows: DataFrame) -> DataFrame:
    broken = F.col("role").isNull() | (F.col("is_first") & (F.col("role") == "assistant"))
    missing = (F.col("role") == "user") & (F.col("is_last") | (F.col("next_role") == "user"))
    return rows.groupBy("session_id").agg(
        F.when(F.max(F.coalesce(broken, F.lit(False))), "broken").when(F.max(F.coalesce(missing, F.lit(False))), "missing_reply").alias("fault")
    )


def session_faults(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(session_id, fault)`` for the sessions of ``messages`` or ``sessions`` that are to be dropped.

    ``empty``: no message; ``broken``: a message without usable role, or a reply first; ``missing_reply``: a question
    followed by a question or by nothing. The first fault that holds is given; sessions in order give no row.
    """
    key = session_key(F.col("session_id")).alias("session_id")
    every = messages.select(key).unionByName(sessions.select(key)).where("session_id is not null").distinct()
    faults = _faults(ordered(clean_messages(messages))).select("session_id", F.coalesce("fault", F.lit("")).alias("fault"))
    return every.join(faults, "session_id", "left").select("session_id", F.coalesce("fault", F.lit("empty")).alias("fault")).where("fault <> ''")
