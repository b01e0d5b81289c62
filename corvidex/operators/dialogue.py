"""Dialogue analytics over stored messages (session_id, seq, role, content, tool_calls_json)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CALLS = "array<struct<id:string,name:string,arguments:string>>"


def with_tool_calls(messages: DataFrame) -> DataFrame:
    """Adds ``tool_calls``; unreadable JSON counts as no calls."""
    return messages.withColumn("tool_calls", F.from_json("tool_calls_json", CALLS, {"mode": "PERMISSIVE"}))


def visible(messages: DataFrame) -> DataFrame:
    return messages.where("role IN ('user', 'assistant') AND tool_calls_json IS NULL")


def page(messages: DataFrame, offset: int, limit: int) -> DataFrame:
    """Of each session, ``limit`` visible messages by seq after the first ``offset``."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    return visible(messages).withColumn("n", n).where(F.col("n").between(offset + 1, offset + limit)).drop("n")


def user_turns(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("turns"))


def last_assistant(messages: DataFrame) -> DataFrame:
    """(session_id, seq, content) of each session's last visible assistant message."""
    own = visible(messages).where("role = 'assistant'")
    best = own.groupBy("session_id").agg(F.max_by(F.struct("seq", "content"), "seq").alias("x"))
    return best.select("session_id", "x.seq", "x.content")


def turn_window(messages: DataFrame, turns: int) -> DataFrame:
    """From the ``turns``-th last user message on; all of a session with fewer; nothing for 0 turns."""
    if turns <= 0:
        return messages.limit(0)
    back = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = messages.withColumn("users_from_here", F.sum((F.col("role") == "user").cast("int")).over(back))
    start = F.max(F.when((F.col("role") == "user") & (F.col("users_from_here") == turns), F.col("seq"))).over(Window.partitionBy("session_id"))
    return seen.withColumn("start", start).where("start IS NULL OR seq >= start").drop("users_from_here", "start")


def context(messages: DataFrame, sessions: DataFrame, system: str, turns: int) -> DataFrame:
    """(session_id, ord, role, content): a system message, a summary if the session has one, then the turn window."""
    head = sessions.select("session_id", F.lit(-2).cast("long").alias("ord"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    summary = sessions.where("summary IS NOT NULL AND summary <> ''").select("session_id", F.lit(-1).cast("long").alias("ord"), F.lit("system").alias("role"), F.col("summary").alias("content"))
    window = turn_window(messages, turns).select("session_id", F.col("seq").cast("long").alias("ord"), "role", "content")
    return head.unionByName(summary).unionByName(window)


def compression_slices(messages: DataFrame, turns: int, every: int) -> DataFrame:
    """(session_id, slice, idx, seq, role, content): what each turn window of a session left behind when it was due, in slices from 0.

    It is due at every ``every``-th user turn, if there are ``turns`` by then; a
    slice begins where the last window began and ends before the window.
    """
    by = Window.partitionBy("session_id")
    so_far = by.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    user = F.col("role") == "user"
    m = messages.select("session_id", F.col("seq").cast("long").alias("seq"), "role", "content")
    m = m.withColumns({"idx": F.row_number().over(by.orderBy("seq")).cast("long") - 1, "nth": F.count_if(user).over(so_far), "users": F.count_if(user).over(by)})
    # The user turn that a due window begins with, ``turns`` - 1 turns before the one that makes it due.
    begins = user & ((F.col("nth") + turns - 1) % every == 0) & (F.col("nth") + turns - 1 <= F.col("users"))
    m = m.withColumns({"slice": F.count_if(begins).over(so_far), "slices": F.count_if(begins).over(by)})
    return m.where("slice < slices").select("session_id", "slice", "idx", "seq", "role", "content")


def to_compress(messages: DataFrame, cursors: DataFrame, turns: int, every: int) -> DataFrame:
    """Messages between a session's cursor (rows already summarised) and its turn window, where its user turns are a multiple of ``every``."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1
    due = user_turns(messages).where((F.col("turns") > 0) & (F.col("turns") % every == 0)).select("session_id")
    start = turn_window(messages, turns).groupBy("session_id").agg(F.min("seq").alias("from_seq"))
    rows = messages.withColumn("idx", n).join(due, "session_id", "left_semi").join(start, "session_id", "left").join(cursors, "session_id", "left")
    return rows.where("idx >= coalesce(cursor, 0) AND (from_seq IS NULL OR seq < from_seq)").drop("from_seq", "cursor")


def serialize(messages: DataFrame) -> DataFrame:
    """(session_id, history): one text of each session's messages in order."""
    m = with_tool_calls(messages)
    names = F.array_join(F.transform("tool_calls", lambda c: c["name"]), ", ")
    content = F.coalesce("content", F.lit(""))
    tool = F.concat(F.lit("[tool result]: "), content)
    calls = F.concat(F.lit("[assistant]: "), content, F.lit("\n[tool calls]: "), names)
    line = F.when(F.col("role") == "tool", tool).when(F.size("tool_calls") > 0, calls).otherwise(F.concat(F.lit("["), F.col("role"), F.lit("]: "), content))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return m.groupBy("session_id").agg(F.array_join(ordered, "\n").alias("history"))


def list_sessions(sessions: DataFrame, statuses: tuple[str, ...] = ("active", "pinned")) -> DataFrame:
    """Sessions of the statuses, the last changed first; pinned ones are shown as active."""
    shown = F.when(F.col("status") == "pinned", "active").otherwise(F.col("status"))
    return sessions.where(F.col("status").isin(list(statuses))).withColumn("status", shown).orderBy(F.desc("updated_at"), "session_id")


def call_budget(calls: DataFrame, most: int) -> DataFrame:
    """(session_id, seq, call_no, allowed): tool calls of a message beyond ``most`` are refused."""
    each = with_tool_calls(calls).select("session_id", "seq", F.posexplode("tool_calls").alias("call_no", "call"))
    return each.select("session_id", "seq", "call_no", F.col("call.name").alias("name"), (F.col("call_no") < most).alias("allowed"))


def profile_complete(profiles: DataFrame) -> DataFrame:
    """Adds is_complete: name, sex and date of birth not blank, age over 0."""
    said = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("name", "sex", "date_of_birth")]
    return profiles.withColumn("is_complete", said[0] & said[1] & said[2] & (F.coalesce("age", F.lit(0)) > 0))
