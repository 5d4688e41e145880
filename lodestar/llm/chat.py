"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations.  It is partitioned by conversation once; all
that follows sorts and folds inside those partitions, with built-in expressions:

1. Each event belongs to a message, (conv_id, turn), and has a place in the log, seq.
2. The kinds of events:
   - message: the whole text of the message, in place of what it held;
   - delta: a streamed piece, appended to what the message holds;
   - edit: as message, and all messages of later turns written before it go;
   - regenerate: the message is emptied for new deltas (its text, if it has one,
     is the first of them), and all messages of later turns written before it go;
   - delete: the message goes, till a later event writes it anew.
   An event of another kind is kept out of the fold and counted.
3. A message is what its last message, edit or regenerate event begins and later
   deltas append; events before that, or before a cut of an earlier turn, are dead.
4. The messages left are rendered in the order of their turns.

A table without kind holds whole messages, one without seq is sorted by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate", "delete")
#: The begin and the end of a message in the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
DEFAULT_ROLE = "user"


def _neutral(text: Column) -> Column:
    """Text in which nothing reads as a marker: "<|" becomes "< |"."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def format_chats(log: DataFrame) -> DataFrame:
    """(conv_id, n_events, n_dead, n_messages, n_chars, chat) of every conversation of the log.

    log: conv_id, turn, text; role, kind and seq, if it has them.  chat: for each
    message OPEN, role, newline, text, CLOSE, newline; "" if none is left.  n_chars:
    characters of the messages' texts.  n_dead: events without an effect on chat.

    A null text is an empty one.  A null kind is "message", a null seq the turn, a
    null role that of the message's other live events (DEFAULT_ROLE if none has one);
    of several roles the earliest holds.  Rows without conv_id or turn are left out.
    Rows that are the same in all these columns are one event, written twice; other
    events with the same seq stand in the order of turn, kind (as KINDS), role (null
    first) and text.
    A message whose text is empty is rendered; one that was deleted isn't.  An empty
    table gives no rows.  Other columns of log are ignored, whatever their names.
    """
    has = set(log.columns)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    kind = F.coalesce(F.col("kind"), F.lit("message")) if "kind" in has else F.lit("message")
    events = log.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        (F.coalesce(F.col("seq").cast("long"), F.col("turn").cast("long")) if "seq" in has else F.col("turn").cast("long")).alias("seq"),
        F.coalesce(F.try_element_at(rank, kind), F.lit(len(KINDS))).alias("kind"),
        (F.col("role").cast("string") if "role" in has else F.lit(None).cast("string")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    # the log's only shuffle: what follows is grouped by conv_id, alone or with more
    events = events.repartition("conv_id")
    events = events.groupBy("conv_id", "turn", "seq", "kind", "role", "text").agg(F.count("*").alias("copies"))
    conversation = Window.partitionBy("conv_id")
    message = Window.partitionBy("conv_id", "turn")
    events = events.withColumn("at", F.row_number().over(conversation.orderBy("seq", "turn", "kind", F.asc_nulls_first("role"), "text")))
    begins, cuts, deletes = F.col("kind").isin(0, 2, 3), F.col("kind").isin(2, 3), F.col("kind") == 4
    events = events.withColumn("begun", F.max(F.when(begins | deletes, F.col("at"))).over(message))
    earlier = conversation.orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("cut", F.max(F.when(cuts, F.col("at"))).over(earlier))
    live = (F.col("kind") < 4) & (F.col("at") >= F.coalesce(F.col("begun"), F.lit(0))) & (F.col("at") > F.coalesce(F.col("cut"), F.lit(0)))
    events = events.withColumn("live", live)
    parts = F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("at", "role", "text"))))
    messages = events.groupBy("conv_id", "turn").agg(parts.alias("parts"), F.sum("copies").alias("events"), F.sum(F.when(F.col("live"), F.lit(0)).otherwise(F.lit(1)) + F.col("copies") - 1).alias("dead"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    role = F.coalesce(F.element_at(F.concat(F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r.isNotNull()), F.array(F.lit(DEFAULT_ROLE))), 1), F.lit(DEFAULT_ROLE))
    rendered = F.concat(F.lit(OPEN), _neutral(role), F.lit("\n"), _neutral(text), F.lit(f"{CLOSE}\n"))
    alive = F.size("parts") > 0
    messages = messages.select("conv_id", "turn", "events", "dead", F.when(alive, rendered).alias("rendered"), F.when(alive, F.length(text)).alias("chars"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("rendered").isNotNull(), F.struct("turn", "rendered"))))
    return (
        messages.groupBy("conv_id")
        .agg(F.sum("events").alias("n_events"), F.sum("dead").alias("n_dead"), F.count("rendered").alias("n_messages"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("n_chars"), ordered.alias("ordered"))
        .select("conv_id", "n_events", "n_dead", "n_messages", "n_chars", F.array_join(F.transform("ordered", lambda m: m["rendered"]), "").alias("chat"))
    )


def oracle(log: str = "conversations", kind: str = "'message'", seq: str = "turn", role: str = "role") -> str:
    """The same in SQL over the view log; kind, seq and role: expressions over its columns."""
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    return f"""
WITH raw AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(coalesce({seq}, turn) AS BIGINT) AS seq,
         CASE coalesce({kind}, 'message') {ranks} ELSE {len(KINDS)} END AS kind, {role} AS role, coalesce(text, '') AS text
  FROM {log} WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
once AS (SELECT conv_id, turn, seq, kind, role, text, count(*) AS copies FROM raw GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq, turn, kind, role NULLS FIRST, text) AS place FROM once),
marked AS (
  SELECT *, coalesce(max(CASE WHEN kind IN (0, 2, 3, 4) THEN place END) OVER (PARTITION BY conv_id, turn), 0) AS begun,
         coalesce(max(CASE WHEN kind IN (2, 3) THEN place END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut
  FROM placed),
judged AS (SELECT *, kind < 4 AND place >= begun AND place > cut AS live FROM marked),
messages AS (
  SELECT conv_id, turn, sum(copies) AS events, sum(CASE WHEN live THEN copies - 1 ELSE copies END) AS dead,
         string_agg(CASE WHEN live THEN text END, '' ORDER BY place) AS text,
         coalesce(arg_min(role, place) FILTER (WHERE live AND role IS NOT NULL), '{DEFAULT_ROLE}') AS role
  FROM judged GROUP BY conv_id, turn)
SELECT conv_id, CAST(sum(events) AS BIGINT) AS n_events, CAST(sum(dead) AS BIGINT) AS n_dead, count(text) AS n_messages, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars,
       coalesce(string_agg(CASE WHEN text IS NOT NULL THEN '{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{CLOSE}' || chr(10) END, '' ORDER BY turn), '') AS chat
FROM messages GROUP BY conv_id"""
