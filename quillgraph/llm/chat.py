"""Chat formatting from event logs, with DataFrame functions only.

Each event belongs to a message of a conversation. ``message`` and ``edit`` set the message's text, ``regenerate``
clears it, ``delta`` appends to it; in the order of ``seq``. So a message's final text is its last setting event's text
and the deltas after it. The log is partitioned by conversation and sorted by ``seq``; each message is folded from its own
events, and the messages of a conversation, which is what is rendered, are joined in the order of their first events.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. ``<|`` inside a role or text becomes ``<||`` and a line
break inside a role ``<|n|>``, so control strings stand only where the template puts them, and the original comes back.

Defined cases: null roles and texts are empty; a null conv_id is a conversation; rows with equal turn are ordered by
role and text and each kept; unknown kinds of events change nothing; a message without setting events starts empty;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log with one ``message`` event for each row of (conv_id, turn, role, text)."""
    rows = turns.select(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.withColumn("seq", number.cast("long")).select("conv_id", "seq", F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text")


def streamed(events: DataFrame) -> DataFrame:
    """The log of ``message`` events as a chat service would have written it: by a hash of the text, a message stands as it is,
    is drafted, regenerated and streamed in two deltas, or is written wrongly, edited and continued by a delta."""
    half = (F.length("text") / 2).cast("int")
    head, tail = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    step = lambda *parts: F.array(*[F.struct(F.lit(k).cast("long").alias("at"), F.lit(kind).alias("kind"), text.alias("said")) for k, (kind, text) in enumerate(parts)])
    way = F.pmod(F.xxhash64("conv_id", "seq", "text"), F.lit(3))
    told = F.when(way == 0, step(("message", F.col("text")))).when(way == 1, step(("message", head), ("delta", F.lit(" draft")), ("regenerate", F.lit("")), ("delta", head), ("delta", tail)))
    told = told.otherwise(step(("message", F.concat(head, F.lit("?"))), ("edit", head), ("delta", tail)))
    rows = events.select("conv_id", "seq", "message", "role", F.explode(told).alias("e"))
    return rows.select("conv_id", (F.col("seq") * 8 + F.col("e.at")).alias("seq"), "message", F.col("e.kind").alias("kind"), F.when(F.col("e.at") == 0, F.col("role")).otherwise("").alias("role"), F.col("e.said").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the final messages of a log (conv_id, seq, message, kind, role, text)."""
    log = events.select("conv_id", "seq", "message", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id", "message")
    sets = F.col("kind").isin("message", "edit", "regenerate")
    log = log.withColumn("since", F.max(F.when(sets, F.col("seq"))).over(own)).withColumn("position", F.min("seq").over(own))
    log = log.withColumn("said", F.when(F.col("kind").isin("message", "edit") & (F.col("seq") == F.col("since")), F.col("text")).when((F.col("kind") == "delta") & (F.col("since").isNull() | (F.col("seq") > F.col("since"))), F.col("text")))
    role = F.max_by("role", F.when(F.col("role") != "", F.col("seq")))
    parts = F.sort_array(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("seq", "said"))))
    out = log.groupBy("conv_id", "message").agg(F.min("position").alias("position"), F.coalesce(role, F.lit("")).alias("role"), parts.alias("parts"))
    return out.select("conv_id", "position", "message", "role", F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans): the text and the code point spans (start, length) that are trained on."""
    turns = messages.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("position", "message")
    turns = turns.withColumn("number", F.row_number().over(order)).withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    turn = F.struct("number", F.concat("head", "body", F.lit(END)).alias("whole"), (F.coalesce("at", F.lit(0)) + F.length("head")).alias("start"), F.length("body").alias("length"), F.col("role").isin(*trained).alias("trained"))
    out = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return out.select("conv_id", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        return F.struct(unescape_role(F.substr(role, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(part, F.length(role) + 2)).alias("text"))

    return F.transform(parts, turn)


def digest(rendered: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from (conv_id, formatted, loss_spans)."""
    turns = parsed(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]))), "")
    return rendered.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
