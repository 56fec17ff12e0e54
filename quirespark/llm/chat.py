"""Chat formatting: conversations rebuilt from an event log, then rendered with a loss mask.

Events are dealt out by conversation once. Within a conversation the events of one message are folded first:
its text is what the last event that sets the text left (the message itself, an edit, a regeneration) and the
deltas streamed after it. Messages then follow each other by their first event. The rendered form is a list of
segments, each under the loss mask or not, whose texts joined are the formatted conversation.

Template, a turn at a time: ``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and texts every backslash is
doubled and every control string, of this template or another (``CONTROLS``), gets a backslash after its first
character; taking each backslash away and keeping what follows it gives the text back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import let, table, text_of

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that tokenizers of chat models take for control tokens.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Kinds of event that set the text of their message anew; any other kind adds to it.
SETS = ("message", "edit", "regenerate")
ASSISTANT = "assistant"

_BREAK = "([<\\[])(?=" + "|".join(re.sub(r"([|\[\]/])", r"\\\1", c[1:]) for c in CONTROLS) + ")"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def messages(events: DataFrame, conversation: str = "conv_id", seq: str = "seq", kind: str = "kind", message: str = "message", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: (conversation, position, role, text).

    ``message`` names the message an event belongs to; an event without one is a message of its own. A text that
    is null adds nothing, or sets the empty text; a null kind is a message. A message's role is that of its last
    event that has one, else empty, and its position is the first ``seq`` of its events. Ties in ``seq`` go by
    kind, role and text, so that reruns agree; rows that repeat are taken as often as they come, and null
    conversations form one conversation.
    """
    e = events.select(
        F.col(conversation).alias("_c"),
        F.col(seq).alias("s"),
        F.coalesce(F.col(kind), F.lit("message")).alias("k"),
        F.col(role).alias("r"),
        text_of(text).alias("t"),
        F.col(message).alias("_m"),
    )
    # An event without a message is a group of one; equal ones share a group and are taken apart below.
    alone = F.when(F.col("_m").isNull(), F.struct("s", "k", "r", "t"))
    folded = (
        e.repartition("_c")
        .groupBy("_c", "_m", alone.alias("_alone"))
        .agg(F.sort_array(F.collect_list(F.struct("s", "k", "r", "t"))).alias("e"))
    )
    sets = F.transform(F.col("e"), lambda x, i: F.when(x["k"].isin(*SETS), i))
    one = F.struct(
        F.col("e")[0]["s"].alias("position"),
        F.coalesce(F.try_element_at(F.filter(F.transform("e", lambda x: x["r"]), lambda r: r.isNotNull()), F.lit(-1)), F.lit("")).alias("role"),
        let(
            F.coalesce(F.array_max(sets), F.lit(0)),
            lambda i: F.array_join(F.transform(F.slice("e", i + 1, F.size("e")), lambda x: x["t"]), ""),
        ).alias("text"),
    )
    lone = F.transform("e", lambda x: F.struct(x["s"].alias("position"), F.coalesce(x["r"], F.lit("")).alias("role"), x["t"].alias("text")))
    parts = folded.select("_c", F.inline(F.when(F.col("_m").isNull(), lone).otherwise(F.array(one))))
    return parts.select(F.col("_c").alias(conversation), "position", "role", "text")


def formatted(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``segments``, (text, loss) whose texts make ``formatted``.

    Only what an assistant says is under the loss mask, without the marks around it. A conversation becomes one
    value, so it has to fit a task; no conversation shares its value with another.
    """
    ordered = turns.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))

    def rendered(t: Column) -> Column:
        head = F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP))
        off = F.lit(False).alias("loss")
        return F.array(
            F.struct(head.alias("text"), off),
            F.struct(escaped(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("loss")),
            F.struct(F.lit(END).alias("text"), off),
        )

    segments = F.flatten(F.transform("turns", rendered))
    whole = F.struct
    out = ordered.select(conversation, let(segments, lambda s: whole(s.alias("segments"), F.array_join(F.transform(s, lambda x: x["text"]), "").alias("formatted"))).alias("o"))
    return out.select(conversation, F.col("o.formatted").alias("formatted"), F.col("o.segments").alias("segments"))


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    turns = F.filter(F.split(text, re.sub(r"([|])", r"\\\1", END)), lambda x: x != "")
    marked = lambda x: F.split(F.substr(x, F.lit(len(START) + 1)), re.sub(r"([|])", r"\\\1", SEP), 2)
    return F.transform(turns, lambda x: let(marked(x), lambda p: F.struct(unescaped(F.get(p, 0)).alias("role"), unescaped(F.get(p, 1)).alias("text"))))


def under_loss(segments: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def as_events(turns: DataFrame) -> DataFrame:
    """The event log of whole turns (conv_id, turn, role, text): drafts that are edited, or, for an assistant, generated
    anew and streamed in two deltas."""
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda k, kind, role, text: F.struct((F.col("turn").cast("long") * 4 + k).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    role, text, none = F.col("role"), F.col("text"), F.lit(None).cast("string")
    said = F.array(
        event(0, "message", role, F.lit("draft")), event(1, "regenerate", none, none), event(2, "delta", none, F.left(text, half)), event(3, "delta", none, F.substring(text, half + 1, F.length(text)))
    )
    typed = F.array(event(0, "message", role, F.concat(F.left(text, half), F.lit("?"))), event(1, "edit", none, text))
    numbered = turns.withColumn("message", F.monotonically_increasing_id())  # equal turns are messages of their own
    return numbered.select("conv_id", "message", F.inline(F.when(role == ASSISTANT, said).otherwise(typed)))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text_of("text").alias("text"))
    planted = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    events = as_events(rows.unionByName(planted))
    out = formatted(messages(events)).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_loss(F.col("segments")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(x: str) -> str:
    # Backslashes double; then each control string gets one after its first character. RE2 has no lookahead, so the
    # whole string is matched; no control string starts inside another.
    pattern = "([<\\[])(" + "|".join(re.sub(r"([|\[\]/])", r"\\\1", c[1:]) for c in CONTROLS) + ")"
    return f"regexp_replace(replace({x}, chr(92), chr(92) || chr(92)), '{pattern}', '\\1' || chr(92) || chr(92) || '\\2', 'g')"


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
             sum(length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len(START + SEP + END)})::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM o"""
