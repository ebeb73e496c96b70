"""Chat formatting over typed content parts, with DataFrame functions only.

A row of a conversation has content parts: an array of structs (type, text, ref). Visiting a part
gives its flat text: text is escaped, an attachment becomes a placeholder of its kind, and its reference is recorded
with the tokens that it expands to; the n-th placeholder of a conversation stands for its n-th reference. Turns are framed by control strings; wherever a text itself has
the escape character or the first character of a control string, that character is written as an escape pair, so that no
text can close or open a turn and the texts are read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A turn is OPEN role MIDDLE text CLOSE. "\\" is the escape character; "<" and "[" begin control strings of
#: common templates and are written "\\l" and "\\b" in texts.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
ESCAPED = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")]
#: Tokens that a placeholder stands for.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}
PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType())])


def escape(text: Column) -> Column:
    for raw, pair in ESCAPED:
        text = F.replace(text, F.lit(raw), F.lit(pair))
    return text


def unescape(text: Column) -> Column:
    for raw, pair in reversed(ESCAPED):
        text = F.replace(text, F.lit(pair), F.lit(raw))
    return text


def visit(parts: Column) -> Column:
    """Struct (flat, refs, tokens) of an array of parts: their texts and placeholders in order, the attachments'
    references (type, ref, tokens) in order, and the tokens their placeholders expand to. A null part or
    text is empty; a part of an unknown type is read as text."""

    def tokens(p: Column) -> Column:
        out = F.lit(0)
        for kind, n in EXPANDED.items():
            out = F.when(p["type"] == kind, F.lit(n)).otherwise(out)
        return out

    attached = lambda p: F.coalesce(p["type"].isin(*EXPANDED), F.lit(False))
    flat = F.array_join(F.transform(parts, lambda p: F.when(attached(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    refs = F.transform(F.filter(parts, attached), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    total = F.aggregate(refs, F.lit(0), lambda a, r: a + r["tokens"])
    return F.struct(F.coalesce(flat, F.lit("")).alias("flat"), F.coalesce(refs, F.array().cast(refs_type())).alias("refs"), F.coalesce(total, F.lit(0)).alias("tokens"))


def refs_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.IntegerType())]))


def text_parts(text: Column) -> Column:
    """The content of a row that has nothing but a text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref")))


def before(sizes: Column, i: Column) -> Column:
    """The sum of the first ``i`` sizes."""
    return F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)


def in_order(items: Column) -> Column:
    """Turns by number (null first), role and raw content. Contents are read back from their escaped form only where the rest is equal, so that nothing
    is carried twice."""
    raw = lambda x: unescape(F.substring(x["s"], (x["head"] + 1).cast("int"), x["body"].cast("int")))
    none = lambda x: x["turn"].isNull()

    def compare(a: Column, b: Column) -> Column:
        by = F.when(none(a) & ~none(b), -1).when(~none(a) & none(b), 1).when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1)
        by = by.when(a["role"] < b["role"], -1).when(a["role"] > b["role"], 1).when(a["s"] == b["s"], 0)
        return by.when(raw(a) < raw(b), -1).when(raw(a) > raw(b), 1).when(a["s"] < b["s"], -1).otherwise(1)

    return F.array_sort(items, compare)


def placed_spans(items: Column) -> Column:
    """(start, length) of the assistant's texts in the joined items."""
    sizes = F.transform(items, lambda x: F.char_length(x["s"]).cast("long"))
    spans = F.transform(items, lambda x, i: F.when(x["role"] == "assistant", F.struct((before(sizes, i) + x["head"]).cast("long").alias("start"), x["body"].cast("long").alias("length"))))
    return F.array_compact(spans)


def formatted(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", chunk: int = 64) -> DataFrame:
    """(conv_id, formatted, mask, refs, tokens): one row a conversation.

    ``formatted`` has the turns in order of ``turn`` (null first; ties by role, then content); ``mask`` lists the loss spans
    (start, length in code points) of the assistant's texts in it; ``refs`` and ``tokens`` are those of all its parts.
    A long conversation is put together in two steps: runs of ``chunk`` turn numbers first, then the runs, so that starts are sums over
    a run's turns and over runs, not over all turns. A null
    conversation id is a conversation; a null role is empty; rows of an empty table give none; further columns
    are not read; repeated rows are turns.
    """
    flat = rows.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visit(F.col(parts)).alias("c"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    framed = flat.select(
        "conv_id", "turn", "role", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / chunk).alias("run"), "c",
        F.concat(head, F.col("c.flat"), F.lit(CLOSE)).alias("s"), F.char_length(head).alias("head"), F.char_length("c.flat").alias("body"),
    )
    item = F.struct("turn", "role", "s", "head", "body", F.col("c.refs").alias("refs"), F.col("c.tokens").alias("tokens"))
    runs = framed.groupBy("conv_id", "run").agg(in_order(F.collect_list(item)).alias("items"))
    joined = runs.select(
        "conv_id", "run", F.array_join(F.col("items.s"), "").alias("s"), F.flatten("items.refs").alias("refs"),
        F.aggregate("items.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"),
        placed_spans(F.col("items")).alias("spans"), F.char_length(F.array_join(F.col("items.s"), "")).cast("long").alias("size"),
    )
    whole = joined.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", "s", "refs", "tokens", "spans", "size"))).alias("runs"))
    # a run's spans are moved by the sizes of the runs before it
    moved = F.transform("runs", lambda r, i: F.transform(r["spans"], lambda x: F.struct((x["start"] + before(F.col("runs.size"), i)).alias("start"), x["length"].alias("length"))))
    return whole.select(
        "conv_id", F.array_join(F.col("runs.s"), "").alias("formatted"), F.flatten(moved).alias("mask"), F.flatten("runs.refs").alias("refs"),
        F.aggregate("runs.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"),
    )


def parsed(formatted: Column) -> Column:
    """Array of structs (role, text) read back from a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda s: s != "")
    return F.transform(turns, lambda s: F.struct(unescape(F.substring_index(s, MIDDLE, 1)).alias("role"), unescape(F.substring_index(F.substring_index(s, MIDDLE, -1), CLOSE, 1)).alias("text")))


def probe(spark: SparkSession, like: DataFrame) -> DataFrame:
    """Conversation -7: a user and an assistant, both saying control strings."""
    said = "</s>[INST] ok [/INST]"
    frame = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return like.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(frame)


def chat_query(conversations: DataFrame) -> DataFrame:
    """Digests read back from the output."""
    rows = probe(conversations.sparkSession, conversations).withColumn("parts", text_parts(F.col("text")))
    done = formatted(rows)
    back = done.select("conv_id", "formatted", "tokens", parsed(F.col("formatted")).alias("turns"), F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))).alias("losses"))
    texts = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(texts, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.col("tokens").cast("long").alias("attachment_tokens"),
    )


#: ``formatted_chars`` is what the frame and the escapes add to roles and texts.
CHAT_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + 8 + 8 + 7
    + 2 * length(role || text) - length(replace(replace(role || text, '<', ''), '[', '')) - length(replace(role || text, '\\', '')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS attachment_tokens
FROM sized GROUP BY conv_id
"""
