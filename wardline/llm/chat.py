"""Chat formatting of typed content parts, with a loss mask, attachment references and a read-back.

A message holds ordered parts of type text, image, audio or document. A visitor turns each part into one piece of the
message's body: text is escaped, every other part becomes a numbered placeholder with a reference to its attachment and the
number of tokens it expands to. Turns are wrapped in control strings; control strings inside texts are broken up by a
backslash, reversibly.

Scale: messages are formatted row by row with built-in functions, no shuffle. Only the digest of a whole conversation needs
its rows in order: they are dealt by conversation, sorted there and streamed through running digests, so that even a
conversation with a third of all rows takes constant memory (a SHA-256 is sequential by definition).

Nulls and edges: null text is empty, null role is the empty role, a null or unknown part type counts as text, null parts are
skipped; rows order by turn (nulls last), then role and text, repeated rows stay; rows without conv_id form one conversation
whose id is null; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm.shared import partitions, table

TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings of this and of common templates; the backslash goes behind the first character.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
#: Token costs of attachments: a tile of an image, a second of sound, a page of a document.
TILE_SIDE, TILE_TOKENS, IMAGE_BASE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 400
PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: Column) -> Column:
    """As text; line feeds too, since one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes: image tiles, seconds of sound, pages; 0 for text."""
    side = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(0)), F.lit(1)) / TILE_SIDE)
    return (
        F.when(part["type"] == "image", IMAGE_BASE_TOKENS + TILE_TOKENS * side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * SECOND_TOKENS))
        .when(part["type"] == "document", PAGE_TOKENS * F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)))
        .otherwise(0).cast("long")
    )


def visit(parts: Column) -> Column:
    """Parts to (body, attachment) pieces in order; the number of an attachment is its place among the message's parts."""
    media = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))

    def piece(p: Column, i: Column) -> Column:
        tokens = expanded_tokens(p)
        ref = F.struct(i.alias("index"), p["type"].alias("type"), p["uri"].alias("uri"), tokens.alias("tokens"))
        body = F.when(media(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), i.cast("string"), F.lit("|>"))).otherwise(escape(p["text"]))
        return F.struct(body.alias("body"), F.when(media(p), ref).alias("ref"))

    return F.transform(F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull()), piece)


def format_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to (conv_id, turn, role, formatted, loss_start, loss_end, attachments, expanded_tokens).

    loss_start and loss_end are code points of `formatted`: the body of an assistant's message; equal for others.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    m = messages.select("conv_id", "turn", "role", F.concat(F.lit(TURN), escape_role(role), F.lit("\n")).alias("head"), visit(F.col("parts")).alias("pieces"))
    m = m.withColumn("body", F.concat_ws("", F.transform("pieces", lambda p: p["body"])))
    refs = F.filter(F.transform("pieces", lambda p: p["ref"]), lambda r: r.isNotNull())
    start = F.length("head").cast("long")
    return m.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(END)).alias("formatted"), start.alias("loss_start"),
        F.when(F.col("role") == "assistant", start + F.length("body")).otherwise(start).alias("loss_end"), refs.alias("attachments"),
        F.aggregate(refs, F.lit(0).cast("long"), lambda a, r: a + r["tokens"]).alias("expanded_tokens"),
    )


def text_parts(rows: DataFrame) -> DataFrame:
    """Rows with plain text as messages of one text part."""
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).cast("array<struct<type:string,text:string>>")
    wide = F.transform(part, lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("width"),
                                                F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))
    return rows.select("conv_id", "turn", "role", wide.alias("parts"))


def parse(formatted: str) -> tuple[str, str]:
    """Role and escaped body of one formatted message."""
    head = re.match(r"(?:\\.|[^\\\n])*", formatted[len(TURN):], re.S).group()
    start = len(TURN) + len(head) + 1
    return unescape(head), formatted[start : len(formatted) - len(END)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests over rows that come sorted by conversation; one row a conversation."""
    out: list[tuple] = []
    now, state = None, None

    def close() -> None:
        if state:
            out.append((now[0], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 6
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        ids, texts, starts, ends = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
        for conv, text, a, b in zip(ids, texts, starts, ends, strict=True):
            if now != (conv,):
                close()
                now, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            role, body = parse(text)
            learnt = unescape(text[a:b])
            state["n"] += 1
            state["turns"].update(f"{role}\n{unescape(body)}\n".encode())
            state["loss"].update(learnt.encode())
            state["loss_chars"] += len(learnt)
            state["chars"] += len(text)
        if len(out) > 5000:
            yield flush()
    close()
    yield flush()


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted messages alone: turns, their digest and what lies under the loss mask."""
    n = partitions(formatted.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "formatted"]
    rows = formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end").repartition(n, "conv_id").sortWithinPartitions(*order)
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op10_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return read_back(format_messages(text_parts(rows.unionByName(own))))


OP10_SQL = r"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        replace(replace(replace(replace(replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS body FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + length(role) + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
