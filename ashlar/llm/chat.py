"""Chat formatting with typed content parts. DataFrame operations only.

A visitor walks each turn's parts in order: runs of adjacent text parts are joined, then escaped, so that no control string
forms across a border of parts; an image, audio or document part becomes a placeholder that names its place among the
conversation's attachments. The result is a list of segments, each inside or outside the loss mask, whose texts joined
are the formatted conversation; attachments keep reference, kind and the number of tokens that their placeholder expands
to.

Template: <|turn|>role<|says|>text<|done|> for each turn. Where a text or role holds a control string (these, and the
usual bracket and angle ones of other templates), a backslash goes after its first character, behind which any
backslashes already there stay; taking one away again gives the text back. So a "<|" without a backslash is the
template's own, and placeholders can be told from texts that look like one. A kind of other characters than letters,
digits, _ and - stands in a placeholder as hex. and its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.llm.common import table

TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
#: What may follow the first character of a control string, beside backslashes.
_TAIL = r"(?=\||/?s>|/?INST\]|/?SYS>)"
#: Tokens that a placeholder expands to where its part doesn't say.
EXPANDS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])(\\*)" + _TAIL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2")


def as_parts(text: Column) -> Column:
    """A plain text as its only part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def _placeholder(kind: Column, place: Column) -> Column:
    """<|kind:n|> with n attachments of the conversation before it."""
    safe = F.when(kind.rlike(r"\A[A-Za-z0-9_-]+\z"), kind).otherwise(F.concat(F.lit("hex."), F.hex(F.encode(kind, "UTF-8"))))
    return F.concat(F.lit("<|"), safe, F.lit(":"), place.cast("string"), F.lit("|>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body's own lambdas look at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _visit(turn: Column) -> Column:
    """The strings of a turn's parts: each run of texts before, between and after the attachments, and their placeholders."""

    def walk(said: Column) -> Column:
        at = turn["at"]

        def run(j: Column) -> Column:
            start = F.coalesce(F.get(at, j - 1) + 1, F.lit(0))
            text = escaped(F.array_join(F.slice(said, start + 1, F.coalesce(F.get(at, j), F.size(said)) - start), ""))
            return F.when(j < F.size(at), F.concat(text, _placeholder(F.get(turn["parts"], F.get(at, j))["type"], turn["before"] + j))).otherwise(text)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(at)), run), "")

    return let(F.transform(turn["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), walk)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, parts) to a row for each conv_id:
    segments array<struct<text, loss>>, formatted, attachments array<struct<place, type, ref, tokens>>, expanded_tokens.

    Turns stand in order of turn (null first); equal ones in order of role and parts, and repeated rows stay. Null roles,
    texts and part lists are empty; a null conv_id is a conversation of its own. A part without a type is text; one of an
    unknown type gets a placeholder that expands to its own token count, or to one token. What the assistant says
    is inside the loss mask, its placeholders too. An empty table gives an empty result; other columns are not looked at.
    """
    spoken = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    nowhere = F.lit(None).cast("int")
    at = F.filter(F.transform("parts", lambda p, j: F.when(_is_text(p), nowhere).otherwise(j)), lambda j: j.isNotNull())
    others = lambda parts: F.filter(parts, lambda p: ~_is_text(p))
    # How many attachments came before a turn is a running sum, so long conversations take time in proportion.
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "parts").rowsBetween(Window.unboundedPreceding, -1)
    spoken = spoken.withColumn("before", F.coalesce(F.sum(F.size(others(F.col("parts")))).over(before), F.lit(0))).withColumn("at", at)
    gathered = spoken.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts", "before", "at"))).alias("turns"))
    every = F.flatten(F.transform("turns", lambda t: t["parts"]))
    known = F.create_map(*[F.lit(x) for pair in EXPANDS.items() for x in pair])
    attachments = F.transform(others(every), lambda p, i: F.struct(i.cast("long").alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.element_at(known, p["type"]).cast("long"), F.lit(1).cast("long")).alias("tokens")))
    framed = gathered.withColumn("attachments", attachments)

    segment = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    of_turn = lambda t: F.array(
        segment(F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SAYS)), False),
        F.struct(_visit(t).alias("text"), (t["role"] == "assistant").alias("loss")),
        segment(F.lit(DONE), False),
    )
    segments = framed.select("conv_id", F.flatten(F.transform("turns", of_turn)).alias("segments"), "attachments")
    return segments.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, text, parts>> parsed out of it, and loss: what the mask covers, unescaped.

    parts are array<struct<type, text, place>>: texts, as they were but adjacent ones joined and empty ones left out, and
    attachments by kind and place in the conversation's list. text is all of a turn with placeholders as strings, so only
    parts tell a placeholder from a text that looks like one.
    """
    found = F.split("formatted", r"<\|turn\|>")
    pieces = F.slice(found, F.lit(2), F.size(found) - 1)
    mark = r"<\|([A-Za-z0-9_.-]+):([0-9]+)\|>"

    def typed(body: Column) -> Column:
        text = lambda x: F.struct(F.lit("text").alias("type"), unescaped(x).alias("text"), F.lit(None).cast("long").alias("place"))
        plain = lambda kind: F.when(kind.startswith("hex."), F.decode(F.unhex(F.substring(kind, 5, 1 << 30)), "UTF-8")).otherwise(kind)

        def walk(marks: Column) -> Column:
            other = lambda j: F.struct(plain(F.get(marks["kind"], j)).alias("type"), F.lit(None).cast("string").alias("text"), F.get(marks["place"], j).cast("long").alias("place"))
            pairs = F.transform(F.split(body, mark), lambda x, j: F.when(j < F.size(marks["kind"]), F.array(text(x), other(j))).otherwise(F.array(text(x))))
            return F.filter(F.flatten(pairs), lambda p: (p["type"] != "text") | (p["text"] != ""))

        kinds, places = (F.regexp_extract_all(body, F.lit(mark), F.lit(group)) for group in (1, 2))
        return let(F.struct(kinds.alias("kind"), places.alias("place")), walk)

    def parse(piece: Column) -> Column:
        body = lambda text: F.substring(text, F.lit(1), F.length(text) - len(DONE))
        whole = lambda role, body: F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"), typed(body).alias("parts"))
        said = F.split(piece, r"<\|says\|>")
        return let(F.struct(F.element_at(said, 1).alias("role"), body(F.element_at(said, 2)).alias("body")), lambda t: whole(t["role"], t["body"]))

    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return formatted.select("conv_id", "formatted", F.transform(pieces, parse).alias("turns"), masked.alias("loss"))


def op6_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_conversations(turns.select("conv_id", "turn", "role", as_parts(F.col("text")).alias("parts"))))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return back.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
plain AS (
  SELECT *, 24 + length(role) + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|/?SYS>)')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM plain GROUP BY conv_id
"""
QUERIES, ORACLES = {"op6_chat": op6_chat}, {"op6_chat": ORACLE}
