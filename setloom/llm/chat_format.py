"""Chat formatting with DataFrame expressions only.

The template::

    <|turn|>ROLE<|says|>TEXT<|more|>TEXT<|done|> ...

One ``<|turn|>`` block stands for a run of adjacent turns of one role; ``<|more|>`` parts the turns merged in
it, so nothing is lost by merging. Inside texts and roles every control string (of this template and of the
other common ones below) gets a backslash after its first character, or one more backslash if it has some
already; reading back takes one away. Escaped text therefore never holds a control string, and any text
comes back exactly.

Rows are ordered by turn, then role, then text (nulls first), so ties and repeated rows have one defined
order and all stay. Null texts and roles count as empty, a null conversation id is a conversation of its
own, and an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.common import table

#: Control strings of this template, without their first character.
TEMPLATE = ("|turn|>", "|says|>", "|more|>", "|done|>")
#: Control strings of other templates that texts must not smuggle in: first character, rest. Fixed values.
FOREIGN = (("<", "/s>"), ("<", "s>"), ("[", "INST]"), ("[", "/INST]"), ("<", "<SYS>>"), ("<", "</SYS>>"), ("<", "|im_start|>"), ("<", "|im_end|>"), ("<", "|endoftext|>"))


def _quoted(x: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in x)


_ANGLE = "|".join(map(_quoted, (*TEMPLATE, *(b for a, b in FOREIGN if a == "<"))))
_SQUARE = "|".join(map(_quoted, (b for a, b in FOREIGN if a == "[")))
#: The place after the first character of a control string, with the backslashes there.
_OPEN = rf"(?<=<)(\\*)(?={_ANGLE})|(?<=\[)(\\*)(?={_SQUARE})"
_CLOSE = rf"(?<=<)\\(\\*)(?={_ANGLE})|(?<=\[)\\(\\*)(?={_SQUARE})"


def escape(x: Column) -> Column:
    """Put one more backslash after the first character of every control string."""
    return F.regexp_replace(x, _OPEN, r"$1$2\\")


def unescape(x: Column) -> Column:
    """Take the backslash away that :func:`escape` put in."""
    return F.regexp_replace(x, _CLOSE, "$1$2")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are the (start, length) spans, in code points of ``formatted``, of the assistant's texts.
    Turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged by
    array functions. Starts are running sums in two steps (within chunks of turns, then over chunks), so
    long conversations don't cost the square of their turns.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    got = got.select("conv_id", F.transform("t", lambda x: F.struct(x.role.alias("role"), escape(x.text).alias("text"))).alias("t"))
    # where each run of one role begins
    got = got.withColumn("first", F.expr("filter(sequence(1, size(t)), i -> i = 1 or t[i - 1].role <> t[i - 2].role)"))
    got = got.withColumn("runs", F.expr("transform(first, (b, j) -> struct(t[b - 1].role as role, slice(t, b, coalesce(get(first, j + 1), size(t) + 1) - b).text as texts))"))
    head, done = F.lit("<|turn|>"), F.lit("<|done|>")
    got = got.withColumn("blocks", F.transform("runs", lambda r: F.struct(F.concat(head, escape(r.role), F.lit("<|says|>")).alias("head"), F.array_join(r.texts, "<|more|>").alias("body"), (r.role == "assistant").alias("loss"), F.transform(r.texts, lambda x: F.length(x)).alias("sizes"))))
    # one element per turn: what stands before its text since the last text's end, and the text's length
    got = got.withColumn("steps", F.expr("flatten(transform(blocks, (b, j) -> transform(b.sizes, (n, k) -> struct(if(k > 0, 8, length(b.head) + if(j > 0, 8, 0)) as gap, n as n, b.loss as loss))))"))
    got = got.withColumn("chunks", F.expr("transform(sequence(0, int((size(steps) - 1) / 256)), c -> slice(steps, c * 256 + 1, 256))"))
    got = got.withColumn("before", F.expr("aggregate(chunks, array(0L), (a, c) -> array_append(a, a[size(a) - 1] + aggregate(c, 0L, (s, x) -> s + x.gap + x.n)))"))
    spans = """flatten(transform(chunks, (c, k) -> aggregate(c, struct(before[k] as at, array_repeat(struct(0L as start, 0 as length), 0) as spans),
        (a, x) -> struct(a.at + x.gap + x.n as at, if(x.loss, array_append(a.spans, struct(a.at + x.gap as start, x.n as length)), a.spans) as spans), a -> a.spans)))"""
    return got.select("conv_id", F.array_join(F.transform("blocks", lambda b: F.concat(b.head, b.body, done)), "").alias("formatted"), F.expr(spans).alias("loss_spans"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: adds ``turns`` (array of role and text) and ``loss_text``."""
    blocks = F.filter(F.split("formatted", r"<\|done\|>"), lambda x: x != "")
    parts = F.transform(blocks, lambda b: F.struct(unescape(F.regexp_extract(b, r"(?s)^<\|turn\|>(.*?)<\|says\|>", 1)).alias("role"), F.split(F.regexp_replace(b, r"(?s)^<\|turn\|>.*?<\|says\|>", ""), r"<\|more\|>").alias("texts")))
    turns = F.flatten(F.transform(parts, lambda p: F.transform(p.texts, lambda x: F.struct(p.role.alias("role"), unescape(x).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s.start.cast("int") + 1, s.length)))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, ""))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, then read back from the output."""
    own = spark.sql(r"SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = parse_conversations(format_conversations(rows))
    digest = F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/?s>|</?SYS>>|\|(?:turn|says|more|done|im_start|im_end|endoftext)\|>)', '<\1\\\2', 'g'), '\[(\\*)(/?INST\])', '[\1\\\2', 'g') AS escaped,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + 8 + CASE WHEN before = role THEN 0 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
