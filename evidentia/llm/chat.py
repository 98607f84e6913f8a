"""Chat formatting from Spark expressions only.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn; adjacent turns of one role share a block, their
texts divided by ``<|im_sep|>``.  Inside texts and roles a backslash is doubled and ``<|`` is written
``<\\|``; in roles a line feed is written ``<\\n``.  So no control string stands inside a text and the
output reads back to the very rows it was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.line_dedup import running, span_sums, sum_before

START, END, SEP = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    return _replace(_replace(c, "\\", "\\\\"), "<|", "<\\|")


def unescape(c: Column) -> Column:
    return _replace(_replace(c, "<\\|", "<|"), "\\\\", "\\")


def escape_role(c: Column) -> Column:
    return _replace(escape(c), "\n", "<\\n")


def unescape_role(c: Column) -> Column:
    return unescape(_replace(c, "<\\n", "\n"))


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: (conv_id, formatted, segments array<struct<text, loss>>, loss_spans array<struct<start, length>>).

    ``formatted`` is the segments' texts in order; the loss mask covers the segments with ``loss`` true, which are
    exactly the escaped texts of the loss role; ``loss_spans`` says where they stand, in bytes of UTF-8 from 0.  Turns sort by (turn, role, text), null turns first, so ties have one
    order and repeated rows stay repeated turns.  Null text or role: empty.  Rows without a conversation id are one
    conversation of their own.  Other columns are left out; an empty table gives an empty table.
    A conversation is one output row, so its rows do meet in one task; nothing else is gathered by key.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(turns: Column) -> Column:
        """Three segments a turn: what stands before its text, the text, and the end of its block."""

        def of(t: Column, i: Column) -> Column:
            last_role = F.try_element_at(turns, i).getField("role")  # element_at counts from 1: the turn before
            joined = (i > 0) & (F.when(i > 0, last_role) == t["role"])
            ended = F.when(i + 1 < F.size(turns), F.try_element_at(turns, i + 2).getField("role") == t["role"]).otherwise(False)
            opening = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
            return F.array(
                F.struct(F.when(joined, F.lit(SEP)).otherwise(opening).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")),
                F.struct(F.when(ended, F.lit("")).otherwise(F.lit(END + "\n")).alias("text"), F.lit(False).alias("loss")),
            )

        return F.flatten(F.transform(turns, of))

    cut = chats.select("conv_id", segments(F.col("turns")).alias("segments"))
    cut = cut.withColumn("sizes", F.transform("segments", lambda s: F.octet_length(s["text"]).cast("long")))
    cut = cut.withColumn("sums", span_sums(F.col("sizes")))
    totals = running(F.transform("sums", lambda x: F.element_at(x, -1)))
    # bound by an outer transform: a plan may otherwise make the totals again for each segment
    bound = F.array(F.struct("segments", "sums", totals.alias("totals")))
    place = lambda b, s, i: F.struct(sum_before(b["sums"], b["totals"], i).alias("start"), F.octet_length(s["text"]).cast("long").alias("length"), s["loss"].alias("loss"))
    placed = F.get(F.transform(bound, lambda b: F.transform(b["segments"], lambda s, i: place(b, s, i))), 0)
    spans = F.transform(F.filter(placed, lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return cut.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", spans.alias("loss_spans"))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text of a formatted conversation under its loss mask, unescaped.

    The outer transform binds the bytes once; a piece of bytes is cut without walking to it.
    """
    bound = F.array(F.struct(formatted.cast("binary").alias("raw"), spans.alias("spans")))
    cut = lambda b, p: unescape(F.substring(b["raw"], (p["start"] + 1).cast("int"), p["length"].cast("int")).cast("string"))
    return F.get(F.transform(bound, lambda b: F.array_join(F.transform(b["spans"], lambda p: cut(b, p)), "")), 0)


def read_back(formatted: Column) -> Column:
    """The turns array<struct<role, text>> that a formatted conversation was made of."""
    quoted = {x: x.replace("|", "\\|") for x in (START, SEP)}
    blocks = F.filter(F.split(formatted, quoted[START]), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.instr(block, "\n")
        body = F.substring(block, at + 1, F.length(block) - at - len(END) - 1)
        return F.transform(F.split(body, quoted[SEP]), lambda t: F.struct(unescape_role(F.substring(block, F.lit(1), at - 1)).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation what reads back from the output: turns, loss text and lengths."""
    read = chats.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        read_back(F.col("formatted")).alias("turns"),
        under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: DuckDB: the same digests straight from the rows.
ORACLE = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), told AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et,
         replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n') AS er,
         lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM every WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(et) + CASE WHEN before IS NOT DISTINCT FROM role THEN 10 ELSE 13 + length(er) END
      + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 11 END)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""
