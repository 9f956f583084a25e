"""Transcript rendering and export.

A transcript is a header plus one block per message; it is produced as
ordered lines (one row per message), so no conversation is ever gathered
into a single value.  The export writes them range-partitioned by
(conversation, turn), one text folder per conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Sender labels and the feedback mark removed from texts.
USER_LABEL = "You"
ASSISTANT_LABEL = "AI Assistant"
FEEDBACK_MARK = "👍 👎"
DEFAULT_HEADER = "AI Assistant - Chat Transcript"


def transcript_lines(conversations: DataFrame, header: str = DEFAULT_HEADER) -> DataFrame:
    """(conv_id, turn, line): turn -1 holds ``HEADER\\n\\n``; each message is
    ``SENDER (turn N):\\nTEXT\\n\\n``."""
    sender = F.when(F.col("role") == "user", F.lit(USER_LABEL)).otherwise(F.lit(ASSISTANT_LABEL))
    text = py_strip(F.replace(F.col("text"), F.lit(FEEDBACK_MARK), F.lit("")))
    msgs = conversations.select(
        "conv_id", "turn",
        F.concat(sender, F.lit(" (turn "), F.col("turn").cast("string"), F.lit("):\n"), text,
                 F.lit("\n\n")).alias("line"))
    heads = conversations.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit(header + "\n\n").alias("line"))
    return heads.unionByName(msgs)


def export_transcripts(lines: DataFrame, path: str) -> None:
    """Write each conversation's lines in turn order under
    ``path/conv_id=N/`` (part files in range order)."""
    (lines.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
     # every block ends with a newline; the text sink adds it back
     .select("conv_id", F.expr("substring(line, 1, length(line) - 1)").alias("line"))
     .write.mode("error").partitionBy("conv_id").text(path))
