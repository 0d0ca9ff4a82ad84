"""Conversations: history windows, prompts with citations, titles, the offline stub provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.keys import citation, display
from lodestar.functions.text import count_words

# Fixed values.
HISTORY = 8
TITLE = 120


def history(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", last: int = HISTORY) -> DataFrame:
    """The last turns of each conversation, then without the empty ones: an empty turn uses up its place."""
    newest = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return turns.withColumn("__n", F.row_number().over(newest)).where((F.col("__n") <= last) & F.col(text).isNotNull() & (F.col(text) != "")).drop("__n")


def context_block() -> Column:
    """A hit as a block of a prompt, from path, line_start, kind, qualname, name, source and text."""
    label = display("qualname", "name", "path")
    return F.concat(F.lit("--- "), citation("path", "line_start"), F.lit(" — "), "kind", F.lit(" "), label, F.when(F.col("source") == "graph", " (via call graph)").otherwise(""), F.lit(" ---\n"), "text")


def context_prompt(hits: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: its hits, a few by top_k, as one text, best first."""
    blocks = F.array_sort(F.collect_list(F.struct(-F.col("score"), F.col("id"), context_block().alias("block"))))
    return hits.groupBy(*by).agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("prompt"))


def citations(hits: DataFrame) -> DataFrame:
    return hits.select("path", "line_start", "line_end", "qualname", "kind", F.round("score", 4).alias("score"), "source", citation("path", "line_start").alias("citation"))


def user_turn(excerpts: str | None, question: str, radius: str | None = None) -> str:
    """The user's turn: excerpts, the blast radius where there is one, the question."""
    parts = [f"Excerpts from the codebase:\n\n{excerpts or 'No excerpts were retrieved for this question.'}", *([radius] if radius else []), f"Question: {question}"]
    return "\n\n".join(parts)


def titles(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, title): the start of the first user turn; null without one."""
    first = F.min_by(F.when(F.col("role") == "user", F.left("text", F.lit(TITLE))), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy(conversation).agg(first.alias("title"))


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its number of messages, newest first. conversations: (conv_id, created_at)."""
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("messages"))
    return conversations.join(counts, "conv_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0))).orderBy(F.desc("created_at"), "conv_id")


def conversation_detail(turns: DataFrame, conversation) -> DataFrame:
    return turns.where(F.col("conv_id") == conversation).orderBy("turn")


def stub_answer(question: Column) -> Column:
    """What the offline provider streams, put together: each word with a space behind it."""
    return F.concat(F.lit("stub answer to: "), F.coalesce(question, F.lit("")), F.lit(" "))


def stub_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, answer, input_tokens, output_tokens) for each conversation; tokens are words."""
    last = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    asked = turns.groupBy("conv_id").agg(last.alias("question"), F.sum(count_words(F.col("text"))).alias("input_tokens"))
    return asked.select("conv_id", stub_answer(F.col("question")).alias("answer"), "input_tokens", count_words(stub_answer(F.col("question"))).alias("output_tokens"))
