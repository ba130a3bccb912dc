"""Context, history, prompts and citations of answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.functions.text import preview

NO_CONTEXT = "No relevant documents were found."
RULES = "Use only the numbered sources. Cite each claim as [Source n]. Say so when the sources do not answer. Do not guess. Keep to the question."


def within_budget(results: DataFrame, tokens: int = config.CONTEXT_TOKENS) -> DataFrame:
    """Results in order while their tokens fit; the first that does not fit ends the list."""
    cost = F.greatest(F.lit(1), F.floor(F.length("content") / config.CHARS_PER_TOKEN))
    used = F.sum(cost).over(Window.partitionBy("query_id").orderBy("citation_index").rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("context_tokens", used.cast("long")).filter(F.col("context_tokens") <= tokens)


def context_block(results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, context; with queries, those without results get the fixed sentence."""
    head = F.format_string("[Source %d] (captured: %s, from: %s — %s)\n%s", F.col("citation_index"), F.date_format("captured_at", "yyyy-MM-dd"), F.col("source_type"), F.col("source_path"), F.col("content"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("citation_index", head.alias("text")))), lambda x: x["text"])
    out = results.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))
    return queries.select("query_id").join(out, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT))) if queries is not None else out


def history(turns: DataFrame, n: int = config.HISTORY_TURNS) -> DataFrame:
    """The last n turns of each session (session_id, turn, role, content), oldest first by turn."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def history_block(turns: DataFrame, n: int = config.HISTORY_TURNS) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.col("content")).alias("line")))), lambda x: x["line"])
    return history(turns, n).groupBy("session_id").agg(F.array_join(lines, "\n").alias("history"))


def prompt(query: Column, context: Column, past: Column | None = None) -> Column:
    parts = [F.lit(RULES), F.lit("Sources:"), context]
    if past is not None:
        parts.append(F.when(past != "", F.concat(F.lit("Conversation so far:\n"), past)))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("USER: "), query), F.lit("ASSISTANT:"))


def answers(prompts: DataFrame, generate: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """prompts with an answer column; a failing generator gives an apology with its error. The offline default quotes the first source."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        try:
            return generate(p) if generate else p.map(lambda x: f"{x.split('[Source 1]', 1)[1].split(chr(10), 2)[1][:200]} [Source 1]" if "[Source 1]" in x else NO_CONTEXT)
        except Exception as error:  # noqa: BLE001 - the contract is an answer that names the error
            return pd.Series([f"Sorry, no answer could be made: {error}"] * len(p))

    return prompts.withColumn("answer", run("prompt"))


def cited(answer: Column) -> Column:
    """Distinct source numbers of an answer."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[Source ([0-9]+)\]"), F.lit(1)), lambda x: x.cast("long")))


def citation_cards(results: DataFrame, answered: DataFrame) -> DataFrame:
    """Cited results with a snippet; answered: query_id, answer."""
    both = results.join(answered.select("query_id", cited(F.col("answer")).alias("_cited")), "query_id").filter(F.array_contains("_cited", F.col("citation_index")))
    return both.select("query_id", "citation_index", "chunk_id", "document_id", preview(F.col("content")).alias("snippet"), F.round("combined_score", 4).alias("score"))


def sessions(turns: DataFrame, limit: int = 20) -> DataFrame:
    """session_id, created_at, last_active, n_turns, title (first user turn, 100 characters), newest first."""
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("turn")))
    out = turns.groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("last_active"), F.count("*").alias("n_turns"), F.substring(first, 1, 100).alias("title"))
    return out.orderBy(F.desc("last_active"), "session_id").limit(limit)


TURNS_DDL = "session_id long, turn long, role string, content string, created_at timestamp_ntz"


def new_turns(stored: DataFrame, said: DataFrame) -> DataFrame:
    """The turns that said (session_id, query, answer, asked_at) adds: per row a user's and an assistant's, numbered on from the session's last."""
    last = stored.groupBy("session_id").agg(F.max("turn").alias("last"))
    pair = F.array(F.struct(F.lit(1).alias("n"), F.lit("user").alias("role"), F.col("query").alias("content")), F.struct(F.lit(2).alias("n"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("asked_at", "query")) - 1
    rows = said.withColumn("_place", place).withColumn("x", F.explode(pair)).join(last, "session_id", "left")
    turn = (F.coalesce("last", F.lit(0)) + 2 * F.col("_place") + F.col("x.n")).cast("long")
    return rows.select("session_id", turn.alias("turn"), "x.role", "x.content", F.col("asked_at").cast("timestamp_ntz").alias("created_at"))


def chat_prompts(asked: DataFrame, results: DataFrame, turns: DataFrame) -> DataFrame:
    """asked (query_id, session_id, query) with prompt: rules, context of the results within their budget, the session's last turns, the query."""
    context, past = context_block(within_budget(results), asked), history_block(turns)
    return asked.join(context, "query_id").join(past, "session_id", "left").withColumn("prompt", prompt(F.col("query"), F.col("context"), F.coalesce("history", F.lit("")))).drop("context", "history")


def without_sessions(turns: DataFrame, ids: DataFrame) -> DataFrame:
    return turns.join(ids.select("session_id").distinct(), "session_id", "left_anti")
