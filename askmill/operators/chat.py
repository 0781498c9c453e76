"""From hits and turns to prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The texts around what is shown and asked, and the placeholder for what is missing.
NONE = "—"
DOCUMENTS = "Релевантные документы:\n\n"
USER, BOT = "Юзер: ", " | Бот: "
PROMPT = ("Системное сообщение:\n    ", "\n\n    Контекст (результаты поиска):\n    ", "\n\n    История диалога:\n    ", "\n\n    Вопрос:\n    ")


def context_per_query(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, context, display, status: distinct texts and paths of a query's hits, sorted; ``no_documents`` where it has none, or none with a text. A null text isn't one, an empty one is."""
    sets = hits.groupBy("query_id").agg(F.array_sort(F.collect_set("document")).alias("texts"), F.array_sort(F.collect_set("file_path")).alias("paths"))
    rows = queries.select(F.col("query_id").cast("string").alias("query_id")).join(sets, "query_id", "left")
    found = F.col("texts").isNotNull() & (F.size("texts") > 0)
    return rows.select(
        "query_id",
        F.when(found, F.array_join("texts", "\n")).otherwise(NONE).alias("context"),
        F.when(found, F.concat(F.lit(DOCUMENTS), F.array_join("paths", "\n\n"))).alias("display"),
        F.when(found, "ok").otherwise("no_documents").alias("status"),
    )


#: What a user sends to have the dialogue's history cleared.
CLEAR = "/clear"


def _pairs(turns: DataFrame, clear: str | None) -> DataFrame:
    """conv_id, turn, u, b and epoch, how often the dialogue was cleared before: a clearing turn answers nothing, and no pair reaches over it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    cleared = F.lit(False) if clear is None else F.coalesce((F.col("role") == "user") & (F.col("text") == clear), F.lit(False))
    rows = turns.select("conv_id", "turn", "role", "text", cleared.alias("cleared"))
    # Turns of an epoch lie in the conversation's partition: one shuffle serves all windows.
    rows = rows.withColumn("epoch", F.count_if("cleared").over(w.rowsBetween(Window.unboundedPreceding, 0)) if clear is not None else F.lit(0).cast("long"))
    w = Window.partitionBy("conv_id", "epoch").orderBy("turn")
    rows = rows.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).filter("role = 'user' and not cleared")
    return rows.select("conv_id", "epoch", "turn", F.col("text").alias("u"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("b"))


def pairs(turns: DataFrame, clear: str | None = None) -> DataFrame:
    """conv_id, turn, u, b: each user's turn, with the assistant's answer if the next turn is one. Turns that clear the history are none."""
    return _pairs(turns, clear).drop("epoch")


def prompt_history(turns: DataFrame, max_turns: int | None = None, clear: str | None = None) -> DataFrame:
    """conv_id, turn, history: before each user's turn the answered pairs of the conversation, in order. After a user's turn with the text ``clear`` it starts anew.

    All of them by default, so a conversation's prompts grow with the square of its turns; ``max_turns`` keeps the last ones.
    """
    w = Window.partitionBy("conv_id", "epoch").orderBy("turn").rowsBetween(Window.unboundedPreceding if max_turns is None else -max_turns, -1)
    line = F.when(F.col("b").isNotNull(), F.concat(F.lit(USER), "u", F.lit(BOT), "b"))
    rows = _pairs(turns, clear).withColumn("line", line).withColumn("lines", F.collect_list("line").over(w))
    return rows.select("conv_id", "turn", F.when(F.size("lines") > 0, F.array_join("lines", "\n")).otherwise(NONE).alias("history"))


def build_prompts(rows: DataFrame, system: str | None = None) -> DataFrame:
    """query_id, prompt: the template with system text, context, history and query. Without ``system`` each row has its own; what is null stands as missing."""
    of = lambda c: F.coalesce(F.col(c), F.lit(NONE))
    parts = (of("system") if system is None else F.lit(system), of("context"), of("history"), F.coalesce(F.col("query"), F.lit("")))
    return rows.select("query_id", F.concat(*[x for head, part in zip(PROMPT, parts, strict=True) for x in (F.lit(head), part)]).alias("prompt"))


#: Tabs whose system text each executor may be sent; more are joined by shuffle.
MOST_TABS = 10_000


def system_prompts(sessions: DataFrame, prompts: DataFrame, session_id: str = "session_id") -> DataFrame:
    """The sessions with the system prompt of the tab that their id begins with. ``prompts``: prefix, system; a row for each tab."""
    few = prompts.limit(MOST_TABS + 1).count() <= MOST_TABS
    return sessions.withColumn("prefix", F.split(session_id, "_")[0]).join(F.broadcast(prompts) if few else prompts, "prefix", "left")
