"""Bounded conversation memory: tails, hints, summaries, effective queries and the kind of a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.text import squeeze, truncate_tail
from docustrata.operators.relational import tail

MESSAGES, SUMMARY_CHARS, DOCUMENT_HINTS, LOCATOR_HINTS, THREADS, MESSAGE_CHARS = 8, 1200, 6, 8, 6, 180
#: Parts of words that show what a turn is.
EXPAND, CLARIFY, FOLLOW_UP = ["подробнее", "разверн", "раскрой", "expand", "more detail"], ["уточн", "имел в виду", "clarif"], ["а если", "а для", "тогда", "также", "what about", "and if"]


def last_messages(messages: DataFrame, n: int = MESSAGES) -> DataFrame:
    """The last n messages of each conversation (conv_id, turn, role, text)."""
    return tail(messages, ["conv_id"], [F.desc("turn"), F.desc("role")], n)


def last_hints(mentions: DataFrame, n: int) -> DataFrame:
    """The last n hints of each conversation (conv_id, turn, hint): each once by its first mention, whatever its case, in first spelling."""
    first = mentions.where("length(trim(hint)) > 0").groupBy("conv_id", F.lower("hint").alias("_key")).agg(F.min(F.struct("turn", "hint")).alias("f")).select("conv_id", F.col("f.turn").alias("turn"), F.col("f.hint").alias("hint"))
    return tail(first, ["conv_id"], [F.desc("turn"), F.desc("hint")], n)


def summaries(messages: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """conv_id, summary: the document hints and the last four messages, each cut at 180 characters, all cut at 1200."""
    last = last_messages(messages, 4).select("conv_id", "turn", F.concat(F.col("role"), F.lit(": "), truncate_tail(F.coalesce("text", F.lit("")), MESSAGE_CHARS)).alias("m"))
    talk = last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]), "\n").alias("_talk"))
    parts = [F.concat(F.lit("Messages:\n"), F.col("_talk"))]
    if hints is not None:
        named = hints.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "hint"))), lambda x: x["hint"]), ", ").alias("_hints"))
        talk = talk.join(named, "conv_id", "left")
        parts = [F.concat(F.lit("Documents: "), F.col("_hints")), *parts]
    return talk.select("conv_id", F.left(F.concat_ws("\n", *parts), F.lit(SUMMARY_CHARS)).alias("summary"))


#: What stands before the parts of an effective query, by part; what a kind of turn asks for, and what its question is called.
PARTS = {"summary": "Контекст беседы: ", "override": "Requested document override: ", "documents": "Документы в фокусе: ", "locators": "Локаторы в фокусе: ", "threads": "Незакрытые темы: ", "messages": "Последние сообщения: ", "previous": "Предыдущий ответ: "}
OVERRIDE_END = ". Keep the current technical topic, but prefer these documents."
GUIDANCE = {
    "follow_up": "Инструкция: продолжай текущую тему. Сначала используй активные документы и локаторы, но при необходимости расширяй evidence pack дополнительными retrieval units и соседним контекстом.",
    "clarify": "Инструкция: пользователь просит уточнить ответ или показать ссылку. Приоритетно проверяй активные document/locator hints, ищи точный пункт, citation и локальный контекст.",
    "expand_answer": "Инструкция: пользователь просит дополнить предыдущий ответ. Расширяй evidence pack, поднимай дополнительные locator hits и retrieval units в том же документе, чтобы partial мог стать direct.",
}
QUESTION = {"follow_up": "Follow-up вопрос пользователя", "clarify": "Уточняющий вопрос пользователя", "expand_answer": "Пользователь просит дополнить предыдущий ответ"}
PREVIOUS_CHARS = 240


def effective_query(question: Column, kind: Column, summary: Column, asked: Column, documents: Column, locators: Column, threads: Column, messages: Column, previous: Column) -> Column:
    """The question below what the conversation holds, cut at twice the summary's length; a new question stands alone; absent parts leave no line.

    asked (documents that the question names, which replace those in focus), documents, locators, threads: arrays of strings; messages: the last
    two, an array of struct role, content; previous: the last answer.
    """
    listed = lambda c, sep=", ": F.nullif(F.array_join(F.coalesce(c, F.array().cast("array<string>")), sep), F.lit(""))
    line = lambda part, c, end="": F.concat(F.lit(PARTS[part]), c, F.lit(end))
    override = line("override", listed(asked), OVERRIDE_END)
    talk = F.nullif(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), truncate_tail(F.coalesce(m["content"], F.lit("")), MESSAGE_CHARS))), " | "), F.lit(""))
    by_kind = lambda table: F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), kind)
    parts = [
        line("summary", F.nullif(summary, F.lit(""))),
        F.coalesce(override, line("documents", listed(documents), ".")),
        line("locators", listed(locators), "."),
        line("threads", listed(threads, "; "), "."),
        line("messages", talk),
        line("previous", truncate_tail(previous, PREVIOUS_CHARS)),
        by_kind(GUIDANCE),
        F.concat(by_kind(QUESTION), F.lit(": "), question),
    ]
    whole = F.trim(F.concat_ws("\n", *parts))
    return F.when(kind == "new_question", question).otherwise(F.left(whole, F.lit(2 * SUMMARY_CHARS)))


def turn_kind(question: Column, has_context: Column, shifted: Column) -> Column:
    """new_question without question or context or after a shift; else by what the words show; short ones follow up."""
    low = F.lower(squeeze(F.coalesce(question, F.lit(""))))
    some = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(low, p))
    return F.when((low == "") | ~has_context | shifted, "new_question").when(some(EXPAND), "expand_answer").when(some(FOLLOW_UP), "follow_up").when(some(CLARIFY), "clarify_answer").when(F.size(F.split(low, " ")) <= 8, "follow_up").otherwise("new_question")


def is_shift(active: Column, asked: Column, question: Column) -> Column:
    """Whether a question names documents, none of the active ones, and isn't just a code of up to eight words."""
    short = F.size(F.split(squeeze(question), " ")) <= 8
    return (F.size(active) > 0) & (F.size(asked) > 0) & ~short & ~F.arrays_overlap(active, asked)


def threads_after(threads: Column, mode: Column, question: Column, limitations: Column) -> Column:
    """Open threads after an answer: partial and clarify add one, direct ends those that share a word with the question; the last six stay."""
    words = F.filter(F.split(F.lower(squeeze(question)), " "), lambda w: F.length(w) > 0)
    added = F.array_append(threads, F.concat(question, F.lit(" :: "), F.left(limitations, F.lit(200))))
    kept = F.filter(threads, lambda t: ~F.arrays_overlap(F.split(F.lower(t), " "), words))
    out = F.when(mode.isin("partial", "clarify"), added).when(mode == "direct", kept).otherwise(threads)
    return F.slice(out, F.greatest(F.lit(1), F.size(out) - THREADS + 1), F.lit(THREADS))
