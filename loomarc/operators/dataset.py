"""Datasets of question cases: import, prompts, selection.

Prompts and context headers are fixed texts of the dataset format and must not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomarc.functions import text as T
from loomarc.operators.windows import first_per_group, top_per_group
from loomarc.runtime import small_or_shuffled

# Tasks in import order, and those scored exactly.
TASKS = ("multifieldqa_zh", "dureader", "passage_retrieval_zh", "multifieldqa_en", "hotpotqa", "lcc", "repobench-p")
EXACT_TASKS = ("passage_retrieval_zh", "lcc", "repobench-p")
CODE_TASKS = ("lcc", "repobench-p")
SOURCE = "LongBench"
# The question texts by task and language, before the task input.
CODE_QUESTION = (
    "This is a LongBench code completion task.\nThe archive context is the code prefix/context. Predict only the next missing answer span from that context.\n"
    "Output the shortest completion span only. No surrounding code. No markdown fences. No explanation.\nTask input:\n"
)
PASSAGE_QUESTION = (
    "这是 LongBench 中文段落检索任务。请根据下面的任务输入，在 archive context 的候选段落中找出最匹配的段落编号。\n只输出段落编号，例如：段落27。不要解释。\n任务输入：\n"
)
SEARCH_QUESTION = (
    "这是 LongBench 中文搜索问答任务。任务输入是搜索查询，请根据 archive context 给出最能回答该查询的简短结论。\n"
    "不要复述无关剧情细节；只输出答案短语或短句，不要解释。\n搜索查询：\n"
)
CHINESE_QUESTION = "请只根据 archive context 回答下面的 LongBench 问题。\n只输出最短答案片段，不要解释。\n问题：\n"
ENGLISH_QUESTION = "Answer this LongBench question using only the archive context.\nOutput only the shortest answer span. No explanation.\nQuestion:\n"
EMPTY_CODE_INPUT = "<empty; complete from archive context>"


def question(task: Column, language: Column, text: Column) -> Column:
    """The question of a case by its task, then its language."""
    shown = T.or_empty_mark(text)
    return (
        F.when(task.isin(*CODE_TASKS), F.concat(F.lit(CODE_QUESTION), T.or_empty_mark(text, EMPTY_CODE_INPUT)))
        .when(task == "passage_retrieval_zh", F.concat(F.lit(PASSAGE_QUESTION), shown))
        .when(task == "dureader", F.concat(F.lit(SEARCH_QUESTION), shown))
        .when(language == "zh", F.concat(F.lit(CHINESE_QUESTION), shown))
        .otherwise(F.concat(F.lit(ENGLISH_QUESTION), shown))
    )


def context(dataset: Column, language: Column, source_id: Column, text: Column, body: Column, source: str = SOURCE) -> Column:
    """Header lines, the input, and the context of a case."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit(f"Source: {source}\nDataset: "), blank(dataset), F.lit("\nLanguage: "), blank(language), F.lit("\nSource id: "), blank(source_id),
        F.lit("\n\nInput:\n"), T.or_empty_mark(text), F.lit("\n\nContext:\n"), blank(body),
    )


def score_class(task: Column) -> Column:
    return F.when(task.isin(*EXACT_TASKS), "exact").otherwise("semantic")


def import_cases(items: DataFrame, per_task: int, order: str = "position") -> DataFrame:
    """The first ``per_task`` items of each task as cases.

    ``items`` needs ``task, input, context, answers, length, language, _id`` and the order
    column (file position). Case ids are the task's slug and the index within the task.
    """
    chosen = top_per_group(items, "task", per_task, order)
    case_id = F.concat(T.slug(F.col("task")), F.lit("-"), T.zero_pad(F.col("index_in_group"), 4))
    return chosen.select(
        case_id.alias("id"), F.lit(SOURCE).alias("source"), F.col("_id").alias("source_id"), "task", "language",
        score_class(F.col("task")).alias("score"), "length",
        T.utf16_length(F.coalesce("context", F.lit(""))).alias("context_chars"), T.utf16_length(F.coalesce("input", F.lit(""))).alias("input_chars"),
        F.coalesce(F.size("answers"), F.lit(0)).cast("bigint").alias("answer_count"), "answers",
        question(F.col("task"), F.col("language"), F.col("input")).alias("question"),
        context(F.col("task"), F.col("language"), F.col("_id"), F.col("input"), F.col("context")).alias("context_text"),
    )


def by_ids(cases: DataFrame, ids: str, id_col: str = "id") -> DataFrame:
    """Cases whose id is in a comma-separated list; blanks are trimmed, unknown ids ignored."""
    wanted = [x.strip() for x in ids.split(",") if x.strip()]
    return cases.where(F.col(id_col).isin(wanted)) if wanted else cases.limit(0)


def select_cases(cases: DataFrame, ids: str = "", one_per_task: bool = False, limit: int = 0, order: str = "position", id_col: str = "id") -> DataFrame:
    """By ids, else the first of each task, else the first ``limit`` (0: all)."""
    if ids:
        return by_ids(cases, ids, id_col)
    if one_per_task:
        return first_per_group(cases, "task", order)
    return cases.orderBy(order).limit(limit) if limit else cases


def text_prompt(carrier: Column, asked: Column) -> Column:
    """Question over a text carrier."""
    return F.concat(F.lit("Answer the question using only the archive text. Reply with the shortest exact answer span. Do not explain.\n\nArchive:\n"), carrier, F.lit("\n\nQuestion: "), asked)


def image_prompt(asked: Column) -> Column:
    """Question over an image."""
    return F.concat(F.lit("Answer the question using only the image. Reply with the shortest exact answer span. Do not explain.\n\nQuestion: "), asked)


def run_id(*parts: Column) -> Column:
    """Parts of a run's name, as slugs that keep dots, joined by two underscores."""
    return F.concat_ws("__", *[T.slug(p, keep_dots=True) for p in parts])


def items_with_carrier(items: DataFrame, carriers: DataFrame, key: str, image: bool = False) -> DataFrame:
    """Every question with the one carrier of its key and the prompt that asks it: ``qa_id, carrier_id, prompt``.

    Of several carriers of a key the first by id counts, so an item has one row at most. In image mode the prompt
    holds no text of the carrier, and none is read or moved. Items without a carrier have no row.
    """
    text = F.lit("") if image else F.coalesce(F.col("text"), F.lit(""))
    one = carriers.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("carrier_id").alias("carrier_id"), *([] if image else [F.min_by(text, "carrier_id").alias("text")]))
    asked = F.coalesce("question", F.lit(""))
    joined = items.select("qa_id", "question", key).join(small_or_shuffled(one), key)
    return joined.select("qa_id", "carrier_id", (image_prompt(asked) if image else text_prompt(F.col("text"), asked)).alias("prompt"))
