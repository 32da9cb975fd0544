"""Evaluation tasks by name: what turns a task's raw rows into items (context, choices, gold)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evaluation as ev

#: name -> rows -> rows with context, choices and gold beside their other columns.
TASKS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def task(name: str):
    """Register a function of raw rows as the task of that name."""

    def add(fn):
        TASKS[name] = fn
        return fn

    return add


def load(name: str, rows: DataFrame | None = None, limit: int = 0, order_by: list[str] = ()) -> DataFrame:
    """The items of a task; an unknown name is an error. limit > 0 gives so many, the first by order_by."""
    if name not in TASKS:
        raise KeyError(f"no task {name!r}, only {', '.join(sorted(TASKS))}")
    got = TASKS[name](rows)
    return (got.orderBy(*order_by) if order_by else got).limit(limit) if limit > 0 else got


def _with(rows: DataFrame, context: Column, choices: Column, gold: Column) -> DataFrame:
    made = {"context": context, "choices": choices, "gold": gold.cast("int")}
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in made]
    return rows.select(*kept, *[c.alias(n) for n, c in made.items()])


def lettered(question: str) -> Callable[[DataFrame], DataFrame]:
    """Rows (<question>, choices struct<label, text>, answerKey): gold is the key's place among the labels, 0 if it isn't there.

    Rows whose choices are plain texts have gold in answerKey.
    """

    def build(rows: DataFrame) -> DataFrame:
        if rows.schema["choices"].dataType.typeName() == "struct":
            texts, gold = F.col("choices.text"), ev.gold_of(F.col("choices.label"), F.col("answerKey"))
        else:
            texts, gold = F.col("choices"), F.col("answerKey")
        return _with(rows, F.col(question), ev.spaced(texts), gold)

    return build


TASKS |= {"arc_easy": lettered("question"), "arc_challenge": lettered("question"), "openbookqa": lettered("question_stem")}


@task("hellaswag")
def hellaswag(rows: DataFrame) -> DataFrame:
    """Rows (activity_label, ctx_a, ctx_b, ctx, endings, label)."""
    return _with(rows, ev.completion(*map(F.col, ("activity_label", "ctx_a", "ctx_b", "ctx"))), ev.spaced(F.col("endings")), F.col("label"))


@task("piqa")
def piqa(rows: DataFrame) -> DataFrame:
    """Rows (goal, sol1, sol2, label): two solutions, each with a blank before and otherwise as it is."""
    return _with(rows, F.col("goal"), F.array(*[F.concat(F.lit(" "), c) for c in ("sol1", "sol2")]), F.col("label"))


@task("winogrande")
def winogrande(rows: DataFrame) -> DataFrame:
    """Rows (sentence, option1, option2, answer), answers from 1."""
    context, choices = ev.fill_blank(F.col("sentence"), [F.col("option1"), F.col("option2")])
    return _with(rows, context, choices, F.col("answer").cast("int") - 1)


@task("lambada")
def lambada(rows: DataFrame) -> DataFrame:
    """Rows (text): the last word is the only choice."""
    context, choice = ev.last_word(F.col("text"))
    return _with(rows, context, F.array(choice), F.lit(0))


#: Items that any working scorer gets right.
PLAIN = [
    ("Seven days make one", [" week", " teapot", " minus"], 0),
    ("At night the sun cannot be", [" knitted", " seen", " divided"], 1),
    ("A bicycle has two", [" opinions", " Octobers", " wheels"], 2),
]


@task("sanity")
def sanity(rows: DataFrame | None = None) -> DataFrame:
    """Three items of its own, numbered, whatever the rows are."""
    spark = rows.sparkSession if rows is not None else SparkSession.active()
    return spark.createDataFrame([(k, *r) for k, r in enumerate(PLAIN)], "n int, context string, choices array<string>, gold int")
