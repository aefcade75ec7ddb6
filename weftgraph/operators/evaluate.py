"""Answer quality with and without selection: questions, prompts, and a judge, by a provider that the caller brings.

A provider is a function from a prompt to a reply. It is called in the tasks, one question after
another; a call that fails marks its question and leaves the others as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import analytics

QUESTIONS = "id string, question string, area string, ground_truth string, relevant_nodes array<string>, difficulty string"
REPLIES = "id string, question string, with string, without string, tokens_with long, tokens_without long, verdict string, error string"
Provider = Callable[[str], str]


class EvaluationError(ValueError):
    """A question set that can't be used."""


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file: a list of objects, or an object with the list as ``questions``."""
    rows = [r[0] for r in spark.read.text(path, wholetext=True).take(1)]
    try:
        found = json.loads(rows[0]) if rows else None
    except ValueError as e:
        raise EvaluationError(f"{path} is no JSON: {e}") from None
    return questions(spark, found.get("questions") if isinstance(found, dict) else found)


def questions(spark: SparkSession, items: object) -> DataFrame:
    """A question set; ``id``, ``question`` and ``ground_truth`` of each are required."""
    if not isinstance(items, list) or not items:
        raise EvaluationError("there are no questions")
    rows = []
    for n, x in enumerate(items):
        lacks = [k for k in ("id", "question", "ground_truth") if not (isinstance(x, dict) and x.get(k))]
        if lacks:
            raise EvaluationError(f"question {n + 1} lacks {', '.join(lacks)}")
        rows.append((str(x["id"]), str(x["question"]), str(x.get("area", "general")), str(x["ground_truth"]), [str(v) for v in x.get("relevant_nodes") or []], str(x.get("difficulty", "medium"))))
    return spark.createDataFrame(rows, QUESTIONS)


def example_questions(spark: SparkSession) -> DataFrame:
    """Fifteen questions, five to each of three areas, that any code graph can be asked."""
    asked = {
        "structure": ["What are the main modules?", "Which class is depended on most?", "What does the entry point call?", "Which modules import each other?", "Where are the data types defined?"],
        "behaviour": ["How is input read and checked?", "How are errors reported?", "How is state kept between calls?", "How is the result written?", "What happens on a retry?"],
        "change": ["What breaks if the most used function changes?", "Which files does a new field touch?", "Which tests cover the core?", "What can be removed safely?", "Where would a new source be added?"],
    }
    return questions(spark, [{"id": f"{area}-{n}", "question": q, "area": area, "ground_truth": "The nodes of the graph that the answer names, and how they are linked."} for area, qs in asked.items() for n, q in enumerate(qs, 1)])


def answer_prompt(context: str, question: str) -> str:
    return f"Answer from this context of a code base and nothing else.\n\n{context}\n\nQuestion: {question}\n"


def judge_prompt(question: str, truth: str, first: str, second: str) -> str:
    """Asks for two scores; ``parse_verdicts`` reads the reply."""
    return (
        f"Two answers to one question are to be scored from 0 to 1 against what is known to be true.\n\nQuestion: {question}\nTrue: {truth}\n\nAnswer A:\n{first}\n\nAnswer B:\n{second}\n\n"
        'Reply with one JSON object: {"score_a": number, "score_b": number, "reasoning": text}'
    )


def ask(asked: DataFrame, baseline: str, baseline_tokens: int, provider: Provider) -> DataFrame:
    """``REPLIES`` for ``asked`` (id, question, ground_truth, context, tokens): two answers and a verdict each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for id_, question, truth, context, tokens in zip(b["id"], b["question"], b["ground_truth"], b["context"], b["tokens"]):
                got: list[str | None] = [None, None, None]
                error = None
                try:
                    got[0] = provider(answer_prompt(context, question))
                    got[1] = provider(answer_prompt(baseline, question))
                    got[2] = provider(judge_prompt(question, truth, got[0], got[1]))
                except Exception as e:  # whatever a provider raises is that question's result
                    error = f"{type(e).__name__}: {e}"
                rows.append((id_, question, got[0], got[1], int(tokens), baseline_tokens, got[2], error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPLIES.split(", ")])

    return asked.select("id", "question", "ground_truth", "context", "tokens").mapInPandas(run, REPLIES)


def judged(replies: DataFrame) -> DataFrame:
    """``replies`` with both scores; a verdict without two numbers is an error."""
    scores = analytics.parse_verdicts(replies.select("id", F.col("verdict").alias("reply")))
    both = F.col("score_a").isNotNull() & F.col("score_b").isNotNull()
    error = F.coalesce("error", F.when(~both, "the judge gave no two scores"))
    return replies.drop("error").join(scores.join(replies.select("id", "error"), "id"), "id").select(
        "id", "question", F.col("score_a").alias("score_with"), F.col("score_b").alias("score_without"), "tokens_with", "tokens_without", "reasoning", error.alias("error")
    )


def evaluate(asked: DataFrame, baseline: str, baseline_tokens: int, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(a row per question, one row of the whole); the provider is called once for each prompt."""
    from weftgraph.plans.materialize import cut

    rows = judged(cut(ask(asked, baseline, baseline_tokens, provider)))
    return rows, analytics.evaluation(rows)
