"""Remote suggestions without the remote: prompts, answers, guards and the queue of pending ones."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions.rewrite import review_key
from quillon.operators.index import top_k


class Suggester(Protocol):
    """Answers a prompt with a text that should hold a JSON object; None if it has no answer."""

    def __call__(self, prompt: str) -> str | None: ...


def first_candidate(prompt: str) -> str | None:
    """A stand-in that needs no network: the first candidate of the prompt's table."""
    for line in prompt.splitlines():
        cells = line.split("\t")
        if len(cells) == 3 and cells[0] != "code":
            return json.dumps({"code": cells[0], "confidence": 0.5})
    return None


def prompts(candidates: DataFrame, query: str = "qid", text: str = "query", code: str = "code", description: str = "description", modality: str = "modality", most: int = 50) -> DataFrame:
    """(qid, prompt): the description to match and a table of at most ``most`` candidates."""
    some = top_k(candidates, query, [F.asc(code)], most)
    line = F.concat_ws("\t", code, description, F.coalesce(modality, F.lit("")))
    rows = some.groupBy(query, text).agg(F.array_sort(F.collect_list(F.struct(F.col(code).alias("c"), line.alias("l")))).alias("ls"))
    table = F.array_join(F.transform("ls", lambda x: x["l"]), "\n")
    head = F.concat(F.lit("Pick the catalog row that fits.\nDescription: "), F.col(text), F.lit('\nAnswer {"code": ..., "confidence": 0..1}.\ncode\tdescription\tmodality\n'))
    return rows.select(query, F.concat(head, table).alias("prompt"))


def ask(rows: DataFrame, suggester: Suggester = first_candidate, query: str = "qid") -> DataFrame:
    """(qid, answer) of each prompt."""
    kind = rows.schema[query].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({query: b[query], "answer": b["prompt"].map(suggester)})

    return rows.select(query, "prompt").mapInPandas(run, f"{query} {kind}, answer string")


def balanced_object(text: str | None) -> str | None:
    """The first balanced ``{...}`` of a text; braces inside JSON strings don't count."""
    depth, start, quoted, skip = 0, -1, False, False
    for i, c in enumerate(text or ""):
        if skip:
            skip = False
        elif start >= 0 and quoted:
            skip, quoted = c == "\\", c != '"'
        elif start >= 0 and c == '"':
            quoted = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    return texts.map(balanced_object)


def read_answer(answer: Column) -> Column:
    """(code, description, confidence) of a JSON object; the confidence is 0.5 if missing."""
    got = F.from_json(answer, "code string, description string, confidence double")
    return F.struct(got["code"].alias("code"), got["description"].alias("description"), F.coalesce(got["confidence"], F.lit(0.5)).alias("confidence"))


def guarded(suggestions: DataFrame, candidates: DataFrame, code: str = "code", query: str = "qid", modality: str | None = None) -> DataFrame:
    """Suggestions of a real code among the query's own candidates.

    With ``modality``, a column of both tables: a query that has one takes only codes that share it.
    """
    named = suggestions.filter(F.coalesce(F.upper(code), F.lit("UNCLASSIFIED")) != "UNCLASSIFIED")
    if modality is None:
        return named.join(candidates.select(query, code), [query, code], "left_semi")
    own = candidates.select(F.col(query).alias("__q"), F.col(code).alias("__c"), F.col(modality).alias("__m"))
    fits = (F.col(query) == F.col("__q")) & (F.col(code) == F.col("__c")) & (F.col(modality).isNull() | (F.col(modality) == F.col("__m")))
    return named.join(own, fits, "left_semi")


def enqueue(pending: DataFrame, new: DataFrame, order: str = "created_at") -> DataFrame:
    """Pending suggestions and new ones; of a query's, the first counts."""
    from quillon.operators.tables import append_absent

    first = top_k(new.withColumn("__key", review_key(F.col("query"))), "__key", [F.asc(order)], 1).drop("rank", "__key")
    return append_absent(pending, first, [review_key(F.col("query"))])


def agree(pending: DataFrame, ids: list) -> tuple[DataFrame, DataFrame]:
    """(still pending, mappings to add): every row of an agreed query leaves the queue."""
    keyed = pending.withColumn("__key", review_key(F.col("query")))
    chosen = keyed.filter(F.col("id").isin(ids))
    first = top_k(chosen, "__key", [F.asc("id")], 1)
    return keyed.join(chosen.select("__key"), "__key", "left_anti").drop("__key"), first.select("query", F.col("suggested_code").alias("code"))


def disagree(pending: DataFrame, ids: list) -> DataFrame:
    return agree(pending, ids)[0]
