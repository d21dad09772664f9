"""Field extraction from documents into JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text patterns of web-page fields; group 1 is the value.
PAGE_FIELDS = {
    "title": "<title>([^<]*)</title>",
    "lang": '<html lang="([^"]*)"',
}

OUTPUT_SCHEMA = "file_name string, json_content string"


def document_extract(
    documents: DataFrame,
    file_name: Column | str,
    content: Column | str,
    fields: Mapping[str, str] = PAGE_FIELDS,
) -> DataFrame:
    """One row per document: its name and a JSON object with the first match of every pattern.

    Whole texts are searched, inside the JVM; a field that is not found is an empty string.
    Documents are independent, so the plan has no shuffle.
    """
    text = (F.col(content) if isinstance(content, str) else content).cast("string")
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    found = [F.regexp_extract(text, pattern, 1).alias(field) for field, pattern in fields.items()]
    return documents.select(name.alias("file_name"), F.to_json(F.struct(*found)).alias("json_content"))


def document_predict(
    documents: DataFrame,
    file_name: str,
    content: str,
    load_model: Callable[[int], Callable[[pd.Series], pd.Series]],
    version: int = 1,
) -> DataFrame:
    """As ``document_extract``, with a trained model.

    ``load_model(version)`` runs once per task and returns a function from a batch of contents to a
    batch of JSON texts.
    """

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model(version)
        for batch in batches:
            yield pd.DataFrame({"file_name": batch["file_name"], "json_content": model(batch["content"])})

    return documents.select(
        F.col(file_name).alias("file_name"), F.col(content).alias("content")
    ).mapInPandas(predict, OUTPUT_SCHEMA)
