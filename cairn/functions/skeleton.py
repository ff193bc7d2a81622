"""The shape of a JSON document as (json_path, type) rows.

Two levels deep; of a list the first element only; a map whose keys are all UUIDs, and whose values have one shape, is
one entry. The shape of a corpus of documents is a table, so comparing two is a join (J2, J3).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UUID = re.compile("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NAMES = {bool: "bool", int: "int", float: "float", str: "str", list: "list", dict: "dict", type(None): "null"}


def shape(document: dict, depth: int = 2, at: str = "") -> list[tuple[str, str]]:
    """Rows of a document's shape, by path."""
    values = list(document.values())
    if document and all(_UUID.fullmatch(k) for k in document) and all(isinstance(v, dict) for v in values):
        inner = [shape(v, depth - 1, f"{at}/<uuid>") if depth else [(f"{at}/<uuid>", "dict")] for v in values]
        if all(x == inner[0] for x in inner):
            return inner[0] or [(f"{at}/<uuid>", "dict")]
    rows = []
    for key in sorted(document):
        v, path = document[key], f"{at}/{key}"
        if depth and isinstance(v, dict):
            rows += shape(v, depth - 1, path) or [(path, "dict")]
        elif depth and isinstance(v, list) and v and isinstance(v[0], dict):
            rows += shape(v[0], depth - 1, f"{path}[]") or [(f"{path}[]", "dict")]
        else:
            rows.append((path, _NAMES[type(v)]))
    return rows


def shapes(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, json_path, type) of each document; text that is no JSON object has the one row ('', 'invalid')."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text]):
                try:
                    d = json.loads(t)
                    rows = shape(d) if isinstance(d, dict) else [("", "invalid")]
                except (TypeError, ValueError):
                    rows = [("", "invalid")]
                out += [(k, p, y) for p, y in rows]
            yield pd.DataFrame(out, columns=[key, "json_path", "type"])

    return documents.select(key, text).mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, json_path string, type string")


def fingerprint(rows: DataFrame) -> DataFrame:
    """The distinct shapes over all documents, with the number of documents that have each."""
    return rows.groupBy("json_path", "type").agg(F.count(F.lit(1)).alias("documents"))
