"""JSON values of any shape: empty ones taken out at any depth, and values written as Python literals. Texts go through Arrow batches."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of a document that stay even where they are empty.
REQUIRED = ("empresa", "fecha", "items", "totales")
CLEANED = T.StructType([T.StructField("documento", T.StringType()), T.StructField("avisos", T.ArrayType(T.StringType()))])


def written(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def without_empty(value, path: str, said: list[str], keep: tuple[str, ...] = ()):
    """The value without blank texts, empty lists and empty objects, and without what is empty then; None if nothing is left. ``said`` gets the path
    of every blank text. Keys to keep stay with what they had become."""
    if isinstance(value, str):
        if value.strip():
            return value
        said.append(f"CAMPO_ELIMINADO_VACIO:{path}")
        return None
    if isinstance(value, list):
        return [x for i, v in enumerate(value) if (x := without_empty(v, f"{path}[{i}]", said, keep)) is not None] or None
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            x = without_empty(v, f"{path}.{k}" if path else k, said, keep)
            if x is not None:
                out[k] = x
            elif k in keep:
                out[k] = type(v)() if isinstance(v, (list, dict)) else v
        return out or None
    return value


def clean(text: Column, keep: tuple[str, ...] = ()) -> Column:
    """struct<documento, avisos> of a JSON text: without_empty() at any depth. A text that is no JSON has NULL and ``JSON_INVALIDO``; what is empty as a whole has NULL."""

    @F.pandas_udf(CLEANED)
    def work(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            said: list[str] = []
            try:
                value = None if t is None else without_empty(json.loads(t), "", said, keep)
            except (ValueError, RecursionError):
                value, said = None, ["JSON_INVALIDO"]
            rows.append((None if value is None else written(value), said))
        return pd.DataFrame(rows, columns=["documento", "avisos"])

    return work(text)


_DECIMAL = re.compile(r"Decimal\(\s*['\"]([+-]?[0-9]+(?:\.[0-9]+)?)['\"]\s*\)")
#: Texts longer than this are no literals of a review form; reading them is not tried.
LONGEST_LITERAL = 1_000_000


def plain_value(value):
    """A Python value as JSON has it: tuples and sets (in order of their texts) are lists, bytes are text, other keys than texts are their text."""
    if isinstance(value, dict):
        return {k if isinstance(k, str) else written(plain_value(k)): plain_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain_value(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((plain_value(v) for v in value), key=written)
    if isinstance(value, bytes):
        return value.decode("utf-8", "ignore")
    if value is Ellipsis or isinstance(value, complex) or isinstance(value, float) and value in (float("inf"), float("-inf")):
        return str(value)
    return value


def literal_value(text: str):
    """What a text means: JSON, else a Python literal (also of decimals), else ``{"valor": text}``; ``{"valor": text}`` is read for its text. None if blank."""
    text = text.strip()
    try:
        value = json.loads(text)
        if not (isinstance(value, dict) and value.keys() == {"valor"} and isinstance(value["valor"], str)):
            return value
        text = value["valor"].strip()
    except (ValueError, RecursionError):
        pass
    if not text:
        return None
    bare = _DECIMAL.sub(r"\1", text)
    try:
        return plain_value(ast.literal_eval(bare)) if len(bare) <= LONGEST_LITERAL else {"valor": bare}
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return {"valor": bare}


@F.pandas_udf(T.StringType())
def _literal_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None or (v := literal_value(t)) is None else written(v)).astype(object)


def literal_json(text: Column) -> Column:
    """JSON of a text that is JSON or a Python literal of any kind: nested, with tuples, sets, bytes, escapes and decimals. Only what is not JSON already leaves the JVM."""
    keys = F.json_object_keys(text)
    wrapped = F.coalesce((F.size(keys) == 1) & (keys[0] == "valor"), F.lit(False))
    # Spark's parsers stop behind the first value, so the text is read as the first of two values; the second is found only if nothing else stands between.
    end = F.xxhash64(text)
    is_json = F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), end.cast("string"), F.lit("]"))), "$[1]", "long") == end, F.lit(False)) & ~wrapped
    return F.when(F.trim(text) == "", F.lit(None)).when(is_json, text).otherwise(_literal_json(F.when(~is_json, text)))
