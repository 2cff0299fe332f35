"""Names, concepts, dates and lenient JSON."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.numbers import once


@F.pandas_udf(T.StringType())
def unaccent_any(texts: pd.Series) -> pd.Series:
    """Any script: compatibility decomposition without combining marks."""
    return texts.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)


def plain_text(text: str) -> str:
    """A Python text without marks: compatibility decomposition, combining marks dropped."""
    return re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", text))


#: Letters of the Latin blocks that decompose into one ASCII letter and marks, and these ASCII letters.
_ACCENTED = {chr(c): p for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block if len(p := plain_text(chr(c))) == 1 and p.isascii()}


def unaccent(text: Column) -> Column:
    """Latin letters without their marks, within the JVM; other scripts need unaccent_any()."""
    plain = F.regexp_replace(F.translate(text, "".join(_ACCENTED), "".join(_ACCENTED.values())), "[\u0300-\u036f]", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(plain)  # ASCII has no marks


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def concept(text: Column) -> Column:
    return F.nullif(_spaces(F.upper(unaccent(_strip(text)))), F.lit(""))


def rule_text(text: Column) -> Column:
    return _strip(_spaces(F.lower(unaccent(F.coalesce(text, F.lit(""))))))


def company(text: Column) -> Column:
    """Legal suffixes and closing punctuation go, up to four of them; words are capitalised."""
    out = _strip(text)
    for _ in range(4):
        out = F.regexp_replace(out, r"(?iU)[\s,]+(s\.?\s?a\.?\s?u|s\.?\s?l\.?\s?u|s\.?\s?a|s\.?\s?l|epel|sarl|sucursal en españa)\.?$", "")
        out = F.regexp_replace(out, r"(?U)[\s,.;:\-]+$", "")
    return F.nullif(_spaces(F.initcap(F.lower(unaccent(out)))), F.lit(""))


#: Months by their first three letters, in Spanish and English.
MONTHS = {"ene": 1, "jan": 1, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "aug": 8, "sep": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12, "dec": 12}


def date(text: Column) -> Column:
    """ISO, then numeric d/m/y, then d month y; the first form that matches decides, an invalid date is NULL."""
    return once(F.regexp_replace(F.lower(unaccent(_strip(text))), "0ct", "oct"), _date)


def _date(t: Column) -> Column:
    iso, numeric, words = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{1,2})[/\-. ](\d{1,2})[/\-. ](\d{4}|\d{2})(?!\d)", r"(\d{1,2})[/\-. ]+(?:de )?([a-z]{3})[a-z]*[.,]?[/\-. ]+(?:de )?(\d{4}|\d{2})(?!\d)"
    month = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])

    def built(y: Column, m: Column, d: Column) -> Column:
        full = F.when(F.length(y) == 2, F.concat(F.when(y.try_cast("int") <= 69, F.lit("20")).otherwise(F.lit("19")), y)).otherwise(y)
        return F.try_to_date(F.concat_ws("-", full, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    part = lambda p, i: F.regexp_extract(t, p, i)
    return (
        F.when(t.rlike(iso), built(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(numeric), built(part(numeric, 3), part(numeric, 2), part(numeric, 1)))
        .when(t.rlike(words), built(part(words, 3), F.try_element_at(month, part(words, 2)), part(words, 1)))
    )


def form_company(text: Column) -> Column:
    """The company of a review form: without accents, single spaces, every run of letters capitalised (also after marks, as in ``O'Neil & Co-Op``)."""
    plain = _strip(_spaces(unaccent(text)))
    runs = F.regexp_extract_all(plain, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.nullif(F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), ""), F.lit(""))


def strict_date(text: Column) -> Column:
    """yyyy-MM-dd only; anything else is NULL."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


#: Spanish month names of the review form and their short forms.
FORM_MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "sep": 9, "sept": 9, "set": 9, "oct": 10, "nov": 11, "dic": 12,
}


def form_date(text: Column) -> Column:
    """struct<fecha, corregida>: ISO, day/month/year or day-month-year with 4 or 2 digits of the year, else ``d (de) month (de) yyyy``; ``corregida``
    tells that it was read from another form than ISO. NULL and false where nothing fits."""
    t = _strip(text)
    numeric = F.regexp_extract_all(t, F.lit(r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$"), F.lit(0))
    part = lambda i: F.regexp_extract(t, r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$", i)
    year = F.when(F.length(part(4)) == 2, F.concat(F.when(part(4).try_cast("int") < 69, F.lit("20")).otherwise(F.lit("19")), part(4))).otherwise(part(4))
    said = F.split(_strip(_spaces(F.replace(F.replace(F.lower(t), F.lit("."), F.lit("")), F.lit("de"), F.lit(" ")))), " ")
    # "de" also goes within words, so a month is known by what is left of its name.
    known = F.create_map(*[F.lit(x) for k, v in FORM_MONTHS.items() for x in (k, v)])
    word = lambda i: F.try_element_at(said, F.lit(i))
    built = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    iso = F.try_to_date(F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t), "yyyy-M-d")
    month = F.try_element_at(known, word(2)).cast("string")
    other = F.when(F.size(numeric) > 0, built(year, part(3), part(1))).when(month.isNotNull() & word(1).rlike(r"^\d{1,2}$") & word(3).rlike(r"^\d{4}$"), built(word(3), month, word(1)))
    return F.struct(F.coalesce(iso, other).alias("fecha"), (iso.isNull() & other.isNotNull()).alias("corregida"))


def safe_json(text: Column) -> Column:
    """The text where it is JSON, else the text as a JSON string; NULL stays NULL."""
    made = F.to_json(F.struct(text.alias("v")))  # {"v":"..."}
    return F.when(F.try_parse_json(text).isNotNull(), text).when(text.isNotNull(), made.substr(F.lit(6), F.length(made) - 6))


def wrapped_json(text: Column) -> Column:
    """The text where it is JSON, else ``{"valor": text}``."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.to_json(F.struct(text.alias("valor"))))


def python_literal_json(text: Column) -> Column:
    """JSON from the text of a Python literal or of JSON: ``{"valor": "..."}`` is unwrapped, ``Decimal('1.2')`` becomes 1.2, single quotes, None, True and
    False become JSON's. What is neither becomes ``{"valor": text}``; blank texts are NULL. Quotes inside a string are read as far as the reader of single quotes goes."""
    inner = lambda t: once(F.json_object_keys(t), lambda keys: F.when((F.size(keys) == 1) & (keys[0] == "valor"), F.coalesce(F.get_json_object(t, "$.valor"), t)).otherwise(t))
    return once(F.nullif(_strip(text), F.lit("")), lambda t: once(inner(t), lambda i: F.when(t.isNotNull(), F.when(F.try_parse_json(i).isNotNull(), i).otherwise(_from_literal(i)))))


def _from_literal(inner: Column) -> Column:
    numbers = F.regexp_replace(inner, r"Decimal\(\s*['\"]([+-]?\d+(?:\.\d+)?)['\"]\s*\)", "$1")
    # A string literal is put aside whole, so words inside it stay as they are.
    piece = F.regexp_extract_all(numbers, F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+|['"]"""), F.lit(0))
    bare = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    quoted = lambda p: F.concat(F.lit('"'), F.replace(F.replace(p.substr(F.lit(2), F.length(p) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    made = F.array_join(F.transform(piece, lambda p: F.when(p.startswith("'") & p.endswith("'") & (F.length(p) > 1), quoted(p)).when(p.startswith('"'), p).otherwise(bare(p))), "")
    return once(made, lambda m: F.when(F.try_parse_json(m).isNotNull(), m).otherwise(F.to_json(F.struct(inner.alias("valor")))))


def warnings_list(text: Column) -> Column:
    """array<string> of a warnings column whatever its shape: a JSON list, an object with ``avisos`` (a list or one value), another JSON value or no JSON at all."""
    v = F.try_parse_json(text)
    as_list = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.try_variant_get(v, "$.avisos", "array<string>"))
    one = F.try_variant_get(v, "$.avisos", "string")
    whole = F.when(F.json_object_keys(text).isNotNull(), F.array().cast("array<string>")).otherwise(F.array(F.coalesce(F.try_variant_get(v, "$", "string"), text)))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(as_list, F.when(one.isNotNull(), F.array(one)), whole))


def outside_json(text: Column) -> Column:
    """What follows the last closing brace; the whole text if there is none."""
    return F.trim(F.substring_index(text, "}", -1))


def clean_file_name(path: Column) -> Column:
    """struct<nombre, aviso>: the last part of a path without control characters; the warning tells that something was dropped."""
    last = F.regexp_extract(path, r"([^/\\\\]*)$", 1)
    name = F.regexp_replace(last, r"[\x00-\x1f\x7f]", "")
    return F.struct(name.alias("nombre"), F.when(name != path, F.lit("nombre_saneado")).alias("aviso"))


def concept_spaces(text: Column) -> Column:
    """Runs of white space, also of no-break spaces, as one space; none at the ends."""
    return _strip(_spaces(F.replace(text, F.lit("\u00a0"), F.lit(" "))))


def lenient_json(text: Column) -> Column:
    """The JSON object in a model's answer: a fenced block, the whole text, or from the first to the last brace; NULL if none parses."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.try_element_at(F.filter(F.array(fenced, text, inner), lambda c: F.json_object_keys(c).isNotNull()), F.lit(1))


def json_error(text: Column) -> Column:
    """Why lenient_json() finds no object: ``texto_vacio``, ``raiz_no_es_objeto`` (other JSON), ``sin_bloque`` (no braces) or ``no_parseable``; NULL where it finds one."""
    fenced = F.nullif(F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)), F.lit(""))
    body = F.coalesce(fenced, F.trim(text))
    kind = F.schema_of_variant(F.try_parse_json(body))
    braces = (F.instr(body, "{") > 0) & (F.length(F.substring_index(body, "}", -1)) < F.length(body)) & body.rlike(r"(?s)\{.*\}")
    why = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "texto_vacio").when(kind.isNotNull(), "raiz_no_es_objeto").when(~braces, "sin_bloque").otherwise("no_parseable")
    return F.when(lenient_json(text).isNull(), why)


def _balanced(text: str | None) -> list[str] | None:
    if text is None:
        return None
    at = np.array([m.start() for m in re.finditer(r"[{}]", text)], dtype=np.int64)
    step = np.array([1 if text[i] == "{" else -1 for i in at], dtype=np.int64)
    run = np.cumsum(step)
    depth = run - np.minimum(0, np.minimum.accumulate(run)) if len(run) else run  # a closing brace at depth 0 counts for nothing
    opens, closes = at[(step > 0) & (depth == 1)], at[(step < 0) & (depth == 0) & (np.concatenate([[0], depth[:-1]]) == 1)]
    return sorted((text[a : b + 1] for a, b in zip(opens, closes)), key=len, reverse=True)  # an open last block has no end


@F.pandas_udf(T.ArrayType(T.StringType()))
def balanced_blocks(texts: pd.Series) -> pd.Series:
    """All outermost balanced {...} blocks, longest first (equal lengths in the order of the text); NULL for NULL. Linear in the text."""
    return texts.map(_balanced)


def best_balanced_block(text: Column) -> Column:
    """The longest balanced block; NULL if there is none."""
    return F.try_element_at(balanced_blocks(text), F.lit(1))


def truncated(text: Column) -> Column:
    """Whether an answer looks cut off: no closing brace, unbalanced braces or an odd number of quotes."""
    n = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return ~F.rtrim(text).endswith("}") | (n("{") != n("}")) | (n('"') % 2 != 0)
