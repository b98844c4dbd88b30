"""Text and links of rich-text documents of any depth, kept as JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import fixed

_LINK = re.compile(fixed.HTTP_LINK)
_WEB = ("http://", "https://")


def _pieces(node):
    """Yield ('text', value) and ('link', value) in document order."""
    if isinstance(node, str):
        yield "text", node
        yield from (("link", m) for m in _LINK.findall(node))
    elif isinstance(node, list):
        for child in node:
            yield from _pieces(child)
    elif isinstance(node, dict):
        if isinstance(node.get("text"), str):
            yield from _pieces(node["text"])
        marks = node["marks"] if isinstance(node.get("marks"), list) else []
        holders = [(node, ("href", "url"))]
        holders += [(m, ("href",)) for m in marks if isinstance(m, dict)]
        for holder, names in holders:
            attrs = holder.get("attrs")
            for name in names if isinstance(attrs, dict) else ():
                if isinstance(attrs.get(name), str) and attrs[name].startswith(_WEB):
                    yield "link", attrs[name]
        if isinstance(node.get("content"), list):
            yield from _pieces(node["content"])


def flatten_document(document: str | None) -> tuple[str, list[str]]:
    if document is None:
        return "", []
    try:
        tree = json.loads(document)
    except ValueError:
        tree = document  # plain text
    if not isinstance(tree, (dict, list, str)):
        tree = document
    pieces = list(_pieces(tree))
    words = [v.strip() for kind, v in pieces if kind == "text"]
    links = [v.rstrip(".,);]") for kind, v in pieces if kind == "link"]
    return " ".join(w for w in words if w), list(dict.fromkeys(links))


FLAT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
])


@F.pandas_udf(FLAT)
def flatten_rich_text(documents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([flatten_document(d) for d in documents], columns=["text", "links"])


def text_links(text: Column) -> Column:
    """Distinct links of a plain text in order, trailing punctuation removed."""
    links = F.regexp_extract_all(text, F.lit(fixed.HTTP_LINK), F.lit(0))
    return F.array_distinct(F.transform(links, lambda x: F.rtrim(x, F.lit(".,);]"))))
