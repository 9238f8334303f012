"""Destination paths from templates."""

from __future__ import annotations

import re

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the default template.
DEFAULT = "{categoria}/{ano} - {viagem}/{evento}/{pais}/{regiao}/{cidade}"
LONGEST = 80


def clean(part: Column) -> Column:
    """A name that any file system takes: no forbidden characters, no dots or blanks at its ends, LONGEST characters at most."""
    edges = lambda c: F.regexp_replace(c, r"^[. ]+|[. ]+$", "")
    bare = F.regexp_replace(F.regexp_replace(part, r'[<>:"\\|?*/\x00-\x1f]', "_"), r"[\s\x0b\x1c-\x1f\x85\xa0]+", " ")
    return F.regexp_replace(F.substring(edges(bare), 1, LONGEST), r"[. ]+$", "")


def render(template: str, values: dict[str, Column]) -> Column:
    """Segments whose fields are all empty go, dangling separators are trimmed, and no name comes twice."""
    segments = []
    for segment in template.split("/"):
        pieces = []
        for literal, field in re.findall(r"([^{]*)(?:\{(\w+)\})?", segment):
            if literal:
                pieces.append(F.lit(literal))
            if field:
                pieces.append(F.coalesce(clean(values.get(field, F.lit(None).cast("string"))), F.lit("")))
        joined = F.regexp_replace(F.concat(*pieces), r"^[\s\-_]+|[\s\-_]+$", "") if pieces else F.lit("")
        segments.append(joined)
    parts = F.filter(F.array(*segments), lambda x: x != "")
    plain = lambda x: F.lower(x)
    once = F.filter(parts, lambda x, i: F.array_position(F.transform(parts, plain), plain(x)) == i + 1)
    return F.array_join(once, "/")


class Template:
    """A template's segments, each a list of literals and fields; says the path of one row of values."""

    def __init__(self, text: str):
        self.segments = [re.findall(r"([^{]*)(?:\{(\w+)\})?", s) for s in text.split("/")]
        self.fields = list(dict.fromkeys(f for s in self.segments for _, f in s if f))

    @staticmethod
    def key(text: str) -> str:
        return " ".join(unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().split()).lower()

    @staticmethod
    def name(text: str) -> str:
        text = re.sub(r"\s+", " ", re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", unicodedata.normalize("NFC", text)))
        return text.strip(". ")[:LONGEST].rstrip(". ")

    def path(self, values: dict[str, str | None]) -> str:
        out, above = [], set()
        for segment in self.segments:
            told = {f: v for _, f in segment if f and (v := values.get(f)) and self.key(v) not in above}
            if told or not any(f for _, f in segment):
                text = "".join(literal + told.get(f, "") for literal, f in segment).strip(" -–—_\t\n\r\x0b\x0c")
                if name := self.name(re.sub(r"(\s+[-–—]){2,}\s+", " - ", text)):
                    out.append(name)
                    above |= {k for part in re.split(r"\s+[-–—]\s+", name) if (k := self.key(part))}
        return "/".join(out)


def rendered(rows: DataFrame, template: str, into: str = "destination") -> DataFrame:
    """rows with the path that the template makes of their columns of its fields' names; null where it makes none.

    A value that stands further up the path, by its letters without accents and case, is not said again. Each
    combination of values is rendered once.
    """
    one = Template(template)

    @F.pandas_udf("string")
    def say(values: pd.DataFrame) -> pd.Series:
        return pd.Series([one.path({k: v for k, v in zip(one.fields, row, strict=True) if isinstance(v, str)}) or None for row in values.itertuples(index=False)], dtype=object)

    said = rows.select(*one.fields).distinct().select(F.struct(*(F.col(f).alias(f) for f in one.fields)).alias("_values")).withColumn(into, say("_values"))
    on = [rows[f].eqNullSafe(F.col(f"_values.{f}")) for f in one.fields]
    return rows.join(said, on, "left").drop("_values")
