"""Mentions from a model's answers: retries, validation as a schema would do it, confidence, evidence offsets."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from savora.functions.text import cleaned, evidence_span
from savora.operators.chunking import chunked
from savora.params import Params

# Allowed sentiments and the widths of stored texts.
SENTIMENTS = ("positive", "neutral", "negative", "mixed")
NAME_MOST, ADDRESS_MOST, SHORT_MOST = 128, 256, 64

MENTION = "shop_name string, address_text string, area string, cuisine string, avg_price double, dishes array<string>, sentiment string, praise array<string>, complaints array<string>, is_recommendation boolean, confidence double, evidence string"
ANSWERS = "chunk_index int, failed boolean, place int, m struct<" + MENTION.replace(" ", ": ").replace(",:", ",") + ">"
_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.MULTILINE)
_TRUE, _FALSE = {"true", "1", "yes", "on", "y", "t"}, {"false", "0", "no", "off", "n", "f"}


def _text(x: object, most: int | None = None) -> str | None:
    if x is not None and not isinstance(x, str):
        raise ValueError("a text is wanted")
    return x if most is None or x is None else x.strip()[:most] or None


def _number(x: object) -> float:
    if isinstance(x, bool | int | float | str):
        return float(x)
    raise ValueError("a number is wanted")


def _flag(x: object) -> bool:
    known = str(x).strip().lower() if isinstance(x, str) else x
    if known in (True, False):
        return bool(known)
    if known in _TRUE or known in _FALSE:
        return known in _TRUE
    raise ValueError("true or false is wanted")


def _words(x: object) -> list[str]:
    """Distinct texts in the order of their first occurrence."""
    if not isinstance(x, list) or any(not isinstance(w, str) for w in x):
        raise ValueError("a list of texts is wanted")
    return list(dict.fromkeys(w for w in (w.strip() for w in x) if w))


def validated(answer: str) -> list[dict]:
    """The mentions of an answer; ValueError if any of them breaks the schema."""
    data = json.loads(_FENCE.sub("", answer.strip()).strip())
    found = data.get("mentions", []) if isinstance(data, dict) else None
    if not isinstance(found, list) or any(not isinstance(m, dict) for m in found):
        raise ValueError("an object with mentions is wanted")
    out = []
    for m in found:
        if not isinstance(m.get("shop_name"), str) or m.get("sentiment", "neutral") not in SENTIMENTS:
            raise ValueError("a name and a known sentiment are wanted")
        sure = _number(m.get("confidence", 0.0))
        out.append(
            {
                "shop_name": m["shop_name"].strip()[:NAME_MOST], "address_text": _text(m.get("address_text"), ADDRESS_MOST), "area": _text(m.get("area"), SHORT_MOST), "cuisine": _text(m.get("cuisine"), SHORT_MOST),
                "avg_price": None if m.get("avg_price") is None else _number(m["avg_price"]), "dishes": _words(m.get("dishes", [])), "sentiment": m.get("sentiment", "neutral"), "praise": _words(m.get("praise_keywords", [])),
                "complaints": _words(m.get("complaints", [])), "is_recommendation": _flag(m.get("is_recommendation", False)), "confidence": 0.0 if math.isnan(sure) else max(0.0, min(1.0, sure)), "evidence": _text(m.get("evidence_span")),
            }
        )
    return out


def answered(chunks: DataFrame, model: Callable[[str], str], id_col: str, tries: int = 3) -> DataFrame:
    """id_col, chunk_index, failed, place, m: a row for each mention, and one for a chunk without any (m null). Blank chunks aren't asked."""
    kind = chunks.schema[id_col].dataType.simpleString()

    def ask(text: str | None) -> list[dict] | None:
        if not (text or "").strip():
            return []
        for _ in range(max(1, tries)):
            try:
                return validated(model(text))
            except ValueError:
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, k, text in zip(batch[id_col], batch["chunk_index"], batch["text"], strict=True):
                found = ask(text)
                rows += [(i, k, found is None, place, m) for place, m in enumerate(found or [None])]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "failed", "place", "m"])

    return chunks.select(id_col, "chunk_index", "text").mapInPandas(run, f"`{id_col}` {kind}, {ANSWERS}")


def located(answers: DataFrame, chunks: DataFrame, id_col: str, least: float | None = None) -> DataFrame:
    """The mentions with their evidence's offsets in the cleaned text; those below a confidence go."""
    met = answers.where("m is not null").join(chunks.select(id_col, "chunk_index", F.col("text").alias("_text"), F.col("start").alias("_start")), [id_col, "chunk_index"])
    span = evidence_span(F.col("_text"), F.col("_start"), F.coalesce(F.col("m.evidence"), F.lit("")))
    rows = met.select(id_col, "chunk_index", "place", "m.*", span["start"].cast("int").alias("evidence_start"), span["end"].cast("int").alias("evidence_end"))
    return rows if least is None else rows.where(F.col("confidence") >= least)


def documents_extracted(docs: DataFrame, model: Callable[[str], str], p: Params, id_col: str, text_col: str, least: float | None = None) -> DataFrame:
    """Extraction without storing: clean, keep the script's texts, chunk, ask; of one name and evidence in a document the first mention stays."""
    clean = docs.select(id_col, cleaned(F.coalesce(F.col(text_col), F.lit("")), p).alias("c")).where("c.in_script and c.text <> ''").select(id_col, F.col("c.text").alias("text"))
    chunks = chunked(clean, id_col, "text", p.max_tokens, p.overlap_tokens)
    found = located(answered(chunks, model, id_col), chunks, id_col, least)
    first = Window.partitionBy(id_col, "shop_name", F.coalesce("evidence", F.lit(""))).orderBy("chunk_index", "place")
    return found.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def mock_model(answers: dict[str, str]) -> Callable[[str], str]:
    """The answer of the first key that a text contains."""
    return lambda text: next((a for k, a in answers.items() if k in text), '{"mentions": []}')
