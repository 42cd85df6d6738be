"""Upserts: run, crash and rerun give one state; fingerprints rebuild; extraction and map places end to end."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from savora.operators import ingest
from savora.operators.extraction import documents_extracted, mock_model, validated
from savora.params import Params

P = Params(script_class="a-zA-Z", max_tokens=12)
NOW = datetime(2026, 5, 1)
SHAPE = "source string, raw_text string, seq long, raw_title string, published_at timestamp, city_hint string"
TEXT = "The noodles at Ming are good!\nGo early!\nThe queue is long!\nAsk for the old sauce!"


def contents(store):
    return {r.raw_text: r for r in store.read("contents").collect()}


def state(store):
    return {t: sorted(map(str, store.read(t).drop("crawled_at").collect())) for t in store.tables}


def batch(spark, *rows):
    return spark.createDataFrame(rows, SHAPE)


def test_run_crash_rerun(spark, tmp_path):
    rows = [batch(spark, ("forum", TEXT, 1, None, None, "x" * 80), ("forum", TEXT, 2, "later title", NOW, None), ("blog", TEXT, 3, None, None, ""), ("forum", "12345 67", 4, None, None, None), ("forum", None, 5, None, None, None)), batch(spark, ("forum", TEXT, 9, "", None, "Rome"), ("forum", "Other words here.", 10, None, None, None))]
    clean, torn = (ingest.content_store(spark, f"{tmp_path}/{n}", 4) for n in ("clean", "torn"))
    for k, r in enumerate(rows):
        clean.sink("feed", ingest.ingested(P, now=NOW))(r, k)
    sink, fails = torn.sink("feed", ingest.ingested(P, now=NOW)), [True]
    made = spark.createDataFrame

    def breaking(data, schema=None, *more):
        if schema is not None and "writer string" in str(schema) and data and fails:
            fails.pop()
            raise OSError("lost before the log entry")
        return made(data, schema, *more)

    torn.spark = type("Session", (), {"createDataFrame": staticmethod(breaking), "read": property(lambda self: spark.read), "conf": spark.conf, "sparkContext": spark.sparkContext})()
    with pytest.raises(OSError):
        sink(rows[0], 0)
    assert torn.read("contents").count() == 0  # files without a log entry are never read
    for k in (0, 0, 1, 0, 1):  # tried again, and delivered again
        sink(rows[k], k)
    assert state(clean) == state(torn) and len(state(clean)["contents"]) == 4
    got = {(r.source, r.raw_text): r for r in clean.read("contents").collect()}[("forum", TEXT)]
    assert (got.raw_title, got.published_at, got.city_hint, got.status) == ("later title", NOW, "Rome", "cleaned")
    assert got.chunk_count == clean.read("chunks").where(F.col("content_key") == got.content_key).count() > 1
    for r in clean.read("chunks").where(F.col("content_key") == got.content_key).collect():
        assert got.clean_text[r.start : r.end] == r.text
    assert contents(clean)["12345 67"].chunk_count == 0 and not contents(clean)["12345 67"].in_script


def answer(*mentions):
    return json.dumps({"mentions": list(mentions)})


def test_extraction_survives_a_second_delivery_but_not_a_new_fingerprint(spark, tmp_path):
    store = ingest.content_store(spark, str(tmp_path / "s"), 4)
    rows = batch(spark, ("forum", TEXT, 1, None, None, None), ("forum", "Broken answers only.", 2, None, None, None), ("forum", "99 88 77", 3, None, None, None))
    store.sink("feed", ingest.ingested(P, now=NOW))(rows, 0)
    model = mock_model({"noodles": "```json\n" + answer({"shop_name": " Ming ", "confidence": "1.7", "evidence_span": "noodles at Ming", "praise_keywords": ["good", " good", ""]}, {"shop_name": "Low", "confidence": 0.1}) + "\n```", "Broken": answer({"shop_name": "X", "sentiment": "great"})})
    for _ in range(2):
        ingest.extract_pending(store, 0, model, least=0.6)
    found = store.read("mentions").collect()
    assert [(m.shop_name, m.confidence, m.praise, m.sentiment) for m in found] == [("Ming", 1.0, ["good"], "neutral")]
    text = contents(store)[TEXT].clean_text
    assert text[found[0].evidence_start : found[0].evidence_end] == "noodles at Ming"
    assert {k: r.status for k, r in contents(store).items()} == {TEXT: "extracted", "Broken answers only.": "failed", "99 88 77": "cleaned"}
    store.sink("feed", ingest.ingested(P, now=NOW))(rows.where("seq <> 2"), 1)
    assert contents(store)[TEXT].status == "extracted" and store.read("mentions").count() == 1
    store.sink("feed", ingest.ingested(P, fingerprint="other", now=NOW))(rows, 2)
    assert {r.status for r in contents(store).values()} == {"cleaned"} and store.read("mentions").count() == 0


def test_validation():
    assert validated(answer({"shop_name": "a" * 200}))[0]["shop_name"] == "a" * 128
    assert validated(answer({"shop_name": "a", "avg_price": "12.5", "is_recommendation": "yes", "address_text": "  "}))[0] | {} == {
        "shop_name": "a", "address_text": None, "area": None, "cuisine": None, "avg_price": 12.5, "dishes": [], "sentiment": "neutral", "praise": [], "complaints": [], "is_recommendation": True, "confidence": 0.0, "evidence": None,
    }
    for bad in ("[]", "no", answer({"shop_name": None}), answer({"shop_name": "a", "sentiment": "bad"}), answer({"shop_name": "a", "dishes": "soup"}), answer({"shop_name": "a", "confidence": "high"}), '{"mentions": {}}'):
        with pytest.raises(ValueError):
            validated(bad)


def test_documents_extracted(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "12 34"), (3, None)], "doc_id long, text string")
    model = lambda text: answer({"shop_name": "Ming", "evidence_span": "x", "confidence": 0.9})
    got = documents_extracted(docs, model, P, "doc_id", "text").collect()
    assert [(r.doc_id, r.shop_name, r.evidence_start) for r in got] == [(1, "Ming", None)]


PLACE = "city string, poi_id string, name string, seq long, address string, area string, lat double, lng double, open_hours string"


def place(seq, poi, name, address=None, hours=None, city="c"):
    return (city, poi, name, seq, address, None, None, None, hours)


def test_places(spark, tmp_path):
    store = ingest.shop_store(spark, str(tmp_path / "p"), 4)
    sink = store.sink("map", ingest.places_upserted(P, NOW))
    first = spark.createDataFrame([place(1, "a", "Ming", None, "9-5"), place(2, "b", "Ming", "Lane 2"), place(3, "b", "Ming North"), place(4, "d", "Solo", "Lane 4"), place(5, None, "None"), place(6, "e", " "), place(7, "a", "Ming", city="other")], PLACE)
    for _ in range(2):
        sink(first, 0)
    shops = {(r.city, r.name): r for r in store.read("shops").collect()}
    assert set(shops) == {("c", "Ming"), ("c", "Solo"), ("other", "Ming")}
    ming = shops["c", "Ming"]
    assert (ming.poi_id, ming.address, ming.open_hours, ming.last_seen_at) == ("b", "Lane 2", "9-5", NOW)
    assert [(r.alias, r.shop_key) for r in store.read("aliases").collect()] == [("Ming North", ming.shop_key)]
    sink(spark.createDataFrame([place(1, "b", "Ming Grand", "Lane 9", "10-6"), place(2, "d", "Solo")], PLACE), 1)
    again = {(r.city, r.name): r for r in store.read("shops").collect()}
    assert (again["c", "Ming"].address, again["c", "Ming"].open_hours) == ("Lane 2", "10-6") and len(again) == 3
    assert sorted(r.alias for r in store.read("aliases").collect()) == ["Ming Grand", "Ming North"]


def test_a_text_is_cleaned_and_cut_once(spark, tmp_path):
    """Cleaning runs in the one step that writes the working table; contents, chunks and counts are read from there."""
    rows = batch(spark, *[("forum", f"{TEXT} {k}", k, None, None, None) for k in range(20)])
    store = ingest.content_store(spark, str(tmp_path / "s"), 4)
    buckets, out = ingest.ingested(P, now=NOW)(store, rows)
    assert buckets == store.touched(out["contents"])
    for name in ("contents", "chunks"):
        plan = out[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and "Python" not in plan and "MapInPandas" not in plan
    counts = {r.content_key: r["count"] for r in out["chunks"].groupBy("content_key").count().collect()}
    assert {r.content_key: r.chunk_count for r in out["contents"].collect()} == counts and len(counts) == 20
