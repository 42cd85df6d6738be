"""Captured answers of the map's search and of feeds, as Python data sources with a batch and a stream reader.

An archive is a folder of captures, ``capture=<stamp>/...``, whose stamps sort in time. A batch reads
all captures (or those after ``since``); a stream's offset is the last capture that was read, so each
capture is read once, and a restart goes on behind it. The driver lists folders only; the files of a
partition are listed and read by its task, with pyarrow's file systems.

``captured_search``: ``capture=/city=/keyword=/page=`` folders of JSON answers, a partition for each
capture, city and keyword. The pages of a keyword are read in order until one is missing, broken, or
refused, or holds fewer than ``pageSize`` places, or ``maxPages`` are read. A keyword's folder may also
hold its answers as lines of its own files, each the page's number, a tab and the answer, in the order
of pages: a folder for every keyword then, not one for every page. A ``page=`` folder goes before lines.
``captured_feeds``: ``capture=/feed=`` folders of RSS or Atom files, a partition for each of them;
a file that isn't XML is left out.
"""

from __future__ import annotations

import contextlib
import io
import json
import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from datetime import datetime
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from savora.sources.readers import parse_time, since

PLACES = "capture string, city string, keyword string, keyword_at int, page int, at int, poi_id string, name string, address string, area string, lat double, lng double, typecode string, open_hours string"
ENTRIES = "capture string, feed string, at int, title string, link string, summary string, published string"
# The widths of stored texts.
NAME_MOST, ADDRESS_MOST, AREA_MOST, HOURS_MOST = 128, 256, 64, 120


class Part(InputPartition):
    def __init__(self, folder: str, keys: tuple[str, ...], place: int = 0):
        self.folder, self.keys, self.place = folder, keys, place


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9+.-]+://|^file:", path) else (fs.LocalFileSystem(), path)


def _folders(path: str, name: str) -> list[tuple[str, str]]:
    """The folders name=value under a path, with their values, in order."""
    files, at = _opened(path)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    values = [(unquote(x.base_name.removeprefix(f"{name}=")), f"{path}/{x.base_name}") for x in found if x.type == fs.FileType.Directory and x.base_name.startswith(f"{name}=")]
    return sorted(values)


def _contents(folder: str) -> bytes | None:
    """The files of a folder that aren't hidden, one after another; null if there are none."""
    files, at = _opened(folder)
    paths = sorted(x.path for x in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    return b"".join(files.open_input_stream(p).readall() for p in paths) if paths else None


def _lines(folder: str) -> Iterator[bytes]:
    """The lines of a folder's files, read as they are asked for."""
    files, at = _opened(folder)
    paths = sorted(x.path for x in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    for p in paths:
        with io.BufferedReader(files.open_input_file(p)) as lines:
            yield from lines


def _clip(x: object, most: int) -> str | None:
    return x.strip()[:most] or None if isinstance(x, str) else None


def _number(x: str) -> float | None:
    with contextlib.suppress(ValueError):
        return float(x) if math.isfinite(float(x)) else None
    return None


def place_of(raw: dict) -> tuple | None:
    """id, name, address, area, lat, lng, typecode, open hours of a place; null without id or name."""
    poi_id, name = str(raw.get("id") or "").strip(), str(raw.get("name") or "").strip()
    if not poi_id or not name:
        return None
    lng, comma, lat = str(raw.get("location") or "").partition(",")
    more = raw.get("biz_ext") if isinstance(raw.get("biz_ext"), dict) else {}
    hours = _clip(more.get("opentime2"), HOURS_MOST) or _clip(more.get("open_time"), HOURS_MOST)
    kind = raw.get("typecode") if isinstance(raw.get("typecode"), str) else None
    return (poi_id, name[:NAME_MOST], _clip(raw.get("address"), ADDRESS_MOST), _clip(raw.get("adname"), AREA_MOST), _number(lat) if comma else None, _number(lng) if comma else None, kind or None, hours)


def entries_of(body: bytes) -> list[tuple]:
    """title, link, summary, published of RSS items and Atom entries, whatever their namespaces."""
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    out = []
    for item in root.iter():
        if local(item) not in ("item", "entry"):
            continue
        texts: dict[str, str] = {}
        for child in item:
            name = local(child)
            if name == "link":
                value = child.get("href") if child.get("rel") in (None, "alternate") else None
                value = value or (child.text or "").strip()
            else:
                value = "".join(child.itertext()).strip()
            if value:
                texts.setdefault(name, value)
        first = lambda *names: next((texts[n] for n in names if n in texts), None)  # noqa: E731, B023
        out.append((first("title"), first("link"), first("description", "summary", "content"), first("pubDate", "published", "updated")))
    return out


class _Stream(DataSourceStreamReader):
    """Offsets are captures; the first one is empty."""

    def __init__(self, reader: _Reader):
        self.reader = reader

    def initialOffset(self) -> dict:
        return {"capture": ""}

    def latestOffset(self) -> dict:
        return {"capture": max((c for c, _ in _folders(self.reader.path, "capture")), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.reader.parts(start["capture"], end["capture"])

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.reader.read(partition)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.after = options["path"].rstrip("/"), options.get("since", "")
        self.page_size, self.most = int(options.get("pageSize", 20)), int(options.get("maxPages", 25))
        self.keywords = [k.strip() for k in options.get("keywords", "").split(",") if k.strip()]

    def captures(self, after: str, upto: str | None) -> list[tuple[str, str]]:
        return [(c, f) for c, f in _folders(self.path, "capture") if c > after and (upto is None or c <= upto)]

    def partitions(self) -> Sequence[InputPartition]:
        return self.parts(self.after, None)


class _SearchReader(_Reader):
    def parts(self, after: str, upto: str | None) -> list[Part]:
        out = []
        for capture, folder in self.captures(after, upto):
            for city, within in _folders(folder, "city"):
                there = dict(_folders(within, "keyword"))
                wanted = [k for k in self.keywords if k in there] or ([] if self.keywords else list(there))
                out += [Part(there[k], (capture, city, k), place) for place, k in enumerate(wanted)]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        pages = {int(n): f for n, f in _folders(part.folder, "page") if n.isdigit()}
        lines, ahead = _lines(part.folder), None
        for page in range(1, self.most + 1):
            if page in pages:
                body = _contents(pages[page])
            else:
                while ahead is None or ahead[0] < page:  # lines of earlier pages are passed over
                    number, _, answer = next(lines, b"").partition(b"\t")
                    if not number.isdigit():
                        ahead = None
                        break
                    ahead = (int(number), answer)
                body = ahead[1] if ahead and ahead[0] == page else None
            try:
                answer = json.loads(body) if body else None
            except ValueError:
                return
            if not isinstance(answer, dict) or str(answer.get("status")) != "1":
                return
            places = answer.get("pois") or []
            for at, raw in enumerate(places):
                place = place_of(raw) if isinstance(raw, dict) else None
                if place:
                    yield (*part.keys, part.place, page, at, *place)
            if len(places) < self.page_size:
                return


class _FeedReader(_Reader):
    def parts(self, after: str, upto: str | None) -> list[Part]:
        return [Part(f, (capture, feed)) for capture, folder in self.captures(after, upto) for feed, f in _folders(folder, "feed")]

    def read(self, part: Part) -> Iterator[tuple]:
        for at, entry in enumerate(entries_of(_contents(part.folder) or b"")):
            yield (*part.keys, at, *entry)


class _Captured(DataSource):
    READER: type[_Reader]
    SHAPE: str

    def schema(self) -> str:
        return self.SHAPE

    def reader(self, schema) -> DataSourceReader:
        return self.READER(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.READER(self.options))


class CapturedSearch(_Captured):
    READER, SHAPE = _SearchReader, PLACES

    @classmethod
    def name(cls) -> str:
        return "captured_search"


class CapturedFeeds(_Captured):
    READER, SHAPE = _FeedReader, ENTRIES

    @classmethod
    def name(cls) -> str:
        return "captured_feeds"


def register(spark: SparkSession) -> None:
    for source in (CapturedSearch, CapturedFeeds):
        spark.dataSource.register(source)


def places(spark: SparkSession, path: str, stream: bool = False, **options: object) -> DataFrame:
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("captured_search").options(**options)
    return reader.load(path)


def searched(found: DataFrame, most: int | None = None) -> DataFrame:
    """Of each capture and city, every place once, where it came first (by keyword, page, place), and no more than ``most`` of them."""
    order = ("keyword_at", "page", "at")
    once = found.withColumn("_k", F.row_number().over(Window.partitionBy("capture", "city", "poi_id").orderBy(*order))).where("_k = 1").drop("_k")
    if most is None:
        return once
    return once.withColumn("_k", F.row_number().over(Window.partitionBy("capture", "city").orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def entries(spark: SparkSession, path: str, stream: bool = False, **options: object) -> DataFrame:
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("captured_feeds").options(**options)
    return reader.load(path).withColumn("published_at", parse_time(F.col("published")))


def feed_items(found: DataFrame, mark: datetime | None = None, most: int | None = None) -> DataFrame:
    """Entries with a text (the summary, else the title), from the mark on if they are dated, the first ``most`` in the feeds' order."""
    text = F.coalesce("summary", "title")
    rows = found.where(text.isNotNull()).select("capture", "feed", "at", F.col("title").alias("raw_title"), text.alias("raw_text"), F.coalesce("link", "feed").alias("source_url"), "published_at")
    return since(rows, mark, most, ("capture", "feed", "at"))
