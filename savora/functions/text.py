"""Column functions of the text pipeline. All stay in the JVM but those marked as needing Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from savora.functions.similarity import matching_ratios
from savora.params import Params

FULL = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0x3000]))
HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz "
CJK = r"一-鿿"

# The patterns of the cleaning steps, in order, with their replacements.
DENOISE = (
    (r"(?is)<(script|style)[^>]*>.*?</\1>", " "),
    (r"<[^>]+>", " "),
    (r"(?iU)(https?://|www\.)\S+", " "),
    (r"(点击|戳)[^，。！？\n]{0,8}(查看|阅读)(全文|原文)", " "),
    (r"(展开|收起)全文", " "),
    (r"扫码(关注|点餐|下单)", " "),
    (r"关注(公众)?号", " "),
    (r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F0FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]+", " "),
    (r"[\u200b-\u200f\ufeff]", ""),
)
TIDY = (
    (r"[ \t]{2,}", " "),
    (rf"(?<=[{CJK}])[ \t]+(?=[{CJK}])", ""),
    (r"[ \t]+(?=[，。！？；：、）】」』])", ""),
    (r"\n{3,}", "\n\n"),
)
CURRENCY = (
    (r"(?U)[￥¥]\s*(\d+(?:\.\d+)?)", "$1 元"),
    (r"(?U)(?:RMB|rmb)\s*(\d+(?:\.\d+)?)", "$1 元"),
    (r"(?U)(\d+(?:\.\d+)?)\s*(?:块钱|块|人民币|RMB|rmb|元)", "$1 元"),
)
#: What a text must hold for a pattern to match at all: one of these; None: a character beyond ASCII. Other texts pass unread.
NEEDED: dict[str, tuple[str, ...] | None] = dict(zip((p for p, _ in (*DENOISE, *TIDY, *CURRENCY)), (
    ("<",), ("<",), ("://", "ww", "wW", "Ww", "WW"), ("全文", "原文"), ("全文",), ("扫码",), ("关注",), None, ("\u200b", "\u200c", "\u200d", "\u200e", "\u200f", "\ufeff"),
    ("  ", " \t", "\t ", "\t\t"), None, tuple("，。！？；：、）】」』"), ("\n\n\n",),
    ("￥", "¥"), ("RMB", "rmb"), ("块", "人民币", "RMB", "rmb", "元"),
), strict=True))
BRACKETED = r"[（(【\[][^）)】\]]*[）)】\]]"
ADDRESS_SPLIT = r"(?U)[\s,，。.、;；:：/\\\-—()（）【】\[\]]+"
SENTENCE = r"[^。！？!?；;\n]+[。！？!?；;]?"
OPEN_RANGE = r"(\d{1,2})[:：](\d{2})\s*[-–—~至]\s*(\d{1,2})[:：](\d{2})"


def where_needed(text: Column, change: Callable[[Column], Column], needed: tuple[str, ...] | None) -> Column:
    """change(text) where the text holds one of the needed strings (None: a character beyond ASCII), else the text; the text is bound once."""
    holds = (lambda t: F.octet_length(t) > F.char_length(t)) if needed is None else (lambda t: contains_any(t, needed))
    return F.element_at(F.transform(F.array(text), lambda t: F.when(holds(t), change(t)).otherwise(t)), 1)


def replaced(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        change = lambda t, pattern=pattern, to=to: F.regexp_replace(t, F.lit(pattern), F.lit(to))
        text = where_needed(text, change, NEEDED[pattern]) if pattern in NEEDED else change(text)
    return text


def strip(text: Column) -> Column:
    """Removes all Unicode white space at both ends (Spark's trim knows the blank only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clip(text: Column, n: int) -> Column:
    """Stripped, cut to n characters, null when nothing is left."""
    cut = F.substring(strip(text), 1, n)
    return F.when(cut != "", cut)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def saturate(x: Column, target: float) -> Column:
    return F.when(x > 0, 1.0).otherwise(0.0) if target <= 0 else clamp01(x / F.lit(float(target)))


def to_half_width(text: Column) -> Column:
    return F.translate(text, FULL, HALF)


def simplified(text: Column, pairs: tuple[str, str] | None = None) -> Column:
    """Traditional to simplified characters by a table (from, to); none by default. Phrase-aware conversion needs a converter that isn't installed."""
    return F.translate(text, *pairs) if pairs else text


def denoise(text: Column) -> Column:
    return replaced(where_needed(replaced(text, DENOISE), to_half_width, None), TIDY)


def currency(text: Column) -> Column:
    return replaced(text, CURRENCY)


def script_ratio(text: Column, script_class: str) -> Column:
    """Share of the characters of a script among all that aren't white space; 0 without any."""
    kept = F.char_length(F.regexp_replace(text, rf"[^{script_class}]", ""))
    solid = F.char_length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.when(solid > 0, kept / solid).otherwise(0.0)


def word_hits(text: Column, words: Sequence[str]) -> Column:
    """The words that occur, in the list's order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.array().cast("array<string>")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def count_hits(text: Column, words: Sequence[str]) -> Column:
    """Occurrences of all words, each counted for itself without overlaps."""
    total = F.lit(0)
    for w in words:
        total = total + (F.char_length(text) - F.char_length(F.replace(text, F.lit(w), F.lit("")))) / F.lit(len(w))
    return total.cast("long")


def cleaned(raw: Column, p: Params) -> Column:
    """struct: text, in_script, low_trust, ad_hits."""
    text = F.when(strip(raw) != "", strip(where_needed(currency(simplified(denoise(raw))), lambda t: F.regexp_replace(t, r"[ \t]+\n", "\n"), (" \n", "\t\n")))).otherwise("")

    def judged(text: Column) -> Column:
        hits = word_hits(text, p.ad_words)
        return F.struct(text.alias("text"), (script_ratio(text, p.script_class) >= p.min_script_ratio).alias("in_script"), (F.size(hits) > 0).alias("low_trust"), hits.alias("ad_hits"))

    # a lambda's argument is bound once: the chain of replacements runs once a text, not once a use
    return F.element_at(F.transform(F.array(text), judged), 1)


def token_estimate(text: Column) -> Column:
    cjk = F.char_length(F.regexp_replace(text, rf"[^{CJK}]", ""))
    return (cjk + F.ceil((F.char_length(text) - cjk) / 4)).cast("long")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def clean_fingerprint(p: Params) -> str:
    return f"v1|{p.min_script_ratio}|{p.max_tokens}|{p.overlap_tokens}"


def evidence_span(chunk: Column, start: Column, evidence: Column) -> Column:
    """struct: start, end of the evidence in the whole text; null if it is empty or absent."""
    at = F.instr(chunk, evidence)
    return F.when((evidence != "") & (at > 0), F.struct((start + at - 1).alias("start"), (start + at - 1 + F.char_length(evidence)).alias("end")))


def shop_norm(name: Column, p: Params) -> Column:
    """A shop name as a key: brackets and separators go, then one prefix and one suffix, never to nothing."""
    raw = F.coalesce(name, F.lit(""))
    text = F.regexp_replace(simplified(F.regexp_replace(raw, BRACKETED, "")), r"(?U)[\s·・]+" if p.name_spaces_go else r"[·・]+", "")

    def unprefixed(text: Column) -> Column:
        out = text
        for prefix in reversed(p.name_prefixes):
            out = F.when(F.startswith(text, F.lit(prefix)) & (F.char_length(text) > len(prefix)), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(out)
        return out

    def unsuffixed(text: Column) -> Column:
        out = text
        for suffix in reversed(p.name_suffixes):
            cut = F.char_length(text) - len(suffix)
            out = F.when(F.endswith(text, F.lit(suffix)) & (cut > 0), F.substring(text, F.lit(1), cut.cast("int"))).otherwise(out)
        return out

    # a lambda's argument is bound once: each step runs once a name, not once for every use by the next ones
    steps = F.array(text)
    for step in (unprefixed, unsuffixed):
        steps = F.transform(steps, step)
    return F.coalesce(F.nullif(F.element_at(steps, 1), F.lit("")), strip(raw))


def brand_stem(norm: Column, p: Params) -> Column:
    """The first branch word that occurs goes (once), if two characters remain."""
    out = norm
    for word in reversed(p.branch_words):
        at = F.instr(norm, F.lit(word))
        stem = F.concat(F.substring(norm, F.lit(1), at - 1), F.substring(norm, at + len(word), F.lit(1 << 30)))
        out = F.when((at > 0) & (F.char_length(stem) >= 2), stem).otherwise(out)
    return out


def address_tokens(address: Column) -> Column:
    """Distinct two-character tokens of the parts between separators; null counts as none."""
    text = F.regexp_replace(simplified(F.regexp_replace(F.coalesce(address, F.lit("")), BRACKETED, "")), r"(?U)[\s·・]+", "")
    parts = F.filter(F.split(text, ADDRESS_SPLIT), lambda x: x != "")
    grams = F.transform(parts, lambda x: F.when(F.char_length(x) <= 2, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Null if either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


@F.pandas_udf(T.DoubleType())
def matching_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Matching-block ratio (Spark has no such function), for a batch at once; the order of the arguments matters."""
    for left, right in pairs:
        yield pd.Series(matching_ratios(left.fillna("").tolist(), right.fillna("").tolist()), dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    rest = F.when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(matching_ratio(a, b))
    return F.when(F.coalesce(a, F.lit("")) == "", 0.0).when(F.coalesce(b, F.lit("")) == "", 0.0).when(a == b, 1.0).otherwise(rest)


def composite_similarity(name: Column, address: Column, p: Params) -> Column:
    return F.when(address.isNull(), name).otherwise((p.name_weight * name + p.address_weight * address) / (p.name_weight + p.address_weight))


def open_ranges(text: Column) -> Column:
    """array<struct<start, end>> in minutes; equal ends mean the whole day."""
    number = lambda k: F.regexp_extract_all(text, F.lit(OPEN_RANGE), F.lit(k))
    hours = F.arrays_zip(number(1).alias("a"), number(2).alias("b"), number(3).alias("c"), number(4).alias("d"))

    def one(x: Column) -> Column:
        start, end = x["a"].cast("int") * 60 + x["b"].cast("int"), x["c"].cast("int") * 60 + x["d"].cast("int")
        return F.struct(F.when(start == end, 0).otherwise(start).alias("start"), F.when(start == end, 1440).otherwise(end).alias("end"))

    return F.transform(hours, one)


def is_open(ranges: Column, at: Column, zone: str = "Asia/Shanghai") -> Column:
    local = F.from_utc_timestamp(at, zone)
    m = F.hour(local) * 60 + F.minute(local)

    def inside(r: Column) -> Column:
        return F.when(r["start"] < r["end"], (m >= r["start"]) & (m < r["end"])).when(r["end"] < r["start"], (m >= r["start"]) | (m < r["end"])).otherwise(False)

    return F.when(F.size(ranges) > 0, F.exists(ranges, inside))


def maturity(count: Column) -> Column:
    return F.when(count >= 30, "deep").when(count >= 5, "initial").otherwise("collecting")


def deep_link(city_ids: dict[str, str], city: Column, name: Column, base: str) -> Column:
    """base?city=id&keyword=encoded name; null for an unknown city or a blank name."""
    city_id = F.element_at(F.create_map(*[F.lit(x) for kv in city_ids.items() for x in kv]), city)
    quoted = F.replace(F.replace(F.url_encode(strip(name)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.when(city_id.isNotNull() & (strip(name) != ""), F.concat(F.lit(base), city_id, F.lit("/"), quoted))


def share_text(facts: Sequence[Column], dishes: Column, words: Column, most: int = 120) -> Column:
    line = F.concat_ws(" · ", *facts, F.array_join(F.slice(dishes, 1, 3), "、"), F.array_join(F.slice(words, 1, 3), "、"))
    flat = strip(F.regexp_replace(line, r"(?U)\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def ip_hash(salt: str, ip: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), ip), 256)


def client_ip(real_ip: Column, forwarded: Column, peer: Column) -> Column:
    last = strip(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(F.nullif(strip(real_ip), F.lit("")), F.nullif(last, F.lit("")), peer)


def lenient_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"))
