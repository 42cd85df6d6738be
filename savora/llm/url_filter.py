"""URL filters: glob rules packed into multiword Shift-And masks, all simulated at once.

Each rule becomes an anchored glob over the canonical URL ``.host#path`` (neither part can hold
``#``), so ``*.net#/de/*`` fits the host ``net``, each subdomain, and every path below ``/de/``.
A glob's states are consecutive bits; all globs lie one after another in 64-bit words. A step
over one byte is ``((D << 1) & B[byte]) | (D & loops)`` with a carry between words, done for a
whole Arrow batch of URLs at a time.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the
default verdict; equal rows get equal results; ties between rules of one length go to the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import read_table


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}#{self.path}*"


#: The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


class ShiftAnd:
    """``*`` stands for any bytes, ``?`` for one byte, everything else for itself."""

    def __init__(self, globs: list[str]):
        tokens = [self._tokens(g) for g in globs]
        bits = sum(len(t) + 1 for t, _ in tokens)
        words = max(1, -(-bits // 64))
        self.accept = np.zeros(len(globs), dtype=np.int64)
        masks = np.zeros((256, words * 64), dtype=bool)
        loops, start, at = np.zeros(words * 64, dtype=bool), np.zeros(words * 64, dtype=bool), 0
        for k, (literals, stars) in enumerate(tokens):
            start[at] = True
            for j, byte in enumerate(literals, 1):
                masks[slice(None) if byte is None else byte, at + j] = True
            loops[[at + s for s in stars]] = True
            at += len(literals) + 1
            self.accept[k] = at - 1
        self.start, self.loops, self.masks = (self._pack(x) for x in (start, loops, masks))

    @staticmethod
    def _tokens(glob: str) -> tuple[list[int | None], set[int]]:
        literals: list[int | None] = []
        stars = set()
        for ch in glob:
            if ch == "*":
                stars.add(len(literals))
            elif ch == "?":
                literals.append(None)
            else:
                literals.extend(ch.encode())
        return literals, stars

    @staticmethod
    def _pack(flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each glob."""
        n, words = len(texts), self.start.shape[0]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        down = -lengths[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(down, -t, side="left"))  # texts longer than t
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, : words - 1] >> top
            state[:live] = (moved & self.masks[flat[begin[:live] + t]]) | (d & self.loops)
        out = np.empty((n, len(self.accept)), dtype=bool)
        word, bit = self.accept // 64, (self.accept % 64).astype(np.uint64)
        out[order] = (state[:, word] >> bit) & one != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def filter_urls(df: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """df's columns and a struct ``url_verdict``: host, path, rule, verdict. Nothing is shuffled."""
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), k))

    @F.pandas_udf("rule string, verdict string")
    def judge(canonical: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ShiftAnd([rules[k].glob for k in ranked])
        names = np.array([rules[k].name for k in ranked] + [None], dtype=object)
        verdicts = np.array([rules[k].verdict for k in ranked] + [default], dtype=object)
        for batch in canonical:
            hit = automaton.match([x.encode() for x in batch])
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked)) if ranked else np.zeros(len(batch), dtype=int)
            yield pd.DataFrame({"rule": names[first], "verdict": verdicts[first]})

    host, path = host_and_path(F.col(url_col))
    judged = df.withColumn("url_verdict", F.struct(host.alias("host"), path.alias("path"), judge(F.concat(F.lit("."), host, F.lit("#"), path)).alias("j")))
    v = F.col("url_verdict")
    return judged.withColumn("url_verdict", F.struct(v.host.alias("host"), v.path.alias("path"), v.j.rule.alias("rule"), v.j.verdict.alias("verdict")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "url_verdict.*")


OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/]*')) + 1) AS path FROM cut
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), hits AS (
  SELECT page_id, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS verdict
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)
"""
