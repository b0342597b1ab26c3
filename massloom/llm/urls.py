"""URL rules found through an index of literal tokens, in DataFrame functions only.

A rule names a host, which stands for itself and its subdomains, and the beginning of a path, in which ``*`` stands
for any run of characters. Every rule is filed under one whole literal token of its own, the one that the fewest URLs
have. The tokens of a URL fetch candidate rules, and only those are tried as regular expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# up to this many rules the index is broadcast; a longer list is joined by shuffling, with the same result
BROADCAST_RULES = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    action: str  # "allow" or "block"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host and path written as one."""
        path = ".*".join(re.escape(p) for p in self.path.split("*"))
        host = rf"([^/]*\.)?{re.escape(self.host.translate(str.maketrans(UPPER, LOWER)))}" if self.host else "[^/]*"
        # the path of a URL is empty or begins with a slash, so the host ends there
        return f"(?s)^{host}{path or '(/|$)'}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL under this rule has whole; the empty one is in all URLs."""
        labels = [f"h:{x}" for x in self.host.translate(str.maketrans(UPPER, LOWER)).split(".") if x]
        whole = self.path.split("/")[1:-1]
        return labels + [f"p:{x}" for x in whole if x and "*" not in x] or [""]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case (A-Z), and path; both empty if there is none or the url is null."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, shape, 1), UPPER, LOWER), F.regexp_extract(known, shape, 2)


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, segments))


def rule_index(urls: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """token, rule, action, pattern, length, place: each rule under the token that the fewest of ``urls`` have."""
    kinds = "array<struct<place: int, rule: string, action: string, pattern: string, tokens: array<string>>>"
    own = [{"place": i, "rule": r.name, "action": r.action, "pattern": r.pattern, "tokens": r.tokens} for i, r in enumerate(rules)]
    listed = urls.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(own)), kinds)))
    listed = listed.withColumn("token", F.explode("tokens")).drop("tokens").distinct()
    named = listed.select("token").distinct()
    if len(rules) <= BROADCAST_RULES:
        named = F.broadcast(named)
    seen = urls.select(F.explode("tokens").alias("token")).join(named, "token").groupBy("token")
    rarest = Window.partitionBy("place").orderBy(F.coalesce("n", F.lit(0)), "token")
    counted = listed.join(seen.agg(F.count(F.lit(1)).alias("n")), "token", "left")
    filed = counted.withColumn("_r", F.row_number().over(rarest)).where("_r = 1")
    return filed.select("token", "rule", "action", "pattern", F.length("rule").alias("length"), "place")


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], default: str = "allow", key: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict.

    The longest fitting rule wins, of equally long ones the first in the list. A URL that no rule fits has a null rule
    and gets ``default``; so do null URLs and those without ``://``, whose host and path are empty. Rows that repeat a
    key or a URL are judged each. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", _tokens(F.col("host"), F.col("path")))
    index = rule_index(urls, rules)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    # each distinct address is judged once, however often it repeats
    addresses = urls.groupBy("host", "path").agg(F.any_value("tokens").alias("tokens"))
    tried = addresses.withColumn("token", F.explode("tokens")).join(index, "token")
    fits = tried.where((F.col("host") != "") & F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct("length", (-F.col("place")).alias("place"), "rule", "action")).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
