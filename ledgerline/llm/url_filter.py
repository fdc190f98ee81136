"""Allow and block rules for URLs in a trie over reversed host labels and path segments, longest match first.

A rule is a host and a path. It fits the host itself and every subdomain, if the URL's path starts with the rule's
(as a string: /en/7 fits /en/77). Among the rules that fit, the one with most host labels wins, then the one with the
longest path; of an allow and a block entry for the same host and path, the allow entry. Without a rule the verdict
is `default`. The trie is broadcast, up to RULES_MAX rules; a larger rule set is joined as a table, with the same results: a URL's host
suffixes and path segments meet the rules' nodes by equality, then the beginnings of its next segment meet the rules that end there.

Null URLs and those without :// have an empty host and path and fit no rule that names a host; URLs of any length are read whole; repeated
rows are kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES_MAX = 200_000
AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *AZ)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlTrie:
    """Nodes are dicts: label to node among hosts, then segment to node among paths; a verdict ends a rule."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {"hosts": {}}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(str.maketrans(*AZ)).split(".")):
                node = node["hosts"].setdefault(label, {"hosts": {}})
            *whole, last = path.split("/")
            node = node.setdefault("path", {"next": {}, "ends": {}})
            for segment in whole:
                node = node["next"].setdefault(segment, {"next": {}, "ends": {}})
            # The last segment is a prefix of the URL's segment there.
            if node["ends"].get(last, ("",))[0] != "allow":
                node["ends"][last] = (verdict, host + path)
                node["sizes"] = sorted({*node.get("sizes", ()), len(last)}, reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest match."""
        node, trees = self.root, []
        for label in reversed(host.split(".")):
            node = node["hosts"].get(label)
            if node is None:
                break
            if "path" in node:
                trees.append(node["path"])
        segments = path.split("/")
        for tree in reversed(trees):
            best, here = None, tree
            for segment in segments:
                for size in here.get("sizes", ()):  # the longest beginning that is a rule's
                    if size <= len(segment) and (end := here["ends"].get(segment[:size])):
                        best = end
                        break
                here = here["next"].get(segment)
                if here is None:
                    break
            if best:
                return best
        return None


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`; rules: (verdict, host, path)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) > RULES_MAX:
        return join_rules(parts, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("struct<verdict: string, rule: string>")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            match = trie.value.match
            found = [match(h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["verdict", "rule"])

    rows = parts.withColumn("_found", judged("host", "path"))
    return rows.select("page_id", "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("verdict"))


def join_rules(parts: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """filter_urls() for rules (verdict, host, path) of any number; parts: page_id, host, path.

    Each different host and path is judged once: equi-joins with the rules' nodes (host, whole segments), which tell how long the ends of rules there
    are, and then with the rules themselves.
    """
    kept = rules.select(F.translate("host", *AZ).alias("rule_host"), F.concat("host", "path").alias("rule"), "verdict", F.split("path", "/").alias("s"))
    kept = kept.select("rule_host", "rule", "verdict", F.array_join(F.slice("s", F.lit(1), F.size("s") - 1), "/").alias("whole"), F.size("s").alias("depth"), F.element_at("s", -1).alias("last"))
    kept = kept.groupBy("rule_host", "whole", "depth", "last").agg(F.min(F.struct("verdict", "rule")).alias("found"))  # allow comes before block
    nodes = kept.groupBy("rule_host", "whole", "depth").agg(F.collect_set(F.length("last")).alias("sizes"))  # of one node: lengths of segments
    urls = parts.select("host", "path").distinct().withColumn("labels", F.split("host", r"\.")).withColumn("segments", F.split("path", "/"))
    urls = urls.select("host", "path", "segments", "labels", F.posexplode("labels").alias("from_label", "_l"))
    urls = urls.select("host", "path", "segments", F.array_join(F.slice("labels", F.col("from_label") + 1, F.size("labels")), ".").alias("rule_host"), F.posexplode("segments").alias("at", "segment"))
    urls = urls.select("host", "path", "rule_host", (F.col("at") + 1).alias("depth"), "segment", F.array_join(F.slice("segments", F.lit(1), F.col("at")), "/").alias("whole"))
    ends = urls.join(nodes, ["rule_host", "whole", "depth"]).withColumn("size", F.explode("sizes")).filter("size <= length(segment)")
    ends = ends.select("host", "path", "rule_host", "whole", "depth", F.expr("left(segment, size)").alias("last"), "size")
    longest = F.struct(F.length("rule_host").alias("a"), "depth", "size", "found")
    best = ends.join(kept, ["rule_host", "whole", "depth", "last"]).groupBy("host", "path").agg(F.max(longest)["found"].alias("found"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
