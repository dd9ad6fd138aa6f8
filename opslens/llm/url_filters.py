"""Allow and block lists for URLs: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULE_BYTES = 32 << 20


class RuleTrie:
    """Nodes are dicts. A host is walked label by label from its end; at every node on the way a rule may end, with the
    paths it asks for in a second trie over path segments. A rule path that does not end in `/` may stop inside a segment.
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            at = node.setdefault(None, {})  # no label is None: the key of the path trie
            for segment in whole:
                at = at.setdefault(("segment", segment), {})
            at.setdefault("rules", {})[last] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule with the most host labels, among these with the longest path."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            best = self._path(node.get(None), segments) or best
        return best

    @staticmethod
    def _path(at: dict | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if at is None:
                break
            ends = at.get("rules", {})
            fitting = [last for last in ends if segment.startswith(last)]
            if fitting:
                best = ends[max(fitting, key=len)]
            at = at.get(("segment", segment))
        return best


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(after, upper, lower), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_rule_bytes: int = MAX_RULE_BYTES,
) -> DataFrame:
    """One row per page: id, host, path, the rule that decided (null if none fits) and the verdict.

    A rule (host, path, verdict) fits its host and all its subdomains if the path of the URL starts with the rule's.
    The rule with the longest host wins, then the longest path; a rule given twice keeps its last verdict. Pages that no
    rule fits get `default`. Null ids and repeated rows pass through one by one; other columns are not read.

    The trie goes to every task, so the rule list must be smaller than `max_rule_bytes`; a larger one is refused.
    """
    size = sum(len(h) + len(p) + 8 for h, p, _ in rules)
    if size > max_rule_bytes:
        raise ValueError(f"the rules take {size} bytes; at most {max_rule_bytes} are sent to the tasks")
    shared = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            found = [trie.match(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    parts = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = parts.withColumn("_found", decide("host", "path"))
    return judged.select(id_col, "host", "path", "_found.rule", "_found.verdict")
