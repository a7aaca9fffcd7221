"""Allow and block lists over URLs: one trie of reversed host labels and path segments.

A rule is (host, path, verdict). It fits its host and all subdomains, where the URL's path starts with the rule's
path. The rule of the deepest host wins, then the longest path; block wins between equal rules. URLs that no rule
fits get the default verdict.

The trie is broadcast; its size is bounded by ``max_rules``, checked before anything runs. Null URLs and URLs
without ``://`` have an empty host and path. Repeated rows are judged alike; an empty table gives an empty result.
Columns named like the new ones (``host``, ``path``, ``rule``, ``verdict``) are replaced.
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludograph.llm.common import prepare, spare

Rule = tuple[str, str, str]

MAX_RULES = 1_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; ASCII letters in lower case."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


class Trie:
    """Nodes are dictionaries: ``("h", label)`` leads to a longer host, ``("p", segment)`` to a longer path, and
    ``"ends"`` holds what may begin the next segment, with the rule that ends there."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".") if host else []):
                node = node.setdefault(("h", label), {})
            *segments, last = path.split("/")
            for segment in segments:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("ends", {})
            if last not in ends or verdict == "block":
                ends[last] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, hosts = self.root, [self.root]
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for node in reversed(hosts):
            best = None
            for segment in segments:
                ends = node.get("ends")
                if ends:
                    fits = [e for e in ends if segment.startswith(e)]
                    best = ends[max(fits, key=len)] if fits else best
                node = node.get(("p", segment))
                if node is None:
                    break
            if best:
                return best
        return None


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow",
               max_rules: int = MAX_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` to each row."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the trie is broadcast, so at most {max_rules} are taken")
    spark = prepare(df.sparkSession)
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = trie.value.find
        found = [find(h, p) or (None, default) for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parts = df.select(*[f"`{c}`" for c in kept], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = spare("found", *parts.columns)
    judged = parts.withColumn(found, look_up("host", "path"))
    return judged.select(*[f"`{c}`" for c in kept], "host", "path", f"{found}.rule", f"{found}.verdict")
