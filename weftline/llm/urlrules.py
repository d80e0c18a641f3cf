"""URL allow and block rules by a sort-merge range join.

The canonical key of a host is its labels in reverse, each followed by a dot (`blog.example.net` ->
`net.example.blog.`). A rule's host is then a prefix, and a prefix is an interval of keys. Pages are sorted by
key; one sweep over a partition's sorted pages opens and closes the intervals and keeps the open, nested ones on
a stack. Each open host has its path prefixes by length, so the longest that fits is found by lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are sent to the tasks at a time (some 50 MB); larger sets are swept block by block.
BLOCK = 500_000


def host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, host, path, key; both empty where the url is null or has no `://`."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract("rest", "^([^/?#]*)", 1)
    tail = F.expr("substring(rest, length(raw) + 1)")
    return (
        pages.select("page_id", rest.alias("rest")).select("page_id", "rest", raw.alias("raw"))
        .select("page_id", F.translate("raw", UPPER, LOWER).alias("host"), F.regexp_extract(tail, "^([^?#]*)", 1).alias("path"))
        .withColumn("key", F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", "\\.")), "."), F.lit("."))))
    )


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Sweep:
    """The state of one sweep: rule hosts by key, the next to open, and the stack of open ones."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        hosts: dict[str, dict] = {}
        for host, path, verdict in rules:
            h = host.translate(str.maketrans(UPPER, LOWER))
            hosts.setdefault(key_of(h), {}).setdefault(path, (f"{h}{path}", verdict))
        self.starts = sorted(hosts)
        self.paths = [hosts[k] for k in self.starts]
        self.sizes = [sorted({len(p) for p in x}, reverse=True) for x in self.paths]
        self.next, self.stack = 0, []

    def move(self, key: str) -> None:
        """To a key no smaller than the last one."""
        while self.next < len(self.starts) and self.starts[self.next] <= key:
            self._close(self.starts[self.next])
            self.stack.append(self.next)
            self.next += 1
        self._close(key)

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.starts[self.stack[-1]]):
            self.stack.pop()

    def find(self, path: str) -> tuple[str, str] | None:
        """The longest rule among the open ones, by the length of its text; ties go to the deeper host."""
        best = None
        for k in reversed(self.stack):
            for n in self.sizes[k]:
                if n <= len(path) and (hit := self.paths[k].get(path[:n])) is not None:
                    if best is None or len(hit[0]) > len(best[0]):
                        best = hit
                    break
        return best


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", partitions: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of (page_id, url); rules are (host, path prefix, verdict).

    A rule fits its host and all subdomains where the path starts with its prefix; the longest wins, and of
    repeated rules the first. Without one: rule null, the default verdict. Rows keep their number; the sort
    breaks ties of the key by page_id, so that a host that many pages share is dealt to many partitions.
    Other columns are ignored, whatever their names; an empty table has an empty result.
    """
    out = host_and_path(pages).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key")
    for at in range(0, len(rules), BLOCK):
        block = pages.sparkSession.sparkContext.broadcast(rules[at : at + BLOCK])

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            sweep, last = Sweep(block.value), None
            for batch in batches:
                rule, verdict = batch["rule"].tolist(), batch["verdict"].tolist()
                for i, (key, path) in enumerate(zip(batch["key"], batch["path"], strict=True)):
                    if key != last:
                        sweep.move(key)
                        last = key
                    if (hit := sweep.find(path)) and (not isinstance(rule[i], str) or len(hit[0]) > len(rule[i])):
                        rule[i], verdict[i] = hit
                yield batch.assign(rule=pd.Series(rule, dtype=object), verdict=pd.Series(verdict, dtype=object))

        out = out.mapInPandas(run, out.schema)
    return out.select("page_id", "host", "path", "rule", "verdict")
