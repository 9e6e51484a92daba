"""Operator 13: URLs judged by rules on hosts and path beginnings, in one sorted sweep over ranges."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ship import ship

RANGE_ROWS = 500_000  # probes of a range
RANGE_SAMPLE = 60  # sampled keys for each range's end
# Fixed values of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EVENT = "place int, key string, kind int, uid long, rule string, verdict string, weight long, host_weight long, carried {}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; path: then up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _ends(probes: DataFrame, n: int, total: int) -> list[tuple[str, int]]:
    """Where n ranges of about equal size begin, but for the first; from a sample of at most about RANGE_SAMPLE keys a range."""
    if n == 1:
        return []
    seen = sorted((r.key, r.uid) for r in probes.select("key", "uid").sample(min(1.0, n * RANGE_SAMPLE / total), seed=5).toLocalIterator())
    return sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of `urls`: its id, host, path, rule, verdict. rules: host, path, verdict.

    A rule fits its host and every subdomain where the path begins with the rule's. The longest fitting rule wins (code points of
    host and path together, of equally long ones the one with the longer host); a rule given twice counts once, with the later
    verdict in alphabetical order. Where no rule fits, `rule` is NULL and the verdict is `default`.

    Keys are the host's labels in reverse, `/`, and the path: all that a rule fits under one host is an interval of keys. A URL asks
    once for its host and each parent domain, as deep as the deepest rule. Rules and questions are dealt to ranges of (key, row),
    so a host or URL with most of the rows spans many ranges; a rule goes to each range that its interval meets. A range is sorted
    and swept once, in batches: the stack holds the rules that the key at hand begins with, the innermost last. No range depends on
    how many rules a host has, and nothing is broadcast but the ends of the ranges.

    NULL URLs and those without `://` have an empty host and path, which only a rule with an empty host and path fits. Repeated rows
    are judged one by one; a NULL id stays NULL; other columns are ignored; without rules every verdict is `default`."""
    spark = urls.sparkSession
    ship(spark)
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    deep = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("path")).first()
    host, path = host_and_path(F.col(f"`{url}`"))
    kind = urls.schema[id_col].dataType.simpleString()
    carried = f"struct<id:{kind},host:string,path:string>"
    rows = urls.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path")).withColumn("uid", F.monotonically_increasing_id())
    labels = _reversed(F.col("host"))
    probes = (rows.withColumn("labels", labels)
              .withColumn("depth", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("labels"), F.lit(deep["labels"] or 1))))))
              .withColumn("key", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("depth")), "."), F.lit("/"), F.left("path", F.lit(deep["path"] or 0))))
              .select("key", "uid", F.when(F.col("depth") == 1, F.struct("id", "host", "path")).cast(carried).alias("carried")))
    total = urls.count()
    n = max(-(-total // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))) if total else 1
    ends = _ends(probes, n, total)
    own = rules.select(F.concat(F.array_join(_reversed(F.col("host")), "."), F.lit("/"), "path").alias("key"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("uid"),
                       F.concat("host", "path").alias("rule"), "verdict", F.length(F.concat("host", "path")).cast("long").alias("weight"),
                       F.length("host").cast("long").alias("host_weight"), F.lit(None).cast(carried).alias("carried"))
    asked = probes.select("key", F.lit(1).alias("kind"), "uid", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
                          F.lit(None).cast("long").alias("weight"), F.lit(None).cast("long").alias("host_weight"), "carried")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, place = [], []
            for i, (key, of, uid) in enumerate(zip(batch["key"].to_pylist(), batch["kind"].to_pylist(), batch["uid"].to_pylist(), strict=True)):
                first = bisect_right(ends, (key, uid))
                last = first if of else bisect_right(ends, key, key=lambda e: e[0][:len(key)])  # noqa: B023
                take += [i] * (last - first + 1)
                place += range(first, last + 1)
            chosen = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *chosen.columns], ["place", *chosen.schema.names])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at = [], None
        for batch in batches:
            keep, best = [], []
            columns = [batch[c].to_pylist() for c in ("place", "key", "kind", "rule", "verdict", "weight", "host_weight")]
            has_row = batch["carried"].is_valid().to_pylist()
            for i, (place, key, of, *rule) in enumerate(zip(*columns, strict=True)):
                if place != at:
                    stack, at = [], place
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not of:
                    stack.append((key, rule))
                elif stack or has_row[i]:
                    keep.append(i)
                    best.append(stack[-1][1] if stack else (None,) * 4)
            chosen = batch.take(pa.array(keep, pa.int64()))
            names, verdicts, weights, hosts = zip(*best, strict=True) if best else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [chosen["uid"], chosen["carried"], pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array(weights, pa.int64()),
                 pa.array(hosts, pa.int64())], ["uid", "carried", "rule", "verdict", "weight", "host_weight"])

    swept = (own.unionByName(asked).mapInArrow(deal, _EVENT.format(carried)).repartitionById(n, "place")
             .sortWithinPartitions("place", "key", "kind", "uid")
             .mapInArrow(sweep, f"uid long, carried {carried}, rule string, verdict string, weight long, host_weight long"))
    found = F.when(F.col("rule").isNotNull(), F.struct("weight", "host_weight", "rule", "verdict"))
    return (swept.groupBy("uid").agg(F.first("carried", ignorenulls=True).alias("carried"), F.max(found).alias("best"))
            .select(F.col("carried.id").alias(id_col), "carried.host", "carried.path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def judged_pages(pages: DataFrame) -> DataFrame:
    """`judge` with RULES."""
    return judge(pages, pages.sparkSession.createDataFrame(list(RULES), "host string, path string, verdict string"))
