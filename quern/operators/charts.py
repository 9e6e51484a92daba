"""VIZ-*: the aggregations behind charts. Results are a few rows; nothing is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import q, text
from quern.functions.types import as_double, families
from quern.operators.facts import small_frame
from quern.operators.quantiles import quantiles
from quern.operators.ranks import ranked

SAMPLE = 800
SEED = 42
STATUS_ORDER = ("DROP_RECOMMENDED", "CRITICAL_ATTENTION", "REQUIRES_TRANSFORMATION", "READY_WITH_PREPROCESSING",
                "HEALTHY")


def hash_order(row_id: str, seed: int = SEED) -> str:
    """A seeded pseudo-random order that depends on the row's identity only, not on partitions: 52 bits of MD5."""
    return f"cast(conv(substring(md5(concat(cast({row_id} AS string), '|{seed}')), 1, 13), 16, 10) AS bigint)"


def _number(c: str, fam: str) -> str:
    """A column as double; text that is no number, NaN and infinities are NULL."""
    x = f"try_cast({q(c)} AS double)" if fam == "text" else as_double(c, fam)
    return f"nullif(nullif(nullif({x}, double('NaN')), double('Infinity')), double('-Infinity'))"


def scatter_points(df: DataFrame, x: str, y: str, hue: str | None = None, row_id: str | None = None,
                   n: int = SAMPLE) -> DataFrame:
    """VIZ-1: a seeded sample of complete rows. Each task keeps its own best n (a top-k, not a sort)."""
    fams = families(df)
    cols = [x, y] + ([hue] if hue else [])
    ident = q(row_id) if row_id else "to_json(struct(*))"
    complete = df.where(" AND ".join(f"{q(c)} IS NOT NULL" for c in cols))
    points = complete.selectExpr(
        f"{_number(x, fams[x])} AS x", f"{_number(y, fams[y])} AS y",
        f"cast({q(hue)} AS string) AS hue" if hue else "cast(NULL AS string) AS hue",
        f"{hash_order(ident)} AS h", f"{ident} AS row_id")
    return points.orderBy("h", "row_id").limit(n).where("x IS NOT NULL AND y IS NOT NULL").select("row_id", "x", "y", "hue")


def scatter_line(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """VIZ-1: least-squares line and correlation over all complete rows (pass a sample to fit the sample). NULL when
    there are fewer than 3."""
    fams = families(df)
    a, b = _number(x, fams[x]), _number(y, fams[y])
    if hue:
        df = df.where(f"{q(hue)} IS NOT NULL")
    both = df.selectExpr(f"{a} AS x", f"{b} AS y").where("x IS NOT NULL AND y IS NOT NULL")
    fit = both.agg(F.count("*").alias("n"), F.expr("regr_slope(y, x)").alias("slope"),
                   F.expr("regr_intercept(y, x)").alias("intercept"), F.expr("corr(y, x)").alias("r"))
    enough = lambda e, d: f"CASE WHEN n >= 3 THEN round({e}, {d}) END"
    return fit.selectExpr("n AS total_points", f"{enough('slope', 4)} AS slope",
                          f"{enough('intercept', 4)} AS intercept", f"{enough('r', 3)} AS r_value",
                          f"{enough('r * r', 3)} AS r_squared")


def grouped(df: DataFrame, category: str, number: str, top: int = 15) -> DataFrame:
    """VIZ-2: count, mean, quartiles and range of a number within the most frequent categories, highest mean first.

    Quantiles are taken per category as conditional columns of the whole table, so a category that holds a third of
    the rows is not gathered anywhere."""
    fams = families(df)
    v = _number(number, fams[number])
    rows = df.selectExpr(f"cast({q(category)} AS string) AS k", f"{v} AS v").where("k IS NOT NULL AND v IS NOT NULL")
    stats = (rows.groupBy("k").agg(F.count("*").alias("count"), F.avg("v").alias("mean"), F.min("v").alias("min"),
                                   F.max("v").alias("max")).orderBy(F.desc("count"), "k").limit(top).collect())
    wanted = {r["k"]: (f"CASE WHEN k = {text(r['k'])} THEN v END", [0.25, 0.5, 0.75]) for r in stats}
    quant = quantiles(rows, wanted, {r["k"]: r["count"] for r in stats})
    import pyarrow as pa
    out = [{"category": r["k"], "count": r["count"], "mean": r["mean"], "median": quant[r["k"]][0.5],
            "q25": quant[r["k"]][0.25], "q75": quant[r["k"]][0.75], "min": r["min"], "max": r["max"]} for r in stats]
    out.sort(key=lambda r: (-r["mean"], r["category"]))
    f = pa.float64()
    return small_frame(df.sparkSession, out, [
        ("category", pa.string()), ("count", pa.int64()), ("mean", f), ("median", f), ("q25", f), ("q75", f),
        ("min", f), ("max", f)])


def missingness_grid(df: DataFrame, chunks: int = 60, order_by: str | None = None) -> DataFrame:
    """VIZ-3: share of NULL per column in consecutive slices of max(1, rows // chunks) rows.

    Slices need row numbers, and numbering a table in one window would put it in one task. With `order_by`, a column of any
    type, rows are ranked by a sort by ranges, of the key and a flag for each column; rows of equal keys share their slices in
    any order. Without it, rows are numbered by scan position: partition sizes first, then an offset each."""
    rows = df.count()
    size = max(1, rows // chunks)
    flags = [f"{q(c)} IS NULL AS {q(c)}" for c in df.columns]
    if not rows:
        numbered = df.selectExpr("0L AS slice", *flags)
    elif order_by:
        keyed = df.selectExpr(f"{q(order_by)} AS __key", f"struct({', '.join(flags)}) AS __flags")
        numbered = ranked(keyed, [], [F.col("__key").asc_nulls_first()]).selectExpr(f"rank DIV {size}L AS slice", "__flags.*")
    else:
        tagged = df.selectExpr("monotonically_increasing_id() AS __id", "spark_partition_id() AS __part", f"struct({', '.join(flags)}) AS __flags")
        sizes = tagged.groupBy("__part").count().orderBy("__part").collect()
        offsets, total = [], 0
        for r in sizes:
            offsets.append({"__part": r["__part"], "__offset": total})
            total += r["count"]
        import pyarrow as pa
        table = small_frame(df.sparkSession, offsets, [("__part", pa.int32()), ("__offset", pa.int64())])
        numbered = tagged.join(F.broadcast(table), "__part").selectExpr(f"(__offset + (__id & {2**33 - 1}L)) div {size}L AS slice", "__flags.*")
    pcts = [F.expr(f"avg(cast({q(c)} AS int)) * 100").alias(c) for c in df.columns]
    return (numbered.groupBy("slice").agg(F.count("*").alias("__n"), *pcts)
            .selectExpr(f"slice * {size}L AS row_start", f"slice * {size}L + __n AS row_end",
                        *[q(c) for c in df.columns]))


def column_dictionary(facts_frame: DataFrame, status_frame: DataFrame, semantic: str | None = None,
                      search: str = "", sort: str = "status", descending: bool = False) -> DataFrame:
    """VIZ-4: columns by type and name, sorted by status, name, type, unique or missing."""
    rank = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATUS_ORDER)) + " ELSE 9 END"
    keys = {"status": rank, "name": "name", "type": "semantic", "unique": "unique", "missing": "missing_pct"}
    out = facts_frame.join(status_frame.selectExpr("column AS name", "status"), "name", "left")
    if semantic:
        out = out.where(F.col("semantic") == semantic)
    if search.strip():
        out = out.where(F.contains(F.lower("name"), F.lit(search.strip().lower())))
    key = F.expr(keys[sort])
    return (out.orderBy(key.desc() if descending else key.asc(), "position")
            .select("name", "semantic", "status", "unique", "missing_pct"))


def outlier_ranking(facts_frame: DataFrame) -> DataFrame:
    """VIZ-5: numeric columns, most outliers first."""
    return (facts_frame.where("has_numeric").orderBy(F.desc("outlier_pct"), "position")
            .select("name", "outliers", "outlier_pct", "extremes", "lower_fence", "upper_fence"))


def groupable(facts_frame: DataFrame) -> DataFrame:
    """VIZ-6: columns worth grouping by."""
    return facts_frame.where(
        "semantic IN ('categorical_nominal', 'categorical_ordinal', 'boolean', 'identifier', 'free_text') "
        "AND unique BETWEEN 2 AND 20 AND NOT is_identifier").select("position", "name", "unique")


# VIZ-7: filters over the recommendations.
RECOMMENDATION_FILTERS = {
    "drop": "should_drop",
    "impute": "missing_pct > 0 AND NOT should_drop",
    "outliers": "coalesce(outliers, 0) > 0 OR abs(coalesce(skewness, 0)) >= 1",
    "encode": "encoding IS NOT NULL AND NOT should_drop",
    "healthy": "status IN ('HEALTHY', 'READY_WITH_PREPROCESSING')",
}


def recommendation_filter(recommendations: DataFrame, name: str) -> DataFrame:
    return recommendations.where(RECOMMENDATION_FILTERS[name])
