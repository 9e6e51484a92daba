"""Facts about a table: small driver-side records, also offered as DataFrames with one row per column or pair."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SEMANTIC_TYPES = (
    "numerical_continuous", "numerical_discrete", "categorical_nominal", "categorical_ordinal", "datetime",
    "boolean", "identifier", "constant", "free_text",
)


@dataclass
class ColumnFacts:
    position: int
    name: str
    physical: str
    family: str
    rows: int
    non_null: int
    missing: int
    missing_pct: float
    unique: int = 0
    uniqueness: float = 0.0
    semantic: str = "categorical_nominal"
    is_constant: bool = False
    is_binary: bool = False
    is_identifier: bool = False
    dominant_pct: float = 0.0
    is_quasi_constant: bool = False
    ordinal_order: list[str] | None = None
    samples: list[str] = field(default_factory=list)
    values: list[tuple[str, int]] = field(default_factory=list)   # the 20 most frequent values
    # numeric
    has_numeric: bool = False
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    median: float | None = None
    std: float | None = None
    q25: float | None = None
    q75: float | None = None
    iqr: float | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    is_normal: bool = False
    zeros: int | None = None
    zero_pct: float | None = None
    negatives: int | None = None
    lower_fence: float | None = None
    upper_fence: float | None = None
    outliers: int | None = None
    outlier_pct: float | None = None
    extremes: int | None = None
    histogram: list[int] = field(default_factory=list)
    # categorical
    has_categories: bool = False
    mode: str | None = None
    mode_pct: float | None = None
    rare: int | None = None
    entropy: float | None = None
    # dates
    is_date_text: bool = False
    day_first: bool = False
    mixed_offsets: bool = False
    min_date: str | None = None
    max_date: str | None = None
    span_days: float | None = None
    has_time: bool = False

    @property
    def bin_edges(self) -> list[float]:
        if not self.histogram:
            return []
        low, high = (self.min, self.max) if self.max > self.min else (self.min - 0.5, self.max + 0.5)
        return [low + (high - low) * i / len(self.histogram) for i in range(len(self.histogram) + 1)]


@dataclass
class Pair:
    feature_a: str
    feature_b: str
    correlation: float
    measure: str            # pearson, cramers_v or co_missing

    @property
    def strength(self) -> float:
        return abs(self.correlation)

    @property
    def severity(self) -> str:
        return "CRITICAL" if self.strength >= 0.90 else "WARNING"


@dataclass
class DatasetFacts:
    rows: int
    columns: dict[str, ColumnFacts]
    duplicate_rows: int = 0
    hidden_duplicate_rows: int = 0
    data_bytes: int = 0
    high_pairs: list[Pair] = field(default_factory=list)
    correlation: dict[tuple[str, str], float] = field(default_factory=dict)
    missing_pairs: list[Pair] = field(default_factory=list)

    @property
    def cells(self) -> int:
        return self.rows * len(self.columns)

    @property
    def missing_cells(self) -> int:
        return sum(c.missing for c in self.columns.values())

    @property
    def missing_pct(self) -> float:
        return 100.0 * self.missing_cells / self.cells if self.cells else 0.0

    @property
    def duplicate_pct(self) -> float:
        return 100.0 * self.duplicate_rows / self.rows if self.rows else 0.0

    @property
    def columns_with_missing(self) -> int:
        return sum(1 for c in self.columns.values() if c.missing)

    @property
    def type_counts(self) -> dict[str, int]:
        counts = dict.fromkeys(SEMANTIC_TYPES, 0)
        for c in self.columns.values():
            counts[c.semantic] = counts.get(c.semantic, 0) + 1
        return counts

    def matrix_value(self, a: str, b: str) -> float:
        """Pearson matrix entry, rounded to 3 places, 0 where undefined."""
        return self.correlation.get((a, b), self.correlation.get((b, a), 0.0))

    def summary(self) -> dict:
        types = self.type_counts
        return {
            "row_count": self.rows, "col_count": len(self.columns), "total_cells": self.cells,
            "total_missing_cells": self.missing_cells, "overall_missing_pct": round(self.missing_pct, 2),
            "duplicate_rows": self.duplicate_rows, "duplicate_pct": round(self.duplicate_pct, 2),
            "hidden_duplicate_rows": self.hidden_duplicate_rows,
            "memory_mb": round(self.data_bytes / 2**20, 2), "type_counts": types,
            "columns_with_missing": self.columns_with_missing, "columns_constant": types["constant"],
            "columns_identifiers": types["identifier"],
        }

    def to_dict(self) -> dict:
        return {
            "dataset_summary": self.summary(),
            "columns": {n: {**asdict(c), "bin_edges": c.bin_edges} for n, c in self.columns.items()},
            "high_correlation_pairs": [{**asdict(p), "severity": p.severity} for p in self.high_pairs],
            "correlation_matrix": [{"feature_a": a, "feature_b": b, "correlation": r}
                                   for (a, b), r in self.correlation.items()],
            "missing_corr_pairs": [asdict(p) for p in self.missing_pairs],
        }


def small_frame(spark: SparkSession, rows: list[dict], schema: list[tuple[str, pa.DataType]]) -> DataFrame:
    """A DataFrame from a few driver-side rows, through Arrow (a local relation, no job)."""
    arrow = pa.schema([pa.field(n, t) for n, t in schema])
    return spark.createDataFrame(pa.Table.from_pylist([{n: r.get(n) for n, _ in schema} for r in rows], schema=arrow))


_I, _F, _S, _B = pa.int64(), pa.float64(), pa.string(), pa.bool_()
COLUMN_SCHEMA = [
    ("position", _I), ("name", _S), ("physical", _S), ("family", _S), ("semantic", _S), ("rows", _I),
    ("non_null", _I), ("missing", _I), ("missing_pct", _F), ("unique", _I), ("uniqueness", _F),
    ("is_constant", _B), ("is_binary", _B), ("is_identifier", _B), ("dominant_pct", _F),
    ("is_quasi_constant", _B), ("ordinal_order", pa.list_(_S)), ("has_numeric", _B), ("min", _F), ("max", _F),
    ("mean", _F), ("median", _F), ("std", _F), ("q25", _F), ("q75", _F), ("iqr", _F), ("skewness", _F),
    ("kurtosis", _F), ("is_normal", _B), ("zeros", _I), ("zero_pct", _F), ("negatives", _I), ("lower_fence", _F),
    ("upper_fence", _F), ("outliers", _I), ("outlier_pct", _F), ("extremes", _I), ("mode", _S), ("mode_pct", _F),
    ("rare", _I), ("entropy", _F), ("min_date", _S), ("max_date", _S), ("span_days", _F), ("has_time", _B),
    ("max_abs_corr", _F), ("max_co_missing", _F),
]


def column_facts_df(spark: SparkSession, facts: DatasetFacts) -> DataFrame:
    """One row per column, with the strongest association of the column joined in."""
    strongest: dict[str, float] = {}
    together: dict[str, float] = {}
    for target, pairs in ((strongest, facts.high_pairs), (together, facts.missing_pairs)):
        for p in pairs:
            for c in (p.feature_a, p.feature_b):
                target[c] = max(target.get(c, 0.0), p.strength)
    rows = [{**asdict(c), "max_abs_corr": strongest.get(n, 0.0), "max_co_missing": together.get(n, 0.0)}
            for n, c in facts.columns.items()]
    return small_frame(spark, rows, COLUMN_SCHEMA)


def pairs_df(spark: SparkSession, facts: DatasetFacts) -> DataFrame:
    rows = [{**asdict(p), "abs_correlation": p.strength, "severity": p.severity if p.measure != "co_missing" else None}
            for p in facts.high_pairs + facts.missing_pairs]
    return small_frame(spark, rows, [("measure", _S), ("feature_a", _S), ("feature_b", _S), ("correlation", _F),
                                     ("abs_correlation", _F), ("severity", _S)])


def histogram_df(spark: SparkSession, facts: DatasetFacts) -> DataFrame:
    """One row per bin; `outside` marks bins that reach past the 1.5 x IQR fences."""
    rows = []
    for c in facts.columns.values():
        edges = c.bin_edges
        rows += [{"column": c.name, "bin": i, "lower": edges[i], "upper": edges[i + 1], "count": n,
                  "outside": edges[i] < c.lower_fence or edges[i + 1] > c.upper_fence}
                 for i, n in enumerate(c.histogram)]
    return small_frame(spark, rows, [("column", _S), ("bin", _I), ("lower", _F), ("upper", _F), ("count", _I),
                                     ("outside", _B)])


def categories_df(spark: SparkSession, facts: DatasetFacts, top: int = 6) -> DataFrame:
    rows = [{"column": c.name, "rank": i + 1, "category": v, "count": n, "percentage": 100.0 * n / c.non_null}
            for c in facts.columns.values() if c.has_categories for i, (v, n) in enumerate(c.values[:top])]
    return small_frame(spark, rows, [("column", _S), ("rank", _I), ("category", _S), ("count", _I),
                                     ("percentage", _F)])
