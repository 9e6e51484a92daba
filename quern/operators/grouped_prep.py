"""PIP-*: leakage-safe preparation. Columns fall into groups by their facts; statistics come from the training rows
only; the fitted model is replayed on the test rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.lineage import cut
from quern.functions.names import double, q, take_name
from quern.functions.types import as_double, families, infinite_to_null
from quern.operators import steps as S
from quern.operators.charts import hash_order
from quern.operators.duplicates import distinct_rows, numbered_copies
from quern.operators.facts import DatasetFacts
from quern.operators.inference import Inference
from quern.operators.quantiles import agg_row, order_statistics
from quern.operators.ranks import ranked
from quern.operators.recipe import MISSING, cap_bounds, date_parts, scale_expressions, simple_fills
from quern.operators.repair import RepairPlan


@dataclass
class Groups:
    """PIP-1. Every column is in exactly one list."""
    drop: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    log1p: list[str] = field(default_factory=list)
    skewed: list[str] = field(default_factory=list)
    gaussian: list[str] = field(default_factory=list)
    high_card: list[str] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)
    onehot: list[str] = field(default_factory=list)
    passthrough: list[str] = field(default_factory=list)


# From here on a column of numbers is skewed.
SKEWED = 0.8
OUTLIERS_PCT = 2.0


def _number(f) -> bool:
    return f.semantic.startswith("numerical")


# PIP-1: a column belongs to the first group whose test it passes. Numbers go by the transform they were recommended, then by
# how far they are from a bell; categories by how many values they have and whether these have an order.
GROUP_TESTS = (
    ("passthrough", lambda f, r: r is None),
    ("drop", lambda f, r: r.should_drop),
    ("datetime", lambda f, r: f.semantic == "datetime"),
    ("binary", lambda f, r: f.semantic == "boolean" or f.is_binary or r.encoding == "encode_binary"),
    ("log1p", lambda f, r: _number(f) and "transform_log1p" in r.scaling),
    ("skewed", lambda f, r: _number(f) and f.has_numeric and (abs(f.skewness) >= SKEWED or f.outlier_pct >= OUTLIERS_PCT)),
    ("gaussian", lambda f, r: _number(f)),
    ("high_card", lambda f, r: r.encoding == "encode_frequency_or_target" or (f.semantic.startswith("categorical") and f.unique > 10)),
    ("ordinal", lambda f, r: f.semantic == "categorical_ordinal"),
    ("passthrough", lambda f, r: f.semantic == "free_text"),
    ("onehot", lambda f, r: True),
)


def group_columns(facts: DatasetFacts, inference: Inference, target: str | None = None) -> Groups:
    g = Groups()
    for name, f in facts.columns.items():
        if name != target:
            rec = inference.recommendations.get(name)
            getattr(g, next(group for group, test in GROUP_TESTS if test(f, rec))).append(name)
    return g


@dataclass
class GroupPipeline:
    facts: DatasetFacts
    inference: Inference
    target: str | None = None
    repairs: RepairPlan | None = None
    groups: Groups = None

    def __post_init__(self):
        self.groups = self.groups or group_columns(self.facts, self.inference, self.target)

    def prepare(self, df: DataFrame, deduplicate: bool = True) -> DataFrame:
        """PIP-2, PIP-12: steps that learn nothing, so they may run before the split."""
        if self.repairs:
            df = self.repairs.transform(df)
        df = infinite_to_null(df)
        df = S.Projection(drop=set(self.groups.drop))(df)
        if deduplicate:
            df = distinct_rows(df)
        step, taken = S.Projection(), {c.lower() for c in df.columns}
        for c in self.groups.datetime:
            step.add += [(c, take_name(n, taken), f"coalesce({e}, 0)") for n, e in date_parts(c, self.facts)]
            step.drop.add(c)
        return step(df)

    def fit(self, train: DataFrame) -> PreparedModel:
        """Statistics of prepared training rows. Each stage is one aggregate over all columns of a kind."""
        g, fams = self.groups, families(train)
        have = set(train.columns)
        of = lambda cs: [c for c in cs if c in have]     # noqa: E731
        known = set(sum(vars(g).values(), [])) | {self.target}
        parts = [c for c in train.columns if c not in known]
        logs, skewed, bell = of(g.log1p), of(g.skewed), of(g.gaussian)
        numeric = logs + skewed + bell + parts
        rows, *counts = agg_row(train, ["count(*)"] + [f"count({q(c)})" for c in train.columns])
        present = dict(zip(train.columns, counts))
        model = PreparedModel(self)

        # fills, with a 0/1 indicator that is neither capped nor scaled
        taken = {c.lower() for c in train.columns}
        how = dict.fromkeys(logs + skewed + parts, "median") | dict.fromkeys(bell, "mean")
        how |= dict.fromkeys(of(g.binary), "mode")
        fills = simple_fills(train, how, present, fams)
        fills |= {c: S.sql_value(MISSING, "text") for c in of(g.high_card) + of(g.onehot) + of(g.ordinal)
                  if fams[c] == "text"}
        step = S.Projection()
        for c in logs + skewed + bell:
            if present[c] < rows:
                step.add.append((c, take_name(f"{c}_was_missing", taken), f"cast({q(c)} IS NULL AS int)"))
        for c, literal in fills.items():
            step.replace[c] = f"coalesce({as_double(c, fams[c]) if c in numeric else q(c)}, {literal})"
        train = model.add(step, train)

        fams = families(train)
        bounds = cap_bounds(train, dict.fromkeys(logs + skewed, "winsorize"), fams)
        train = model.add(S.Projection({c: S.clip(as_double(c, fams[c]), *b) for c, b in bounds.items()}), train)
        train = model.add(S.Projection({c: f"log1p({q(c)})" for c in logs}), train)
        kinds = dict.fromkeys(logs + skewed, "robust") | dict.fromkeys(bell + parts, "standard")
        train = model.add(S.Projection(scale_expressions(train, kinds, families(train))), train)

        fams = families(train)
        coded = of(g.binary) + of(g.ordinal) + of(g.onehot) + of(g.high_card)

        def sparse(c: str) -> None:
            for piece in S.sparse_one_hot(train, c, fams[c], taken):
                model.add(piece, train)
            model.log.append(f"{c!r} has {seen[c][0]} values: its indicators are one sparse column")

        def share(c: str) -> None:
            piece = S.frequency(train, c, totals[c], seen[c][1], fams[c])
            if isinstance(piece, S.Projection):
                last.replace.update(piece.replace)
            else:
                model.add(piece, train)

        seen = S.distinct_values(train, coded, S.LITERAL_VALUES)
        totals = dict(zip(coded, agg_row(train, [f"count({q(c)})" for c in coded])))
        last = S.Projection()
        for c in of(g.binary):
            n, values = seen[c]
            if n > S.ONE_HOT_VALUES:
                sparse(c)
            elif n <= 2:
                # the first sorted value is 0; anything else, seen or not, follows the one-indicator convention
                second = f"{q(c)} = {S.sql_value(values[1], fams[c])}" if len(values) == 2 else "false"
                last.replace[c] = f"cast(coalesce({second}, false) AS int)"
            else:
                last.add += S.one_hot(c, [""] + values, fams[c], taken)
                last.drop.add(c)
        for c in of(g.ordinal):
            if seen[c][0] > S.LITERAL_VALUES:
                model.add(S.ranked_codes(train, c, fams[c]), train)
                continue
            codes = S.ordinal_codes(seen[c][1], self.facts.columns[c].ordinal_order, MISSING)
            last.replace[c] = S.code_expression(q(c), codes, fams[c], "-1")
        for c in of(g.onehot):
            if seen[c][0] > S.ONE_HOT_VALUES:
                sparse(c)
                continue
            last.add += S.one_hot(c, seen[c][1], fams[c], taken)
            last.drop.add(c)
        for c in of(g.high_card):
            share(c)
        model.add(last, train)
        return model

    def clean_and_transform(self, df: DataFrame, test_size: float = 0.2, seed: int = 42, row_id: str | None = None):
        """With a target: (X_train, X_test, model), target kept as last column; without: (X, None, model)."""
        ready = self.prepare(df).persist()   # the split and the fit read it in many passes
        if self.target is None or self.target not in ready.columns:
            model = self.fit(ready)
            ready.unpersist()
            return model.transform(ready), None, model
        train, test = split(ready, self.target, test_size, seed, row_id)
        model = self.fit(train)
        ready.unpersist()
        return model.transform(train), model.transform(test), model


class PreparedModel:
    """Fitted steps over prepared rows."""

    def __init__(self, plan: GroupPipeline):
        self.plan = plan
        self.steps: list = []
        self.log: list[str] = []

    def add(self, step, df: DataFrame) -> DataFrame:
        if isinstance(step, S.Projection) and not step:
            return df
        self.steps.append(step)
        return step(df)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        t = self.plan.target
        return df.select(*[q(c) for c in df.columns if c != t], q(t)) if t in df.columns else df


# ---------------------------------------------------------------------- split

def class_quotas(classes: DataFrame, n: int, n_test: int) -> DataFrame:
    """`classes` (y, size) with `quota`: its share of the test rows by largest remainder, ties to the larger class, then by name."""
    exact = f"({n_test}D * size / {n}D)"
    floors = cut(classes.selectExpr("y", "size", f"cast(floor({exact}) AS bigint) AS least", f"{exact} - floor({exact}) AS rest"))
    owed = n_test - (agg_row(floors, ["sum(least)"])[0] or 0)
    order = [F.col("rest").desc(), F.col("size").desc(), F.col("y")]
    placed = ranked(floors.withColumnRenamed("size", "rows"), [], order)
    return placed.selectExpr("y", "rows", "least", f"least + cast(rank < {owed} AS int) AS quota")


def split(df: DataFrame, target: str, test_size: float = 0.2, seed: int = 42, row_id: str | None = None
          ) -> tuple[DataFrame, DataFrame]:
    """PIP-3: ceil(n x test_size) test rows, stratified by class where the classes allow it. Rows without a target are left
    out of both parts.

    A row's place depends on a seeded hash of its identity (`row_id`, else all its columns with a number for each copy), so
    the split does not depend on partitions and survives recomputation. Every class meets its quota exactly, however many
    classes there are: the hashes of all classes are ranked together in one sort by ranges of (class, hash), in which a class
    with most of the rows spans many tasks, and the hash at each class's quota is its limit. Limits of classes with more than
    one in HEAVY of the rows are broadcast, at most HEAVY of them; the others are joined by class."""
    df = df.where(f"{q(target)} IS NOT NULL")
    fams = families(df)
    hashed = df.withColumn("__i", F.expr(q(row_id))) if row_id else numbered_copies(df, "to_json(struct(*))", "__i")
    hashed = hashed.withColumn("__h", F.expr(hash_order("__i", seed))).drop("__i")
    y = f"cast({q(target)} AS string)"
    classes = cut(hashed.groupBy(F.expr(y).alias("y")).agg(F.count("*").alias("size")))
    n, found, least = agg_row(classes, ["coalesce(sum(size), 0)", "count(*)", "min(size)"])
    n_test = math.ceil(n * test_size)
    numeric = fams[target] in ("integer", "real", "boolean")
    if not n_test:
        return _parts(hashed, "false")
    if not (0 < found <= min(n_test, n - n_test) and least >= 2 and (not numeric or found <= 20)):
        limit = order_statistics(hashed, {"": ("cast(__h AS double)", [n_test - 1])}, {"": n})[""][n_test - 1]
        return _parts(hashed, f"cast(__h AS double) <= {double(limit)}")
    quotas = cut(class_quotas(classes, n, n_test).where("quota > 0"))
    near = ranked(hashed.select(F.expr(y).alias("y"), "__h"), ["y"], [F.col("__h")]).where(f"rank + 1 - floor({n_test}D * size / {n}D) IN (0, 1)")
    limits = cut(near.join(quotas, "y").where("rank + 1 = quota").selectExpr("y AS __y", "rows AS __rows", "__h AS __limit"))
    heavy = limits.where(f"__rows > {n // HEAVY}").select("__y", "__limit")
    placed = (hashed.withColumn("__y", F.expr(y)).join(F.broadcast(heavy), "__y", "left"))
    light = limits.where(f"__rows <= {n // HEAVY}").selectExpr("__y", "__limit AS __other")
    met = placed.where("__limit IS NOT NULL").withColumn("__other", F.lit(None).cast("long"))
    rest = placed.where("__limit IS NULL").join(light, "__y", "left")
    return _parts(met.unionByName(rest), "coalesce(__h <= coalesce(__limit, __other), false)")


HEAVY = 1_000


def _parts(hashed: DataFrame, test: str) -> tuple[DataFrame, DataFrame]:
    marked = hashed.withColumn("__test", F.expr(test))
    extra = [c for c in marked.columns if c.startswith("__")]
    return marked.where("NOT __test").drop(*extra), marked.where("__test").drop(*extra)
