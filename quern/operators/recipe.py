"""REC-*: a recipe fits statistics on a table and returns a model of literal steps.

Fitting follows execution order, because each step's statistics describe the column as the previous step left it:
rows and columns, dates, fills, caps, scales, encodings. Each stage is one or two aggregates for all columns together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import dates
from quern.functions.names import double, q, take_name
from quern.functions.types import as_double, families, infinite_to_null, is_binary_float
from quern.operators import steps as S
from quern.operators.duplicates import Repeats, distinct_rows
from quern.operators.facts import DatasetFacts
from quern.operators.inference import Inference
from quern.operators.knn import KnnFill
from quern.operators.power import fit_lambdas, yeo_johnson
from quern.operators.profile import ordinal_order
from quern.operators.quantiles import agg_row, quantiles

MISSING = "Missing"
IMPUTATIONS = {"median", "mean", "mode", "constant", "knn", "drop_rows", "none"}
ENCODINGS = {"onehot", "frequency", "ordinal", "binary", "none"}
OUTLIERS = {"winsorize", "clip_iqr", "zscore", "none"}
SCALINGS = {"standard", "robust", "log1p", "none"}
RULE_STEPS = {"impute_median": "median", "impute_mean": "mean", "impute_mode": "mode", "impute_constant": "constant",
              "impute_knn_or_iterative": "knn", "encode_binary": "binary", "encode_onehot": "onehot",
              "encode_frequency_or_target": "frequency", "encode_ordinal": "ordinal", "transform_log1p": "log1p",
              "transform_yeo_johnson": "yeo_johnson", "scale_standard": "standard"}


@dataclass
class Override:
    """REC-0: choices for one column. None and "auto" leave the choice to the rules."""
    drop: bool | None = None
    imputation: str | None = None
    impute_value: object = None
    encoding: str | None = None
    outliers: str | None = None
    scaling: str | None = None

    def __post_init__(self):
        for name, allowed in (("imputation", IMPUTATIONS), ("encoding", ENCODINGS), ("outliers", OUTLIERS),
                              ("scaling", SCALINGS)):
            value = getattr(self, name)
            if value in (None, "auto"):
                setattr(self, name, None)
            elif value not in allowed:
                raise ValueError(f"unknown {name} {value!r}; use one of {sorted(allowed)}")


@dataclass
class RecipeModel:
    """Fitted steps in order. `transform` replays them; streams skip the row steps that need the whole table."""
    row_steps: list = field(default_factory=list)      # drop rows without a target, duplicates
    steps: list = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    target: str | None = None

    def transform(self, df: DataFrame, rows: bool = True) -> DataFrame:
        df = infinite_to_null(df)
        for step in self.row_steps:
            if rows or getattr(step, "streamable", False):
                df = step(df)
        for step in self.steps:
            df = step(df)
        if self.target in df.columns:
            df = df.select(*[q(c) for c in df.columns if c != self.target], q(self.target))
        return df


class DropDuplicates:
    """REC-3: rows that agree on every remaining column are equal, so keeping any one keeps the same value. The table seen last is
    remembered with its filter of repeated rows, so that fitting and transforming one table looks for them once."""
    streamable = False

    def __init__(self) -> None:
        self.seen: tuple[DataFrame, Repeats] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.seen is None or not df.sameSemantics(self.seen[0]):
            self.seen = (df, Repeats(df))
        return distinct_rows(df, self.seen[1])


@dataclass
class DropMissing:
    column: str
    streamable = True

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(q(self.column)).isNotNull()) if self.column in df.columns else df


@dataclass
class Recipe:
    overrides: dict[str, Override] = field(default_factory=dict)
    drop_duplicates: bool = True
    target: str | None = None

    def __post_init__(self):
        self.overrides = {c: o if isinstance(o, Override) else Override(**o) for c, o in self.overrides.items()}

    def _override(self, column: str) -> Override:
        return self.overrides.get(column) or Override()

    # ------------------------------------------------------------------ choices
    def _choice(self, column: str, kind: str, rule: str | None) -> str | None:
        chosen = getattr(self._override(column), kind)
        return chosen if chosen is not None else RULE_STEPS.get(rule or "")

    def fit(self, df: DataFrame, facts: DatasetFacts | None = None, inference: Inference | None = None) -> RecipeModel:
        """Without facts and inference the overrides alone decide."""
        facts = facts or DatasetFacts(0, {})
        inference = inference or Inference({}, [], [], {})
        if self.target is not None and self.target not in df.columns:
            raise ValueError(f"target column {self.target!r} is not in the table")
        recs = inference.recommendations
        fams = families(df)
        for c, o in self.overrides.items():
            if o.imputation in ("median", "mean") and fams.get(c) in ("text", "time", "other"):
                raise ValueError(f"{o.imputation} imputation needs a numeric column; {c!r} is {fams[c]}")
        model = RecipeModel(target=self.target)
        self._log_infinities(df, model)
        df = infinite_to_null(df)

        df = self._prune(df, recs, model)
        if self.target is not None:
            df = self._rows(df, DropMissing(self.target), model, "rows without a target dropped")
        if self.drop_duplicates:
            df = self._rows(df, DropDuplicates(), model, "duplicate rows dropped")
        staged = df = df.persist()   # the passes below read these rows, not the shuffle that made them distinct
        df = self._dates(df, facts, recs, model)
        for c in self._features(df):
            if self._override(c).imputation == "drop_rows":
                df = self._rows(df, DropMissing(c), model, f"rows without {c!r} dropped", late=True)
        df = self._fill(df, facts, recs, model)
        df = self._cap(df, recs, model)
        df = self._scale(df, recs, model)
        self._encode(df, facts, recs, model)
        staged.unpersist()
        if self.target is not None:
            model.log.append(f"target {self.target!r} left as it is and moved last")
        return model

    def _features(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c != self.target]

    # ------------------------------------------------------------------ rows, columns, dates
    @staticmethod
    def _log_infinities(df: DataFrame, model: RecipeModel) -> None:
        floats = [f.name for f in df.schema.fields if is_binary_float(f.dataType)]
        n = sum(agg_row(df, [f"count_if(abs({q(c)}) = double('Infinity'))" for c in floats]))
        if n:
            model.log.append(f"{n} infinite value(s) became missing")

    def _rows(self, df: DataFrame, step, model: RecipeModel, note: str, late: bool = False) -> DataFrame:
        (model.steps if late else model.row_steps).append(step)
        model.log.append(note)
        return step(df)

    def _prune(self, df: DataFrame, recs, model: RecipeModel) -> DataFrame:
        drop = [c for c in self._features(df) if (self._override(c).drop if self._override(c).drop is not None
                                                  else c in recs and recs[c].should_drop)]
        if not drop:
            return df
        if len(drop) >= len(self._features(df)):
            model.log.append("pruning skipped: it would remove every feature")
            return df
        model.log.append(f"{len(drop)} column(s) dropped: {', '.join(drop)}")
        model.row_steps.append(S.Projection(drop=set(drop)))
        return model.row_steps[-1](df)

    def _dates(self, df: DataFrame, facts: DatasetFacts, recs, model: RecipeModel) -> DataFrame:
        step = S.Projection()
        taken = {c.lower() for c in df.columns}
        for c in self._features(df):
            if c in recs and recs[c].datetime:
                step.add += [(c, take_name(n, taken), e) for n, e in date_parts(c, facts)]
                step.drop.add(c)
                model.log.append(f"{c!r} split into calendar parts")
        if step:
            model.steps.append(step)
            return step(df)
        return df

    # ------------------------------------------------------------------ fills
    def _fill(self, df: DataFrame, facts: DatasetFacts, recs, model: RecipeModel) -> DataFrame:
        fams = families(df)
        features = self._features(df)
        rows, *counts = agg_row(df, ["count(*)"] + [f"count({q(c)})" for c in features])
        present = dict(zip(features, counts))
        numeric = [c for c in features if fams[c] in ("integer", "real", "boolean")]
        chosen: dict[str, str] = {}
        for c in features:
            rec = recs.get(c)
            how = self._choice(c, "imputation", rec.imputation if rec else None)
            if present[c] < rows and how not in ("none", "drop_rows"):
                if how is None:
                    how = "median" if c in numeric else "constant"
                if how == "knn" and (c not in numeric or len(numeric) < 2):
                    how = "median" if c in numeric else "mode"
                chosen[c] = how
        taken = {c.lower() for c in df.columns}
        before = S.Projection()
        for c in chosen:
            rec = recs.get(c)
            if rec and rec.add_indicator:
                before.add.append((c, take_name(f"{c}_was_missing", taken), f"cast({q(c)} IS NULL AS int)"))
        knn = [c for c, how in chosen.items() if how == "knn" and present[c]]
        if knn:
            # the indicators are columns of their own; they are not distances
            if before:
                model.steps.append(before)
                df = before(df)
            step = KnnFill.fit(df, knn, numeric)
            model.steps.append(step)
            model.log.append(f"nearest-neighbour fill of {', '.join(knn)}")
            df, before = step(df), S.Projection()

        simple = {c: how for c, how in chosen.items() if c not in knn}
        fills = simple_fills(df, simple, present, fams, {c: self._override(c).impute_value for c in simple})
        # a NULL that first appears in new data falls back to the fitted median, or the missing token
        for c in features:
            if c in fills or self._override(c).imputation == "none":
                continue
            if c in knn or (c in numeric and c in facts.columns and facts.columns[c].median is not None):
                value = facts.columns[c].median if c in facts.columns else None
                fills.setdefault(c, S.sql_value(value, "real") if value is not None else "0")
            elif fams[c] == "text":
                fills[c] = S.sql_value(MISSING, "text")
        step = S.Projection(add=before.add)
        for c, literal in fills.items():
            x = as_double(c, fams[c]) if c in numeric and not literal.lstrip("-").isdigit() else q(c)
            if c not in simple and c not in knn:
                x = q(c)
                literal = f"cast({literal} AS {df.schema[c].dataType.simpleString()})" if c in numeric else literal
            step.replace[c] = f"coalesce({x}, {literal})"
        for c, how in simple.items():
            model.log.append(f"{c!r} filled by {how} ({fills[c]})")
        if step:
            model.steps.append(step)
            df = step(df)
        return df

    # ------------------------------------------------------------------ caps and scales
    def _cap(self, df: DataFrame, recs, model: RecipeModel) -> DataFrame:
        fams = families(df)
        how = {}
        for c in self._features(df):
            if fams[c] not in ("integer", "real"):
                continue
            rule = "winsorize" if c in recs and "mitigate_outliers" in recs[c].scaling else None
            choice = self._override(c).outliers or rule
            if choice and choice != "none":
                how[c] = choice
        step = S.Projection(replace={c: S.clip(as_double(c, fams[c]), *b)
                                     for c, b in cap_bounds(df, how, fams).items()})
        for c in step.replace:
            model.log.append(f"{c!r} capped ({how[c]})")
        if step:
            model.steps.append(step)
            df = step(df)
        return df

    def _scale(self, df: DataFrame, recs, model: RecipeModel) -> DataFrame:
        fams = families(df)
        plans: dict[str, list[str]] = {}
        for c in self._features(df):
            if fams[c] not in ("integer", "real"):
                continue
            choice = self._override(c).scaling
            if choice is not None:
                plans[c] = [choice] if choice != "none" else []
            elif c in recs:
                plans[c] = [RULE_STEPS[a] for a in recs[c].scaling if a in RULE_STEPS]
        for level in range(max((len(p) for p in plans.values()), default=0)):
            how = {c: p[level] for c, p in plans.items() if level < len(p)}
            step = S.Projection(replace=scale_expressions(df, how, fams))
            for c in step.replace:
                model.log.append(f"{c!r} scaled ({how[c]})")
            if step:
                model.steps.append(step)
                df = step(df)
        return df

    # ------------------------------------------------------------------ encodings
    def _encode(self, df: DataFrame, facts: DatasetFacts, recs, model: RecipeModel) -> None:
        fams = families(df)
        how = {}
        for c in self._features(df):
            choice = self._choice(c, "encoding", recs[c].encoding if c in recs else None)
            if choice and choice != "none":
                how[c] = choice
        if not how:
            return
        names = list(how)
        seen = S.distinct_values(df, names, S.LITERAL_VALUES)
        totals = dict(zip(names, agg_row(df, [f"count({q(c)})" for c in names])))
        taken = {c.lower() for c in df.columns}
        step, hot = S.Projection(), []
        for c, choice in how.items():
            n, values = seen[c]
            if choice == "binary" and n > 2:
                model.log.append(f"{c!r} has {n} values: ordinal codes on sorted values instead of binary")
                choice = "sorted"
            if n > S.LITERAL_VALUES and choice in ("ordinal", "sorted"):
                model.steps.append(S.ranked_codes(df, c, fams[c]))
            elif choice == "frequency":
                piece = S.frequency(df, c, totals[c], values, fams[c])
                if isinstance(piece, S.Projection):
                    step.replace.update(piece.replace)
                else:
                    model.steps.append(piece)
            elif choice == "binary":
                step.replace[c] = S.code_expression(q(c), S.binary_codes(values, fams[c]), fams[c], "-1")
            elif choice in ("ordinal", "sorted"):
                order = ordinal_order([v for v in values if v != MISSING]) if choice == "ordinal" else None
                step.replace[c] = S.code_expression(q(c), S.ordinal_codes(values, order, MISSING), fams[c], "-1")
            elif choice == "onehot" and n > S.ONE_HOT_VALUES:
                model.steps += S.sparse_one_hot(df, c, fams[c], taken)
                model.log.append(f"{c!r} has {n} values: its indicators are one sparse column")
            elif choice == "onehot":
                hot.append(c)
                step.add += S.one_hot(c, values, fams[c], taken)
                step.drop.add(c)
            if choice != "sorted":
                model.log.append(f"{c!r} encoded ({choice})")
        if step:
            model.steps.append(step)


# ---------------------------------------------------------------------- fitted pieces, also used by grouped preparation

def date_parts(column: str, facts: DatasetFacts) -> list[tuple[str, str]]:
    """REC-4 feature names and SQL for one datetime column."""
    f = facts.columns[column]
    ts = (dates.parse_date(q(column), f.day_first, f.mixed_offsets) if f.is_date_text
          else f"cast({q(column)} AS timestamp_ntz)")
    return dates.calendar_parts(ts, column, f.has_time)


def simple_fills(df: DataFrame, how: dict[str, str], present: dict[str, int], fams: dict[str, str],
                 constants: dict[str, object] | None = None) -> dict[str, str]:
    """REC-7: a SQL literal per column. One aggregate for means, one quantile pass for medians, one value-count
    shuffle for modes. An empty column gets 0, or Unknown for a text mode."""
    out: dict[str, str] = {}
    numeric = {c for c in how if fams[c] in ("integer", "real", "boolean")}
    medians = [c for c, h in how.items() if h == "median"]
    means = [c for c, h in how.items() if h == "mean"]
    by_mode = [c for c, h in how.items() if h == "mode"]
    q50 = quantiles(df, {c: (as_double(c, fams[c]), [0.5]) for c in medians}, {c: present[c] for c in medians})
    averages = dict(zip(means, agg_row(df, [f"avg({as_double(c, fams[c])})" for c in means])))
    top = S.modes(df, by_mode, present)
    for c, h in how.items():
        if h == "median":
            value = q50[c][0.5]
            out[c] = double(value) if value is not None else "0"
        elif h == "mean":
            out[c] = double(averages[c]) if averages[c] is not None else "0"
        elif h == "mode":
            value = top[c] if top[c] is not None else ("0" if c in numeric else "Unknown")
            out[c] = S.sql_value(value, fams[c])
        elif h == "constant":
            value = (constants or {}).get(c)
            if value is None:
                value = 0 if c in numeric else MISSING
            if c in numeric:
                out[c] = str(int(float(value))) if float(value).is_integer() else double(float(value))
            else:
                out[c] = S.sql_value(value, "text")
            if fams[c] == "boolean":
                out[c] = S.sql_value(value, "boolean")
    return out


def cap_bounds(df: DataFrame, how: dict[str, str], fams: dict[str, str]) -> dict[str, tuple[float, float]]:
    """REC-8: lower and upper cap per column."""
    wanted = {"winsorize": [0.01, 0.99], "clip_iqr": [0.25, 0.75]}
    quant = quantiles(df, {c: (as_double(c, fams[c]), wanted[h]) for c, h in how.items() if h in wanted})
    z = [c for c, h in how.items() if h == "zscore"]
    spread = agg_row(df, [f"{a}({as_double(c, fams[c])})" for c in z for a in ("avg", "stddev_samp")])
    out = {}
    for c, values in quant.items():
        low, high = values.values()
        if low is None:
            continue
        if how[c] == "clip_iqr":
            low, high = low - 1.5 * (high - low), high + 1.5 * (high - low)
        out[c] = (low, high)
    for i, c in enumerate(z):
        mean, std = spread[2 * i:2 * i + 2]
        if std:
            out[c] = (mean - 3 * std, mean + 3 * std)
    return out


def scale_expressions(df: DataFrame, how: dict[str, str], fams: dict[str, str]) -> dict[str, str]:
    """REC-9, REC-10. Population spread for standard scaling; log1p only where every value is at least 0."""
    views = {c: as_double(c, fams[c]) for c in how}
    of = lambda kind: [c for c, h in how.items() if h == kind]
    out: dict[str, str] = {}
    logs = of("log1p")
    for c, low in zip(logs, agg_row(df, [f"min({views[c]})" for c in logs])):
        if low is not None and low >= 0:
            out[c] = f"log1p({views[c]})"
    bell = of("standard")
    flat = agg_row(df, [f"{a}({views[c]})" for c in bell for a in ("avg", "stddev_pop")])
    for i, c in enumerate(bell):
        if flat[2 * i] is not None:
            out[c] = S.standard(views[c], *flat[2 * i:2 * i + 2])
    rob = of("robust")
    for c, v in quantiles(df, {c: (views[c], [0.25, 0.5, 0.75]) for c in rob}).items():
        if v[0.5] is not None:
            out[c] = S.robust(views[c], v[0.5], v[0.75] - v[0.25])
    power = of("yeo_johnson")
    lambdas = fit_lambdas(df, {c: views[c] for c in power})
    bent = {c: yeo_johnson(views[c], lam) for c, lam in lambdas.items()}
    flat = agg_row(df, [f"{a}({bent[c]})" for c in power for a in ("avg", "stddev_pop")])
    for i, c in enumerate(power):
        if flat[2 * i] is not None:
            out[c] = S.standard(f"({bent[c]})", *flat[2 * i:2 * i + 2])
    return out


def run_recipe(df: DataFrame, facts: DatasetFacts, inference: Inference, recipe: Recipe | None = None
               ) -> tuple[DataFrame, RecipeModel]:
    recipe = recipe or Recipe()
    model = recipe.fit(df, facts, inference)
    return model.transform(df), model


def recipe_report(before: DataFrame, after: DataFrame, model: RecipeModel, order_by: str | None = None) -> dict:
    """REC-16: shapes, missing cells, steps and a preview of 50 rows."""
    from quern.sources.sinks import preview

    def shape(df: DataFrame) -> tuple[list[int], int]:
        rows, *missing = agg_row(df, ["count(*)"] + [f"count_if({q(c)} IS NULL)" for c in df.columns])
        return [rows, len(df.columns)], sum(missing)
    initial, initial_missing = shape(before)
    final, final_missing = shape(after)
    return {"initial_shape": initial, "final_shape": final, "initial_missing_cells": initial_missing,
            "final_missing_cells": final_missing, "steps_executed": list(model.log),
            "preview": [r.asDict() for r in preview(after, order_by).collect()]}
