"""Data-quality repair: `RepairPlanner.fit(df)` decides, `RepairPlan.transform(df)` replays.

Deciding takes a fixed number of jobs for all columns together: one aggregate for text shapes and native numbers, one
value-count shuffle for label spellings, and aggregates for sentinel codes. Replaying is one projection of literal
expressions, so it works on any table with these columns and on streams. The one exception is a label map with more
entries than fit in an expression: it stays a DataFrame and is joined, with Spark choosing broadcast or shuffle by its
measured size.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import q, text
from quern.functions.text import (
    BOOLEAN_PAIRS, CURRENCY, MISSING_TOKENS, bare_digits, bare_number, case_map, collapse, fold, folded, in_words,
    is_accounting, is_infinite, number_layers, signed_number, strip,
)
from quern.functions.types import families, family, is_binary_float
from quern.operators.facts import small_frame
from quern.operators.quantiles import agg_row, quantiles

# Numeric codes that often stand for "no data".
SENTINELS = (-999, -9999, -99999, 999, 9999, 99999, -1)
LITERAL_LABELS = 2_000     # label-map entries that may live inside an expression

# Rule names and severities.
RULES = {
    "R-QLT-01": ("Disguised Missing Values", "WARNING"),
    "R-QLT-02": ("Numeric Sentinel Codes", "WARNING"),
    "R-QLT-03": ("Numeric Stored as Text", "WARNING"),
    "R-QLT-04": ("Boolean-Like Text", "INFO"),
    "R-QLT-05": ("Category Label Inconsistency", "WARNING"),
    "R-QLT-06": ("Infinite Values", "WARNING"),
    "R-QLT-07": ("Surrounding Whitespace Stripped", "INFO"),
}
_CURRENCY_CLASS = text("[" + CURRENCY + "]")


@dataclass
class Repair:
    rule_id: str
    column: str
    affected: int
    params: dict = field(default_factory=dict)
    note: str = ""
    examples: list[tuple[str, str]] = field(default_factory=list)

    @property
    def name(self) -> str:
        return RULES[self.rule_id][0]

    @property
    def severity(self) -> str:
        return RULES[self.rule_id][1]

    def to_dict(self) -> dict:
        return {"rule_name": self.name, "severity": self.severity, **asdict(self)}


def repair_layers(rule_id: str, params: dict) -> tuple:
    """QLT-R1..R7: the replay of one rule as a chain of expression builders. No decision is left to make."""
    if rule_id == "R-QLT-07":
        return (strip,)
    if rule_id == "R-QLT-01":
        return (lambda x: f"CASE WHEN octet_length({strip(x)}) <= 64 AND {in_words(folded(x), params['tokens'])} "
                          f"THEN NULL ELSE {x} END",)
    if rule_id == "R-QLT-03":
        return number_layers()
    if rule_id == "R-QLT-04":
        return (lambda x: case_map(folded(x), {params["positive"]: "1", params["negative"]: "0"}),)
    if rule_id == "R-QLT-05":
        mapping = {k: text(v) for k, v in params["mapping"].items()}
        return (collapse,) + ((lambda x: case_map(x, mapping, x),) if mapping else ())
    if rule_id == "R-QLT-06":
        return (lambda x: f"CASE WHEN {is_infinite(x)} THEN NULL ELSE {x} END",)
    if rule_id == "R-QLT-02":
        codes = ", ".join(str(c) for c in params["codes"])
        return (lambda x: f"CASE WHEN {x} IN ({codes}) THEN NULL ELSE {x} END",)
    raise ValueError(f"unknown repair rule {rule_id}")


class RepairPlan:
    """Fitted repairs, in order, per column. `label_maps` holds the label maps too large for an expression."""

    def __init__(self, repairs: list[Repair], label_maps: dict[str, DataFrame] | None = None):
        self.repairs = repairs
        self.label_maps = label_maps or {}

    def by_column(self) -> dict[str, list[Repair]]:
        out: dict[str, list[Repair]] = {}
        for r in self.repairs:
            out.setdefault(r.column, []).append(r)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply every repair. Each step is its own projection layer, so Catalyst decides what to merge and no
        expression is pasted into the next one many times over. Columns the table lacks are skipped, and a rule
        leaves a column alone when its type is not the one the rule works on."""
        steps: dict[str, list] = {}
        for r in self.repairs:
            if r.column not in df.columns:
                continue
            chain = steps.setdefault(r.column, [])
            if r.rule_id == "R-QLT-05" and r.column in self.label_maps:
                chain.append("join")
            else:
                chain.extend((r.rule_id, layer) for layer in repair_layers(r.rule_id, r.params))
        started = families(df)
        for level in range(max((len(chain) for chain in steps.values()), default=0)):
            done = {}
            for c, chain in steps.items():
                if level >= len(chain):
                    continue
                if chain[level] == "join":
                    df = self._join_labels(df, c)
                else:
                    rule_id, layer = chain[level]
                    if self._applies(rule_id, started[c], df.schema[c].dataType):
                        done[c] = layer(q(c))
            if done:
                df = df.selectExpr(*[f"{done[c]} AS {q(c)}" if c in done else q(c) for c in df.columns])
        return df

    @staticmethod
    def _applies(rule_id: str, started: str, now) -> bool:
        if rule_id == "R-QLT-06":
            return is_binary_float(now)
        if rule_id == "R-QLT-02":
            return family(now) in ("integer", "real")
        return started == "text"

    def _join_labels(self, df: DataFrame, column: str, of: str | None = None) -> DataFrame:
        """The joined map of column `of` (default: the same) on a column. NULL is joined with nothing, so it is told apart first."""
        names, key, new = df.columns, "__spelling__", "__label__"
        labels = self.label_maps[of or column].select(F.col("spelling").alias(key), F.col("label").alias(new))
        joined = df.withColumn(key, F.expr(collapse(q(column)))).join(labels, key, "left")
        return joined.selectExpr(*[f"coalesce({new}, {key}) AS {q(c)}" if c == column else q(c) for c in names])

    def to_df(self, spark) -> DataFrame:
        s, i = pa.string(), pa.int64()
        rows = [{**r.to_dict(), "params": json.dumps(r.params, ensure_ascii=False, sort_keys=True),
                 "examples": json.dumps(r.examples, ensure_ascii=False)} for r in self.repairs]
        return small_frame(spark, rows, [("rule_id", s), ("rule_name", s), ("severity", s), ("column", s),
                                         ("affected", i), ("params", s), ("note", s), ("examples", s)])


def spellings(df: DataFrame, columns: dict[str, str], order_by: str | None = None) -> DataFrame:
    """QLT-05 groundwork: (col, folded, spelling, cnt, first, best) where `best` is the winning spelling of its folded
    group: most frequent, then first seen, then smallest. Two shuffles of distinct spellings; copies of a label combine
    on the map side. First-seen order is `order_by` where given, else the scan order."""
    names = list(columns)
    entries = ", ".join(f"{i}, {columns[c]}" for i, c in enumerate(names))
    source = df.withColumn("__at__", F.col(order_by) if order_by else F.monotonically_increasing_id())
    tall = source.selectExpr("__at__", f"stack({len(names)}, {entries}) AS (col, raw)").where("raw IS NOT NULL")
    seen = (tall.groupBy("col", "raw").agg(F.count("*").alias("cnt"), F.min("__at__").alias("first"))
            .withColumn("spelling", F.expr(collapse("raw")))
            .groupBy("col", "spelling").agg(
                F.sum("cnt").alias("cnt"), F.min("first").alias("first"),
                F.sum(F.expr("CASE WHEN raw <> spelling THEN cnt ELSE 0 END")).alias("untidy"),
                F.count("*").alias("raws"))
            .withColumn("folded", F.expr(fold("spelling"))))
    best = seen.groupBy("col", "folded").agg(
        F.min_by("spelling", F.struct(-F.col("cnt"), "first", "spelling")).alias("best"),
        F.count("*").alias("variants"))
    return seen.join(best, ["col", "folded"])


class RepairPlanner:
    """QLT-D. `order_by` names a column that fixes row order, used only to break ties between spellings and to pick
    example rows."""

    def __init__(self, order_by: str | None = None, examples: bool = True):
        self.order_by = order_by
        self.examples = examples

    def fit(self, df: DataFrame) -> RepairPlan:
        fams = families(df)
        texts = [c for c, f in fams.items() if f == "text"]
        numbers = [c for c, f in fams.items() if f in ("integer", "real")]
        shapes = self._shapes(df, texts, numbers)
        steps: dict[str, list[Repair]] = {c: [] for c in df.columns}
        labelled, parsed = [], []
        for c in texts:
            kind = self._text_rules(c, shapes[c], steps[c])
            if kind == "label":
                labelled.append(c)
            elif kind == "number":
                parsed.append(c)
        maps = self._label_rules(df, labelled, shapes, steps)
        for c in numbers:
            s = shapes[c]
            if s["inf"]:
                steps[c].append(Repair("R-QLT-06", c, s["inf"], {}, "infinities cannot be averaged; now missing"))
        self._sentinel_rules(df, numbers, parsed, shapes, steps)
        plan = RepairPlan([r for c in df.columns for r in steps[c]], maps)
        if self.examples and plan.repairs:
            self._examples(df, plan)
        return plan

    # -- one aggregate for everything that needs no earlier repair
    def _shapes(self, df: DataFrame, texts: list[str], numbers: list[str]) -> dict[str, dict]:
        out: dict[str, dict] = {c: {"inf": 0} for c in texts + numbers}
        plan = []
        for c in numbers:
            x = q(c)
            if is_binary_float(df.schema[c].dataType):
                plan.append((c, "inf", f"count_if({is_infinite(x)})"))
            plan += [(c, code, f"count_if({x} = {code})") for code in SENTINELS]
        rows, *values = agg_row(df, ["count(*)"] + [e for _, _, e in plan])
        for (c, k, _), v in zip(plan, values):
            out[c][k] = v
        for c, shape in self._text_shapes(df, texts).items():
            out[c].update(shape)
        for s in out.values():
            s["rows"] = rows
        return out

    @staticmethod
    def _text_shapes(df: DataFrame, texts: list[str]) -> dict[str, dict]:
        """Text columns are stacked to (column, text), so the expressions compile once for all of them and the
        grouped counts combine on the map side."""
        if not texts:
            return {}
        cells = df.selectExpr(f"stack({len(texts)}, {', '.join(f'{i}, {q(c)}' for i, c in enumerate(texts))}) AS (col, x)")
        cells = cells.where("x IS NOT NULL").selectExpr("col", "x", f"{strip('x')} AS s")
        # no placeholder and no yes/no word is longer than 40 bytes
        cells = cells.selectExpr("col", "x", "s", f"CASE WHEN octet_length(s) <= 40 THEN {fold('s')} END AS w",
                                 f"{bare_number('s')} AS b")
        cells = cells.selectExpr("col", "x", "s", "w", "b", f"{bare_digits('b')} AS d")
        cells = cells.selectExpr("col", "x", "s", "w", "b", "d", f"{signed_number('d')} AS v")
        plain = in_words("w", [t for t in MISSING_TOKENS if t != "unknown"])
        aggs = {
            "n": "count(*)",
            "changed": "count_if(s <> x)",
            "tokens": f"collect_set(CASE WHEN {in_words('w', MISSING_TOKENS)} THEN w END)",
            "token_rows": f"count_if({plain})",
            "unknown": "count_if(w = 'unknown')",
            "parsed": f"count_if(abs(v) < double('Infinity') AND NOT coalesce({plain}, false))",
            "zero_led": "count_if(s >= '00' AND s < ':' AND s RLIKE '^0[0-9]')",
            "money": f"count_if(v IS NOT NULL AND s RLIKE {_CURRENCY_CLASS})",
            "percent": "count_if(v IS NOT NULL AND endswith(s, '%'))",
            "bracketed": f"count_if(v IS NOT NULL AND {is_accounting('s')})",
            "thousands": "count_if(v IS NOT NULL AND contains(b, ','))",
            "rough": f"approx_count_distinct(CASE WHEN NOT coalesce({plain}, false) THEN xxhash64(s) END, 0.02)",
        }
        words = [w for pair in BOOLEAN_PAIRS for w in pair]
        aggs |= {f"is_{w}": f"count_if(w = {text(w)})" for w in words}
        found = cells.groupBy("col").agg(*[F.expr(e).alias(k) for k, e in aggs.items()]).collect()
        out = {c: dict.fromkeys(aggs, 0) for c in texts}
        for r in found:
            out[texts[r["col"]]] = {k: r[k] for k in aggs}
        return out

    @staticmethod
    def _text_rules(c: str, s: dict, steps: list[Repair]) -> str | None:
        """Whitespace, placeholders, numbers and yes/no text. Says what the column now is."""
        if not s["n"]:
            return None
        if s["changed"]:
            steps.append(Repair("R-QLT-07", c, s["changed"], {}, "surrounding whitespace split equal values"))
        keep_unknown = s["unknown"] / s["n"] >= 0.5
        nulled = s["token_rows"] + (0 if keep_unknown else s["unknown"])
        if nulled:
            tokens = sorted(t for t in s["tokens"] if not (keep_unknown and t == "unknown"))
            steps.append(Repair("R-QLT-01", c, nulled, {"tokens": tokens}, "placeholder words became missing"))
        present = s["n"] - nulled
        s["present"] = present
        if not present:
            return None
        if s["zero_led"] / present < 0.2 and s["parsed"] / present >= 0.9:
            removed = [label for key, label in (("money", "currency signs"), ("thousands", "thousands separators"),
                                                ("percent", "percent sign, value kept as written"),
                                                ("bracketed", "accounting parentheses, read as negative")) if s[key]]
            lost = present - s["parsed"]
            steps.append(Repair("R-QLT-03", c, present, {}, f"{s['parsed']} of {present} values are numbers"
                                + (f"; removed {', '.join(removed)}" if removed else "")
                                + (f"; {lost} unreadable value(s) became missing" if lost else "")))
            return "number"
        for positive, negative in BOOLEAN_PAIRS:
            yes, no = s[f"is_{positive}"], s[f"is_{negative}"]
            if yes and no and yes + no == present:
                steps.append(Repair("R-QLT-04", c, present, {"positive": positive, "negative": negative},
                                    f"{positive}/{negative} text mapped to 1/0"))
                return "boolean"
        return "label" if present >= 2 else None

    # -- one shuffle of spellings for all remaining text columns
    def _label_rules(self, df: DataFrame, columns: list[str], shapes: dict, steps: dict) -> dict[str, DataFrame]:
        if not columns:
            return {}
        exprs = {}
        for c in columns:
            x = q(c)
            nulls = [r.params["tokens"] for r in steps[c] if r.rule_id == "R-QLT-01"]
            word = f"CASE WHEN octet_length({strip(x)}) <= 40 THEN {folded(x)} END"
            kept = f"CASE WHEN coalesce({in_words(word, nulls[0])}, false) THEN NULL ELSE {x} END" if nulls else x
            exprs[c] = strip(kept) if any(r.rule_id == "R-QLT-07" for r in steps[c]) else kept
        repetitive = self._repetitive(df, exprs, shapes)
        if not repetitive:
            return {}
        # one row per distinct spelling; read twice below
        found = spellings(df, {c: exprs[c] for c in repetitive}, self.order_by).persist()
        # rows whose text changes: every row of a losing spelling, and untidy rows of a winning one
        totals = found.groupBy("col").agg(
            F.sum(F.expr("CASE WHEN spelling <> best THEN cnt ELSE untidy END")).alias("changed"),
            F.count_if(F.expr("spelling <> best")).alias("mapped"),
            F.count_distinct(F.expr("CASE WHEN variants > 1 THEN folded END")).alias("groups"))
        per_column = {repetitive[r["col"]]: r for r in totals.collect() if r["changed"]}
        small = [c for c, r in per_column.items() if r["mapped"] <= LITERAL_LABELS]
        entries: dict[str, dict[str, str]] = {c: {} for c in small}
        if any(per_column[c]["mapped"] for c in small):
            indexes = [repetitive.index(c) for c in small]
            wanted = found.where(F.col("col").isin(indexes) & (F.col("spelling") != F.col("best")))
            for r in wanted.select("col", "spelling", "best").collect():
                entries[repetitive[r["col"]]][r["spelling"]] = r["best"]
        maps = {}
        for c, r in per_column.items():
            params: dict = {"mapping": dict(sorted(entries[c].items()))} if c in entries else {"mapping_rows": r["mapped"]}
            if c not in entries:
                maps[c] = (found.where((F.col("col") == repetitive.index(c)) & (F.col("spelling") != F.col("best")))
                           .select("spelling", F.col("best").alias("label")))
            steps[c].append(Repair("R-QLT-05", c, r["changed"], params,
                                   f"{r['groups']} group(s) of labels differed only by case or spacing"))
        if not maps:
            found.unpersist()
        return maps

    @staticmethod
    def _repetitive(df: DataFrame, exprs: dict[str, str], shapes: dict) -> list[str]:
        """Columns with at most one distinct value per two cells. The approximate count of the first job settles clear
        cases on long columns; short columns and columns near the boundary are counted exactly."""
        names = list(exprs)
        keep, close = [], []
        for c in names:
            share = shapes[c]["rough"] / shapes[c]["present"]
            if shapes[c]["present"] < 1_000 or 0.4 < share <= 0.6:
                close.append(c)
            elif share <= 0.4:
                keep.append(c)
        if close:
            entries = ", ".join(f"{i}, xxhash64({exprs[c]}), {exprs[c]} IS NOT NULL" for i, c in enumerate(close))
            tall = df.selectExpr(f"stack({len(close)}, {entries}) AS (col, h, ok)").where("ok")
            exact = {r["col"]: r["count"] for r in
                     tall.groupBy("col", "h").agg(F.lit(1)).groupBy("col").count().collect()}
            keep += [c for i, c in enumerate(close) if exact.get(i, 0) / shapes[c]["present"] <= 0.5]
        return [c for c in names if c in keep]

    def _sentinel_rules(self, df, numbers, parsed, shapes, steps) -> None:
        if parsed:
            done = [r for c in parsed for r in steps[c]]
            numeric = RepairPlan(done).transform(df.select(*[q(c) for c in parsed]))
            counts = agg_row(numeric, [f"count_if({q(c)} = {code})" for c in parsed for code in SENTINELS])
            for i, c in enumerate(parsed):
                shapes[c].update(zip(SENTINELS, counts[i * len(SENTINELS):]))
        suspects = {}
        for c in numbers + parsed:
            rows = shapes[c]["rows"]
            codes = [code for code in SENTINELS if shapes[c][code] and shapes[c][code] / rows >= 0.01]
            if codes:
                suspects[c] = codes
        if not suspects:
            return
        source = RepairPlan([r for c in suspects if c in parsed for r in steps[c]]).transform(
            df.select(*[q(c) for c in suspects]))
        source = source.selectExpr(*[f"cast({q(c)} AS double) AS {q(c)}" for c in suspects])
        listed = ", ".join(str(code) for code in SENTINELS)
        rest = {c: f"CASE WHEN {q(c)} NOT IN ({listed}) AND abs({q(c)}) < double('Infinity') THEN {q(c)} END"
                for c in suspects}
        names = list(suspects)
        flat = agg_row(source, [e for c in names for e in (f"count({rest[c]})", f"min({rest[c]})")])
        enough = {c: (flat[2 * i], flat[2 * i + 1]) for i, c in enumerate(names) if flat[2 * i] >= 4}
        quant = quantiles(source, {c: (rest[c], [0.25, 0.75]) for c in enough}, {c: n for c, (n, _) in enough.items()})
        for c, (_, low) in enough.items():
            q25, q75 = quant[c][0.25], quant[c][0.75]
            fence_low, fence_high = q25 - 3 * (q75 - q25), q75 + 3 * (q75 - q25)
            codes = [code for code in suspects[c]
                     if not (code == -1 and low < 0) and not fence_low <= code <= fence_high]
            if codes:
                steps[c].append(Repair("R-QLT-02", c, sum(shapes[c][code] for code in codes), {"codes": codes},
                                       f"code(s) {codes} lie beyond 3 x IQR and repeat in at least 1 % of rows"))

    def _examples(self, df: DataFrame, plan: RepairPlan) -> None:
        """QLT-E: up to three cells for each rule of each column, as they were before the rule and after it, from one job. A column
        keeps its state after every rule; the first rows of each rule are picked on the map side and again after one shuffle."""
        at, k = "__row__", 3
        by_column = {c: rs for c, rs in plan.by_column().items() if c in df.columns}
        if not by_column:
            return
        order = F.col(self.order_by) if self.order_by else F.monotonically_increasing_id()
        state = df.select(order.alias(at), *(F.col(q(c)).alias(f"now {i}") for i, c in enumerate(by_column)))
        chains = []     # of each column: (place of the rule, layer or None for a joined map, whether the rule ends here)
        for c, rs in by_column.items():
            layers = [[None] if r.rule_id == "R-QLT-05" and c in plan.label_maps else list(repair_layers(r.rule_id, r.params)) for r in rs]
            chains.append([(j, layer, n == len(chain) - 1) for j, chain in enumerate(layers) for n, layer in enumerate(chain)])
        state = state.selectExpr("*", *[f"cast(`now {i}` AS string) AS `cell {i} 0`" for i in range(len(chains))])
        for level in range(max(len(chain) for chain in chains)):
            done, ends = {}, []
            for i, (c, chain) in enumerate(zip(by_column, chains, strict=True)):
                if level < len(chain):
                    j, layer, last = chain[level]
                    if layer is None:
                        state = plan._join_labels(state, f"now {i}", c)
                    else:
                        done[f"now {i}"] = layer(f"`now {i}`")
                    ends += [(i, j)] if last else []
            state = state.selectExpr(*[f"{done[n]} AS {q(n)}" if n in done else q(n) for n in state.columns])
            state = state.selectExpr("*", *[f"cast(`now {i}` AS string) AS `cell {i} {j + 1}`" for i, j in ends])
        rules = [(i, j, r) for i, rs in enumerate(by_column.values()) for j, r in enumerate(rs)]
        entries = ", ".join(f"{n}, `cell {i} {j}`, `cell {i} {j + 1}`" for n, (i, j, _) in enumerate(rules))
        cells = state.selectExpr(at, f"stack({len(rules)}, {entries}) AS (rule, before, after)")
        changed = cells.where("before IS NOT NULL AND NOT (before <=> after)")
        first = changed.withColumn("rk", F.row_number().over(Window.partitionBy("rule").orderBy(at))).where(f"rk <= {k}")
        for r in first.orderBy("rule", "rk").collect():
            rules[r["rule"]][2].examples.append((r["before"], r["after"]))


def repair(df: DataFrame, order_by: str | None = None) -> tuple[DataFrame, RepairPlan]:
    plan = RepairPlanner(order_by).fit(df)
    return plan.transform(df), plan
