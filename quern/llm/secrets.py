"""Operator 4: secrets in every version of every file, by an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,begin:long,finish:long>>"
LEDGER = f"blob string, version string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """`pattern`: leftmost non-overlapping matches. Where `group` is given, matches whose group has fewer than `least` characters
    are dropped after matching, so what they have consumed stays consumed."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# A private key: all up to the END line, which is the next five dashes. Where END is missing, the lines of base64 that follow with
# their headers, and up to two last shorter ones. Lines may be quoted, or broken by a written-out \n.
_BREAK = r"(?:[\s>\x22\x27,]|\\[nrt])++"
_KEY = (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?>[\s\S]*?-----)END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
        rf"|(?:{_BREAK}[A-Z][A-Za-z-]*+:\x20[^\r\n\\]*+)*+(?:{_BREAK}[A-Za-z0-9+/=]{{40,}}+)++(?:{_BREAK}[A-Za-z0-9+/=]++(?=[\x22\x27,]*+(?:[\r\n\\]|\z))){{0,2}}+"
        rf"|(?:{_BREAK}[A-Za-z0-9+/=]{{16,}}+)*+)")

# The formats of secrets. The first three are the base; the others add spans.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", _KEY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]*:[^\x00-\x20/@]{3,}@"),
)
VERSION = "1.1"
SALTS = 16


def _spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in code points: what lies between matches gives their places. A text without a match is looked at once."""
    pattern = F.lit(rule.pattern)
    between, found = F.split(text, rule.pattern), F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.transform(F.arrays_zip(between.alias("gap"), found.alias("all"), value.alias("value")),
                        lambda p: F.struct(F.length(p["gap"]).cast("long").alias("gap"), F.length(p["all"]).cast("long").alias("size"), F.length(p["value"]).alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))
    span = lambda acc, p: F.struct(F.lit(rule.kind).alias("kind"), (acc["at"] + p["gap"]).alias("begin"), (acc["at"] + p["gap"] + p["size"]).alias("finish"))
    walked = F.aggregate(F.filter(steps, lambda p: p["size"].isNotNull()), start, lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + p["size"]).alias("at"),
        F.when(p["value"] >= rule.least, F.array_append(acc["out"], span(acc, p))).otherwise(acc["out"]).alias("out")), lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(SPANS))


def found_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start and then by the order of rules."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    every = F.concat(*(_spans(text, r) for r in rules))
    keyed = F.transform(every, lambda s: F.struct(s["begin"], order[s["kind"]].alias("rule"), s["finish"], s["kind"]))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"], s["begin"], s["finish"]))


def address(text: Column) -> Column:
    """A blob's name: the SHA-256 of its content. NULL is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_new(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Ledger entries (blob, version of the rules, spans) for the blobs of `versions` that the ledger lacks under this version of the
    rules. However many paths and commits hold a blob, it is scanned once. Append the result to the ledger."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blobs = versions.select(address(content).alias("blob"), content.alias("t")).groupBy("blob").agg(F.first("t").alias("t"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("version") == version).select("blob").distinct(), "blob", "left_anti")
    return blobs.select("blob", F.lit(version).alias("version"), found_spans(F.col("t"), rules).alias("spans"))


def join_back(versions: DataFrame, entries: DataFrame, columns: dict[str, str], text: str = "text", version: str = VERSION) -> DataFrame:
    """The wanted columns of every row of `versions` under new names, with `blob` and the blob's `spans` from the ledger's entries,
    which must know every blob. Only entries with spans are joined; rows of a blob are spread over SALTS keys."""
    own = versions.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()), address(F.col(f"`{text}`")).alias("blob"))
    own = own.withColumn("salt", F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int"))
    hits = entries.where((F.col("version") == version) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.join(salted, ["blob", "salt"], "left").select(*columns, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["finish"])), ",")


def secret_findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ledger: DataFrame | None = None,
                    rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """One row per row of `docs` (a path, a document or one version of it): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Every text is addressed by its content; only blobs that `ledger` lacks for this version of the rules are scanned (see
    scan_new), and findings are joined back to all rows with the blob. Spans are `kind:start:end` in code points, end exclusive,
    by start and then kind, comma-joined; base_sha256 is over the spans of the first three rules.

    A NULL text is empty. A NULL id stays NULL, repeated rows have equal findings, other columns are ignored, no rows give no rows."""
    new = scan_new(docs, text, ledger, rules, version)
    entries = new if ledger is None else new.unionByName(ledger.select("blob", "version", "spans"))
    met = join_back(docs, entries, {"doc_id": doc_id}, text, version)
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in RULES[:3])))
    return met.select("doc_id", _count("assign").alias("n_assign"), _count("access").alias("n_access"), _count("hex").alias("n_hex"),
                      F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with every span in `text` replaced by `mark`; spans that overlap become one mark. Other columns and NULL texts stay."""
    names = ["blob_of_row", "spans_of_row"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    blob, spans = names
    keyed = docs.withColumn(blob, address(F.col(f"`{text}`")))
    hits = scan_new(docs, text, rules=rules).where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    t = F.col(f"`{text}`")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["begin"] >= acc["at"]
        gap = F.substr(t, acc["at"].cast("int") + 1, (s["begin"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["finish"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"].cast("int") + 1)))
    return keyed.join(hits, blob, "left").withColumn(text, F.when(F.col(spans).isNull(), t).otherwise(clean)).select(docs.columns)
