"""Operator 12: a Merkle manifest of a table, and proofs of its rows by descent through a content-addressed store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.functions.ship import ship
from quern.llm.exchange import cut
from quern.operators.ranks import ranked

FAN = 8  # children of a node
LEVELS = 4  # levels of a storey, which one step of a job builds or descends; a task holds the FAN ** LEVELS nodes of a shard at once
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for NULL, else the count of UTF-8 bytes, `:` and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(start: str, path: list[dict]) -> str:
    """The root that follows from a leaf and its path, the leaf's level first."""
    for side in path:
        start = digest(side["left"], start, side["right"])
    return start


def proof_digest(path: list[dict]) -> str:
    return digest(*(side["left"] + side["right"] for side in path))


@dataclass
class Manifest:
    """leaves: the given columns with `number` (of the group), `rank`, `size`; groups: `tree` (0), `number`, `height`, `digest` (the
    group's root); lower, upper: the store of each storey over the leaves and over the groups' roots; root: `number` 0, `height`,
    `digest`."""
    leaves: DataFrame
    groups: DataFrame
    lower: list[DataFrame]
    upper: list[DataFrame]
    root: DataFrame
    levels: int


def _shard(table: pa.Table, levels: int) -> pa.Table:
    """Records of up to `levels` levels over the nodes of a shard, and last its top. size: nodes of the tree on the nodes' level."""
    number, shard, size = (table[c][0].as_py() for c in ("number", "shard", "size"))
    row = [d for _, d in sorted(zip(table["idx"].to_pylist(), table["digest"].to_pylist(), strict=True))]
    records, climbed = {}, 0
    while size > 1 and climbed < levels:
        runs = [row[i:i + FAN] for i in range(0, len(row), FAN)]
        row = [digest(*run) for run in runs]
        records.update(zip(row, runs, strict=True))
        size, climbed = -(-size // FAN), climbed + 1
    n = len(records)
    return pa.table({"number": pa.array([number] * (n + 1), pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int64()),
                     "digest": pa.array([*records, row[0]], pa.string()), "children": pa.array([*records.values(), None], pa.list_(pa.string())),
                     "climbed": pa.array([None] * n + [climbed], pa.int32()), "size": pa.array([None] * n + [size], pa.int64())})


def _grow(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Store of each storey, from the lowest, and the root of each tree (tree, number, height, digest); nodes: number, idx, size, digest."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    span, storeys, roots = FAN ** levels, [], nodes.where("size = 1").select("number", F.lit(0).alias("height"), "digest")
    while most > 1:
        built = (nodes.where("size > 1").withColumn("shard", F.floor(F.col("idx") / span)).groupBy("number", "shard")
                 .applyInArrow(lambda table: _shard(table, levels), "number long, shard long, digest string, children array<string>, climbed int, size long"))
        storeys.append(cut(built))
        tops = storeys[-1].where("climbed IS NOT NULL")
        roots = roots.unionByName(tops.where("size = 1").select("number", (F.lit((len(storeys) - 1) * levels) + F.col("climbed")).alias("height"), "digest"))
        nodes, most = tops.select("number", F.col("shard").alias("idx"), "size", "digest"), -(-most // span)
    return storeys, cut(roots.withColumn("tree", F.lit(0).cast("long")))


def build(leaves: DataFrame, group: str, order: list[Column], levels: int = LEVELS) -> Manifest:
    """Manifest of rows with a `leaf` digest: in each group ascending by `order` and then by leaf, groups ascending with NULL first.

    Runs of FAN nodes become a node until one is left. A task holds a shard of at most FAN ** levels nodes at a time and writes a record
    for each node that it makes, digest to children, to the shared folder: the store. Nothing depends on a group's size but the
    number of storeys. No rows: no groups, no root."""
    ship(leaves.sparkSession)
    placed = cut(ranked(leaves, [group], [*order, F.col("leaf")], numbered=True))
    lower, tops = _grow(placed.select("number", F.col("rank").alias("idx"), "size", F.col("leaf").alias("digest")), levels)
    count = F.lit(tops.count()).cast("long")
    upper, root = _grow(tops.select(F.col("tree").alias("number"), F.col("number").alias("idx"), count.alias("size"), "digest"), levels)
    return Manifest(placed, tops, lower, upper, root, levels)


def _descend(storeys: list[DataFrame], heads: DataFrame, requests: DataFrame, levels: int,
             finish: Callable[[dict, list], dict] | None = None, fields: str = "") -> DataFrame:
    """Requests (number, idx and own columns; one per leaf) with the other columns of their head and `path`: the siblings left and
    right of the node that leads to the leaf, for each level from the top. heads: number, height, digest, path and columns to hand
    down. `finish` makes the columns `fields` of a request's row and its path from the leaf up, in place of all these.

    In a storey, requests under one shard go down together from its top: digits of the rank choose a child, its digest names the
    next record, and the other children join the path. A shard asks once for its own top in the storey above."""
    handed = [c for c in heads.columns if c not in ("number", "height", "digest", "path")]
    span, asks, finished = FAN ** levels, [requests], StructType.fromDDL(fields) if finish else None
    for _ in storeys[1:]:
        asks.append(asks[-1].select("number", F.floor(F.col("idx") / span).alias("idx")).distinct())
    tops = None
    for s in range(len(storeys) - 1, -1, -1):
        own = (heads.where((F.col("height") > s * levels) & (F.col("height") <= (s + 1) * levels))
               .select("number", F.lit(0).cast("long").alias("shard"), "digest", "path", (F.col("height") - s * levels).alias("levels"), *handed))
        tops = own if tops is None else own.unionByName(tops)
        asked = asks[s].withColumn("shard", F.floor(F.col("idx") / span))
        records = storeys[s].where("climbed IS NULL").select("number", "shard", "digest", "children")
        known = records.unionByName(tops, allowMissingColumns=True)
        last = finish if s == 0 else None
        out = StructType([*asks[s].schema.fields, *(heads.schema[c] for c in handed), heads.schema["path"], heads.schema["digest"]])
        made = finished if last else out
        below = asked.groupBy("number", "shard").cogroup(known.groupBy("number", "shard")).applyInArrow(_down(handed, to_arrow_schema(made), last), made)
        if s:
            tops = cut(below.select("number", F.col("idx").alias("shard"), "digest", "path", F.lit(levels).alias("levels"), *handed))
    # the root of a single leaf is that leaf
    lone = heads.where("height = 0").select("number", *handed, "path", "digest").join(requests.where("idx = 0"), "number")
    if finish:
        schema = to_arrow_schema(finished)
        lone = lone.mapInArrow(lambda batches: (_finished(b.to_pylist(), finish, schema) for b in batches), fields)
    return lone if not storeys else lone.unionByName(below)


def _finished(rows: list[dict], finish: Callable[[dict, list], dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([finish(r, r["path"][::-1]) for r in rows], schema)


def _down(handed: list[str], schema: pa.Schema, finish: Callable | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def down(asked: pa.Table, known: pa.Table) -> pa.Table:
        heads = known.filter(pc.is_valid(known["levels"])).to_pylist() if known.num_rows else []
        if not heads or not asked.num_rows:
            return schema.empty_table()
        records = known.filter(pc.is_valid(known["children"]))
        children = dict(zip(records["digest"].to_pylist(), records["children"].to_pylist(), strict=True))
        head, rows = heads[0], []
        for row in asked.to_pylist():
            path, at = list(head["path"]), head["digest"]
            for level in range(head["levels"] - 1, -1, -1):
                digit, run = row["idx"] // FAN ** level % FAN, children[at]
                path.append({"left": "".join(run[:digit]), "right": "".join(run[digit + 1:])})
                at = run[digit]
            row |= {c: head[c] for c in handed}
            rows.append(finish(row, path[::-1]) if finish else row | {"path": path, "digest": at})
        return pa.Table.from_pylist(rows, schema)
    return down


def proofs(manifest: Manifest, requests: DataFrame, payload: list[str], finish: Callable[[dict, list], dict] | None = None, fields: str = "") -> DataFrame:
    """For rows of `manifest.leaves`: number, idx, the payload, `subroot`, `root`, `digest` (of the leaf, as the store has it) and
    `path`, the (left, right) sibling digests of each level from the root's down to the leaf's; or what `finish` makes of them."""
    top = manifest.root.select("number", "height", "digest", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    groups = manifest.groups.select(F.col("tree").alias("number"), F.col("number").alias("idx"), F.col("number").alias("to"), F.col("height").alias("rise"), F.col("digest").alias("subroot"))
    heads = cut(_descend(manifest.upper, top, groups, manifest.levels))
    heads = heads.select(F.col("to").alias("number"), F.col("rise").alias("height"), "digest", "path", "subroot", "root")
    return _descend(manifest.lower, heads, requests.select("number", F.col("rank").alias("idx"), *payload), manifest.levels, finish, fields)


def verified_rows(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", text: str = "text",
                  levels: int = LEVELS) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the fields; leaves ascend by `order` in their group, rows of one id by their leaf, NULL ids first. A trial
    of tampering lower-cases A-Z in the text where 3 divides the CRC-32 of the id's decimal text: `folded_root` is what the tampered
    leaf and the original siblings give, `verified` whether that is the root. NULL text, NULL ids and texts without capitals stay as
    they are and verify. Equal rows are leaves of their own with equal digests. Texts are hashed where they are read; only digests
    are shuffled. Columns that are not fields are ignored."""
    columns = {c: F.col(f"`{c}`") for c in fields}
    lowered = F.translate(columns[text], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    struck = F.coalesce(F.crc32(columns[order].cast("string")) % 3 == 0, F.lit(False))
    tampered = F.when(struck, leaf([lowered if c == text else v for c, v in columns.items()]))
    rows = docs.select(columns[order].alias("doc_id"), columns[group].alias("lang"), leaf(list(columns.values())).alias("leaf"), tampered.alias("tampered"))
    made = build(rows, "lang", [F.col("doc_id").asc_nulls_first()], levels)

    def judged(row: dict, path: list[dict]) -> dict:
        up = fold(row["tampered"] or row["leaf"], path)
        return {"doc_id": row["doc_id"], "leaf": row["leaf"], "subroot": row["subroot"], "root": row["root"], "proof_sha256": proof_digest(path),
                "folded_root": up, "verified": up == row["root"]}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return proofs(made, made.leaves, ["doc_id", "leaf", "tampered"], judged,
                  f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
