"""Operator 12: a Merkle manifest of a data set, by rolling up nested structs.

Every row is a leaf. The leaves of a source stand in order of their key, runs of 16 consecutive nodes become one node,
level by level, and the nodes that remain of all sources become the root in the same way.

The place of a leaf is a number with one digit of base 16 per level. Within a block of 256 places the digits are grouped
away one after the other: a node is a struct that holds its digest and the structs of its children. The blocks' digests
are the leaves of the levels above, which are rolled up alike, in blocks, until one node is left. On the way back a block
meets the path above it by grouping on its number, and `transform` and `explode` unfold it into one row per leaf with the
siblings of its whole path; no node is joined to its siblings. Only nested blocks are written, never paths.

A hot source is no hot key: places come from one sort by ranges, rows travel by block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultline.llm.common import table
from faultline.sources.shared import materialise

#: Children of a node, and digits that are grouped away within a block.
WIDTH, DIGITS = 16, 2
_BLOCK = WIDTH**DIGITS

_SIBLINGS = "array<struct<before:string,after:string>>"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    """`-` for null, else the number of bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return sha256(*map(_field, values))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with `place`, the rank from 0 within `group` by `order`, and `nodes`, the number of rows of the group.

    One sort by ranges over the whole table, written once. What a task holds of a group is counted, and these counts,
    at most one per group and task, are added up.
    """
    ranges = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    stored = materialise(ranges.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33).alias("part")
    held = stored.groupBy("group", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    group = Window.partitionBy("group")
    before = F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = held.select(
        "group", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(group).alias("nodes")
    )
    named = stored.withColumn("part", part).join(materialise(shift, "shifts"), ["group", "part"])
    return named.withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _merged(children: Column, nodes: Column) -> Column:
    """The digest of a run of nodes; a level that has a single node is the top and no run."""
    digests = F.transform(children, lambda c: c["digest"])
    return F.when(nodes > 1, F.sha2(F.array_join(digests, ""), 256)).otherwise(digests[0])


def _above(nodes: Column, levels: int) -> Column:
    """Nodes of a group that are left some levels up."""
    return F.ceil(nodes / (WIDTH**levels)).cast("long")


def blocks(leaves: DataFrame) -> DataFrame:
    """(group, block, nodes, digest, children): one nested struct per block of places.

    `leaves` has group, place, nodes, digest and a struct `own`, which travels along.
    """
    block = F.floor(F.col("place") / _BLOCK).cast("long")
    rows = leaves.select("group", block.alias("block"), "nodes", F.col("place").alias("p"), F.struct("place", "digest", "own").alias("node"))
    digits = [F.floor(F.col("p") / WIDTH**level) % WIDTH for level in range(1, DIGITS)]
    rows = rows.withColumns({f"digit_{level}": digit for level, digit in enumerate(digits, 1)}).drop("p")
    # Dealt out by block once: all groupings below keep the two columns as their first keys.
    rows = rows.repartition("group", "block")
    for level in range(DIGITS):
        keys = [f"digit_{n}" for n in range(level + 1, DIGITS)]
        nested = rows.groupBy("group", "block", "nodes", *keys).agg(F.sort_array(F.collect_list("node")).alias("children"))
        digest = _merged(F.col("children"), _above(F.col("nodes"), level))
        place = F.col("children")[0]["place"]
        rows = nested.select("group", "block", "nodes", *keys, F.struct(place.alias("place"), digest.alias("digest"), "children").alias("node"))
    return rows.select("group", "block", "nodes", "node.digest", "node.children")


def _beside(children: Column, at: Column) -> Column:
    """The digests before and after a child, as an array of one struct."""
    digests = F.transform(children, lambda c: c["digest"])
    return F.array(
        F.struct(
            F.array_join(F.slice(digests, F.lit(1), at), "").alias("before"),
            F.array_join(F.slice(digests, at + 2, F.lit(WIDTH)), "").alias("after"),
        )
    )


def _unfolded(nested: DataFrame) -> DataFrame:
    """(group, place, digest, own, path, end): one row per leaf of a block with `above`, the path of the block."""

    def leaves(children: Column, above: Column, level: int) -> Column:
        """The leaves below, each with the siblings of its path from the bottom up."""
        # A level of a single node is no level: nothing was hashed there.
        real = _above(F.col("nodes"), level) > 1

        def below(child: Column, at: Column) -> Column:
            path = F.when(real, F.concat(_beside(children, at), above)).otherwise(above)
            if level:
                return leaves(child["children"], path, level - 1)
            return F.struct(child["place"].alias("place"), child["digest"].alias("digest"), child["own"].alias("own"), path.alias("path"))

        found = F.transform(children, below)
        return F.flatten(found) if level else found

    each = F.explode(leaves(F.col("children"), F.col("above"), DIGITS - 1))
    return nested.select("group", "end", each.alias("leaf")).select("group", "end", "leaf.*")


def rolled_up(leaves: DataFrame) -> list[DataFrame]:
    """The written blocks of all levels, from the bottom up; each pass takes two levels, so a billion leaves need four."""
    found = []
    while True:
        found.append(materialise(blocks(leaves), "blocks"))
        upper = found[-1].select("group", F.col("block").alias("place"), _above(F.col("nodes"), DIGITS).alias("nodes"), "digest")
        leaves = upper.filter("nodes > 1").withColumn("own", F.lit(None).cast("string"))
        if leaves.isEmpty():
            return found


def tops(level: DataFrame) -> DataFrame:
    """(group, block, digest) of the groups that end in this pass."""
    return level.filter(_above(F.col("nodes"), DIGITS) == 1).select("group", "block", "digest")


def paths(levels: Sequence[DataFrame], ends: DataFrame) -> DataFrame:
    """(group, place, digest, own, path, end) of the leaves. `ends` has one row per group: `end`, which its leaves get,
    and `above`, the path of its top."""
    found = None
    for level in reversed(levels):
        above = tops(level).select("group", "block").join(ends, "group").select("group", "block", "end", "above")
        if found is not None:
            higher = found.select("group", F.col("place").alias("block"), "end", F.col("path").alias("above"))
            above = above.unionByName(higher)
        # A block and its path meet by grouping; both are there once per block.
        null = {f.name: F.lit(None).cast(f.dataType) for f in (*level.schema, *above.schema) if f.name not in ("group", "block")}
        lower = level.drop("digest").withColumns({c: null[c] for c in ("end", "above")})
        both = lower.unionByName(above.withColumns({c: null[c] for c in ("nodes", "children")})).groupBy("group", "block")
        found = _unfolded(both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("nodes", "children", "end", "above")]))
    return found


def fold(path: Column, node: Column) -> Column:
    """The root that follows from a node and the siblings of its path."""
    return F.aggregate(path, node, lambda now, s: sha256(s["before"], now, s["after"]))


def manifest(
    docs: DataFrame, key: str = "doc_id", source: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    changed: Sequence[Column] | None = None,
) -> DataFrame:
    """One row per row: key, leaf, subroot, root, path (the siblings before and after, from the leaf to the root), and
    changed_leaf, the leaf of the `changed` values (by default those of `fields`).

    A leaf is the digest of its fields, whatever other columns there are; null counts as `-`, an empty text as `0:`, and
    texts are hashed whole. Leaves of a source ascend by key, null keys first, rows of equal keys by digest; rows that
    are equal in all fields are leaves each. Sources ascend by their UTF-8 bytes, null first. A single leaf is its own
    subroot, a single subroot the root. An empty table gives no rows.
    """
    values = [F.col(f"`{c}`") for c in fields]
    name = F.col(f"`{source}`").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), name), F.lit("")).alias("group"),  # never null, and in the order of sources
        F.col(f"`{key}`").alias("key"),
        leaf(values).alias("digest"),
        leaf(changed or values).alias("changed"),
    )
    inner = rolled_up(placed(rows, ["key", "digest"]).withColumn("own", F.struct("key", "changed")))
    subroots = reduce(DataFrame.unionByName, map(tops, inner)).select(F.col("group").alias("name"), "digest", F.lit("").alias("group"))
    outer = rolled_up(placed(subroots, ["name"]).withColumn("own", F.col("name")))
    root = reduce(DataFrame.unionByName, map(tops, outer))
    whole = root.select("group", F.struct(F.col("digest").alias("root")).alias("end"), F.array().cast(_SIBLINGS).alias("above"))
    ends = paths(outer, whole).select(
        F.col("own").alias("group"), F.struct("end.root", F.col("digest").alias("subroot")).alias("end"), F.col("path").alias("above")
    )
    return paths(inner, materialise(ends, "sources")).select(
        F.col("own.key").alias(key), F.col("digest").alias("leaf"), "end.subroot", "end.root", "path",
        F.col("own.changed").alias("changed_leaf"),
    )


def siblings(path: Column) -> Column:
    """All digests of a path in a row, from the bottom up and from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proofs = manifest(docs, changed=[*map(F.col, ("doc_id", "source", "lang", "n_chars")), text])
    folded = proofs.withColumn("folded_root", fold(F.col("path"), F.col("changed_leaf")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SQL = """
WITH RECURSIVE
one(b) AS (SELECT range::BIGINT FROM range(256)),
crcs AS (SELECT list(list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM one),
d AS (SELECT *, doc_id::VARCHAR AS key,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
          lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS crc
      FROM documents, crcs),
e AS (SELECT doc_id, source, row_number() OVER o - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
        head || coalesce(strlen(text) || ':' || text, '-') AS original,
        head || coalesce(strlen(text) || ':' || CASE WHEN crc % 5 = 0
          THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-') AS changed
      FROM (SELECT *, coalesce(strlen(key) || ':' || key, '-') || coalesce(strlen(source) || ':' || source, '-')
              || coalesce(strlen(lang) || ':' || lang, '-')
              || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d)
      WINDOW o AS (PARTITION BY source ORDER BY doc_id)),
l AS (SELECT doc_id, source, pos, n, sha256(original) AS leaf, sha256(changed) AS changed FROM e),
up(tree, level, pos, n, node) AS (
  SELECT coalesce('+' || source, ''), 0, pos, n, leaf FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY tree, level, pos // 16, n),
tops AS (SELECT tree, level AS depth, node AS subroot FROM up WHERE n = 1),
over(level, pos, n, node) AS (
  SELECT 0, row_number() OVER (ORDER BY tree) - 1, count(*) OVER (), subroot FROM tops
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 16, n),
root AS (SELECT node AS root FROM over WHERE n = 1),
tree_at AS (SELECT tree, subroot, depth, row_number() OVER (ORDER BY tree) - 1 AS spos FROM tops),
runs AS (SELECT tree, level, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM up WHERE n > 1 GROUP BY tree, level, pos // 16
         UNION ALL SELECT NULL, level, pos // 16, list(node ORDER BY pos) FROM over WHERE n > 1 GROUP BY level, pos // 16),
walk(doc_id, tree, level, pos, depth, spos, proof, now) AS (
  SELECT doc_id, tree, 0, pos, depth, spos, '', changed FROM l JOIN tree_at ON tree = coalesce('+' || source, '')
  UNION ALL
  SELECT doc_id, w.tree, w.level + 1, CASE WHEN w.level + 1 = depth THEN spos ELSE pos // 16 END, depth, spos,
    proof || array_to_string(nodes[:pos % 16], '') || array_to_string(nodes[pos % 16 + 2:], ''),
    sha256(array_to_string(nodes[:pos % 16], '') || now || array_to_string(nodes[pos % 16 + 2:], ''))
  FROM (SELECT * REPLACE (CASE WHEN level = 0 AND depth = 0 THEN spos ELSE pos END AS pos) FROM walk) w
  JOIN runs r ON run = pos // 16 AND ((w.level < depth AND r.tree = w.tree AND r.level = w.level)
    OR (w.level >= depth AND r.tree IS NULL AND r.level = w.level - depth))),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, tree ORDER BY level DESC) = 1)
SELECT l.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM last JOIN l ON l.doc_id = last.doc_id AND tree = coalesce('+' || source, '') JOIN tree_at USING (tree), root
"""
