"""Operator 8: similarity join on word shingles by rare shingles and parity sketches, and the groups of linked documents.

Candidates share one of their rarest shingles (a prefix filter); a bit sketch of parities gives a Hamming bound before
sets are verified. Whole sets are shuffled only where that bound leaves room.

1. Shingles are counted in buckets, a table of fixed size. All sets order their shingles by these counts, rarest first.
   Similar sets have one of their first shingles in common, their marks: about a fifth of a set at 80 %, whatever the
   counts are. Shingles of passages that many texts have come last and are rarely marks. Equal sets are one node.
2. Marks that only one set has fall out in the task that gets all rows of a mark; they cross the network once.
   Frequent marks, found by a sketch of bounded size, are dealt by mark and set instead and counted by partial sums.
3. Sets that share a mark are compared, unless what follows the mark in either is too little (a positional filter, which
   also sees the sizes): by the Hamming distance of their sketches, which never exceeds the number of
   elements they differ in, then exactly. Of a crowded mark the pairs are not written out: each set is compared with
   the mark's hub. Where that leaves sets apart, those of all marks of a hub are cut into blocks of bounded size,
   and a task gives only a forest of its nearest pairs between components, nearest first; what the verified forest leaves
   apart is looked at again, with more forests, until no pair that could link two components is untested.
4. Verified links make components.

No link between different sets is lost: a pair is left out only if its sketches exclude it, it was compared, or both
sets are in one group already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.llm.common import by_row, key_type, materialise, pick, release_shuffles, scratch, table, unused
from faultline.llm.components import components
from faultline.llm.exact_dedup import frequent_heads
from faultline.llm.shingles import BUCKETS, Bands, brief, buckets, hamming, rare_marks, set_id, shingle_set, similar, sketch
from faultline.operators.reduction import batch_of, joined, slices_of, tree_reduced
from faultline.sources import shared

#: Sets of a mark up to which its pairs are written out, and sets of a block beyond.
SMALL, BLOCK = 16, 1024

_LONGS = pa.list_(pa.int64())


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def shingle_counts(docs: DataFrame, key: str, text: str, width: int) -> np.ndarray:
    """Rows with a shingle, by bucket of its hash: BUCKETS numbers from each task, added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting, held = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for value in batch.column(1):
                found = buckets(shingle_set(value.as_py(), width))
                waiting.append(found)
                held += len(found)
                if held >= BUCKETS:
                    out += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting, held = [], 0
        if waiting:
            out += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        yield batch_of(slices_of(out.astype(np.float64)))

    found = tree_reduced(shared.fewer_tasks(pick(docs, key, text)), run)
    return joined(found).astype(np.int64) if found else np.zeros(BUCKETS, np.int64)


def signatures(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(key, node, size, marks, sketch, brief) of every row; a row without words has size 0.

    Copies are combined before the shuffle: a set that a task has met before has no marks in its later rows.
    """
    rows = pick(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    bands = Bands(percent)
    often = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, key, text, width))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # at most one number per row of the task

        def signature(value: str) -> tuple:
            found = shingle_set(value, width)
            node = set_id(found)
            if not len(found):
                return node, 0, [], [], []
            marks = [] if node in met else _signed(rare_marks(found, percent, often.value))
            met.add(node)
            whole = sketch(found, bands)
            return node, len(found), marks, _signed(whole), _signed(brief(whole))

        yield from by_row(signature, schema)(batches)

    schema = pa.schema(
        [("key", key_type(rows)), ("node", pa.int64()), ("size", pa.int64())]
        + [(name, _LONGS) for name in ("marks", "sketch", "brief")]
    )
    columns = f"key {kind}, node long, size long, marks array<long>, sketch array<long>, brief array<long>"
    return rows.mapInArrow(signed, columns)


def shared_marks(signed: DataFrame) -> DataFrame:
    """(mark, node, size, rest, members): the marks that more than one set has, once per set, with their number of sets.
    `rest` is the number of shingles of the set from the mark on, in the common order.

    Marks cross the network once, at every size: the task that has all rows of a mark also drops it if one set
    alone has it, and counts the others. Marks of more than 1/4,096 of all rows do not meet in a task: they are known
    from a sketch, at most 4,096 of them whatever the size of the corpus, and their rows are dealt by mark and set.
    """
    placed = signed.select("node", "size", F.posexplode("marks").alias("at", "mark"))
    rows = placed.select("mark", "node", F.col("size").cast("int"), (F.col("size") - F.col("at")).cast("int").alias("rest"))
    heads = frequent_heads(rows.select(F.col("mark").alias("head")))
    frequent = materialise(heads.select(F.col("head").alias("mark")), "frequent")
    hot = materialise(rows.join(F.broadcast(frequent), "mark", "left_semi").distinct(), "hot")
    sums = hot.groupBy("mark").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    release_shuffles(signed.sparkSession)

    of = Window.partitionBy("mark")
    others = rows.join(F.broadcast(frequent), "mark", "left_anti")
    common = others.withColumns({"low": F.min("node").over(of), "high": F.max("node").over(of)}).filter("low < high")
    members = common.drop("low", "high").distinct().withColumn("members", F.count(F.lit(1)).over(of))
    counted = materialise(members.unionByName(hot.join(F.broadcast(sums), "mark")), "counted")
    release_shuffles(signed.sparkSession)
    return counted


def node_elements(docs: DataFrame, signed: DataFrame, nodes: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(node, size, elements) of the given nodes, from one document each. Written first: a hub's set meets many partners,
    and Spark splits the rows of a hot key only where both sides of a join come straight from a shuffle."""
    chosen = signed.select("key", "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    (same,) = unused(docs, "same")
    keys = materialise(chosen.select(F.col("key").alias(same)).distinct(), "keys")  # written first: Spark knows its size
    rows = pick(docs, key, text).join(keys, F.col("key").eqNullSafe(F.col(same)), "left_semi")

    def elements(value: str) -> tuple:
        found = shingle_set(value, width)
        return set_id(found), len(found), _signed(found)

    schema = pa.schema([("key", key_type(rows)), ("node", pa.int64()), ("size", pa.int64()), ("elements", _LONGS)])
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(by_row(elements, schema), f"key {kind}, node long, size long, elements array<long>")
    # Keys may repeat: sets of other rows with the same key go, and one row per node stays.
    return materialise(found.drop("key").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "elements")


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs with `column` and size of both sets."""
    for side in "ab":
        pairs = pairs.join(
            sets.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col(column).alias(f"set_{side}")), side
        )
    return pairs.select("a", "b", "size_a", "size_b", "set_a", "set_b")


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _kept_pairs(test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i) for i in (4, 5)]
            keep = [test(*(np.asarray(side[i].values).view(np.uint64) for side in sides)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR).filter(pa.array(keep, pa.bool_()))

    return run


def near_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches leave room for the similarity. Those of fitting sizes are written first: sketches
    are joined to no others, and are not shuffled for a few pairs."""
    bands = Bands(percent)
    fitting = _both(pairs, sketches, "size").filter(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)
    sized = _both(materialise(fitting.select("a", "b"), "sized"), sketches, "sketch")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [batch.column(i).to_numpy() for i in (2, 3)]
            side = [batch.column(i) for i in (4, 5)]
            keep = [
                hamming(*(np.asarray(s[i].values).view(np.uint64) for s in side)) <= bands.largest_difference(size[0][i], size[1][i])
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR).filter(pa.array(keep, pa.bool_()))

    return sized.mapInArrow(close, "a long, b long")


def verify(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""
    return _both(pairs, elements, "elements").mapInArrow(_kept_pairs(lambda a, b: similar(a, b, percent)), "a long, b long")


def small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of marks with at most SMALL sets, each once, that may be similar and have this mark first.

    All shingles that two sets share come from the first shared one on, so there are no more of them than either set has
    from there. A pair that this leaves too few has another first mark, whose row gives it, or is not similar. Sets of
    sizes that do not fit are left too few by every mark.
    """
    few = members.filter(F.col("members") <= SMALL).select("mark", F.struct("node", "size", "rest").alias("one"))
    listed = few.groupBy("mark").agg(F.sort_array(F.collect_list("one")).alias("sets"))
    at = listed.select("sets", F.posexplode("sets").alias("i", "one"))

    def may_be_similar(other):
        most = F.least(F.col("one.rest"), other["rest"]).cast("long")
        return most * (100 + percent) >= (F.col("one.size").cast("long") + other["size"]) * percent

    later = F.filter(F.slice("sets", F.col("i") + 2, SMALL), may_be_similar)
    return at.select(F.col("one.node").alias("a"), F.explode(F.transform(later, lambda x: x["node"])).alias("b")).distinct()


def _forests(near: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, count: int) -> tuple[np.ndarray, bool]:
    """Pairs of `count` edge-disjoint forests over groups, nearest first; whether untested pairs remain."""
    order = np.argsort(near, kind="stable")
    left, right, rest = left[order], right[order], np.arange(len(order))
    chosen: list[np.ndarray] = []
    for _ in range(count):
        label, open_, forest = group.copy(), rest, []
        while len(open_):
            a, b = label[left[open_]], label[right[open_]]
            apart = a != b
            open_, a, b = open_[apart], a[apart], b[apart]
            if not len(open_):
                break
            best = np.full(len(label), len(order))
            np.minimum.at(best, a, open_)
            np.minimum.at(best, b, open_)
            picked = np.unique(best[best < len(order)])
            forest.append(picked)
            root = np.arange(len(label))
            for x, y in zip(label[left[picked]], label[right[picked]]):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                while root[y] != y:
                    root[y] = y = root[root[y]]
                root[max(x, y)] = min(x, y)
            while (root != root[root]).any():
                root = root[root]
            label = root[label]
        if not forest:
            break
        taken = np.unique(np.concatenate(forest))
        chosen.append(taken)
        rest = np.setdiff1d(rest, taken, assume_unique=True)
    picked = np.concatenate(chosen) if chosen else rest[:0]
    more = bool((group[left[rest]] != group[right[rest]]).any()) if len(rest) else False
    return order[picked], more


def block_pairs(blocks: DataFrame, percent: int, forests: int) -> DataFrame:
    """(hub, a, b, more) per block of two chunks of a hub's group."""
    bands = Bands(percent)
    schema = pa.schema([("hub", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])

    def block(group: pa.Table) -> pa.Table:
        node, size, chunk = (group.column(c).to_numpy() for c in ("node", "size", "chunk"))
        _, root = np.unique(group.column("root").to_numpy(), return_inverse=True)
        raw = [np.asarray(x.values).view(np.uint64) for x in group.column("sketch").combine_chunks()]
        by_width = {w: np.stack([x for x in raw if len(x) == w]) for w in {len(x) for x in raw}}
        place = {w: np.array([i for i, x in enumerate(raw) if len(x) == w]) for w in by_width}
        first, same = chunk.min(), chunk.min() == chunk.max()
        found: list[tuple[np.ndarray, ...]] = []
        for i in range(len(node)):
            for w, rows in by_width.items():
                at = place[w]
                use = (at > i) if same else (chunk[at] != first) & (chunk[i] == first)
                use &= root[at] != root[i]
                use &= 100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i])
                if use.any():
                    near = hamming(rows[use], raw[i][None, :])
                    close = near * (100 + percent) <= (size[at[use]] + size[i]) * (100 - percent)
                    other = at[use][close]
                    found.append((near[close], np.full(len(other), i), other))
        hub = group.column("hub")[0].as_py()
        if not found or not sum(len(x[0]) for x in found):
            return schema.empty_table()
        near, left, right = (np.concatenate(x) for x in zip(*found))
        picked, more = _forests(near, left, right, root, forests)
        a, b = node[left[picked]], node[right[picked]]
        columns = [np.full(len(a), hub), np.minimum(a, b), np.maximum(a, b), np.full(len(a), more)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    columns = ["hub", "node", "root", "size", "sketch", "chunk", "block_a", "block_b"]
    return (
        blocks.select(*columns).groupBy("hub", "block_a", "block_b")
        .applyInArrow(block, "hub long, a long, b long, more boolean")
    )


def hub_groups(crowd: DataFrame) -> DataFrame:
    """(hub, node): the sets of crowded marks, grouped by the mark's hub, each set once per hub.

    The hub is the set that shares most with others over all marks. Copies of a text that were changed here and there
    miss the marks of their changes; the text itself misses none, so all marks of a family have one hub, and two
    sets that share any of them are in its group together.
    """
    score = crowd.groupBy("node").agg(F.sum("members").alias("score"))
    hubs = crowd.join(score, "node").groupBy("mark").agg(F.max(F.struct("score", "node")).alias("hub"))
    named = materialise(hubs.select("mark", F.col("hub.node").alias("hub")), "named")  # so that hot marks can be split
    return materialise(crowd.join(named, "mark").select("hub", "node").distinct(), "hubs")


def hub_pairs(groups: DataFrame) -> DataFrame:
    """(a, b): every set with its hub: linear, and enough for a group whose sets are all similar to the hub."""
    pairs = groups.filter("node <> hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def open_blocks(groups: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """The sets of hubs whose groups still have more than one component, dealt out over blocks of two chunks each.

    Sets of the largest component need no comparison with each other. They are chunks of their own, which meet only the
    chunks of the other sets: their rows go to as many blocks as there are chunks of other sets, the others' rows to as
    many as there are chunks at all. Rows carry the folded sketch, whose distance is a bound as well.
    """
    placed = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = placed.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("hub").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"))
    apart = sizes.filter(F.col("all") > F.col("main.n")).select(
        "hub",
        F.col("main.root").alias("main"),
        F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("long").alias("others"),
        F.ceil(F.col("main.n") / BLOCK).cast("long").alias("mains"),
    )
    mixed = F.xxhash64("node")
    is_main = F.col("root") == F.col("main")
    chunk = F.when(is_main, F.col("others") + F.pmod(mixed, F.col("mains"))).otherwise(F.pmod(mixed, F.col("others")))
    last = F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    dealt = placed.join(apart, "hub").select(
        "hub", "node", "root", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")
    )
    folded = sketches.select("node", "size", F.col("brief").alias("sketch"))
    return dealt.join(folded, "node").withColumns(
        {"block_a": F.least("chunk", "other"), "block_b": F.greatest("chunk", "other")}
    )


def linked_nodes(docs: DataFrame, signed: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that have a link to another node."""
    spark = docs.sparkSession
    members = shared_marks(signed)
    groups = hub_groups(members.filter(F.col("members") > SMALL))
    tested = materialise(small_pairs(members, percent).unionByName(hub_pairs(groups)).distinct(), "pairs")
    release_shuffles(spark)
    # Only sets with a partner to be tested need a sketch; every set of a group has its hub as one.
    nodes = materialise(tested.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    known = signed.select("node", "size", "sketch", "brief").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    sketches = materialise(known, "sketches")
    near = materialise(near_pairs(tested, sketches, percent), "near")
    release_shuffles(spark)

    def similar_pairs(pairs: DataFrame) -> DataFrame:
        # Whole sets are read of the ends of these pairs alone, which a sketch did not exclude.
        ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        found = verify(pairs, node_elements(docs, signed, ends, key, text, width), percent)
        written = materialise(found, "similar")
        release_shuffles(spark)
        return written

    roots = materialise(components(similar_pairs(near)), "roots")

    forests = 1
    while not groups.isEmpty():
        found = materialise(block_pairs(open_blocks(groups, roots, sketches), percent, forests), "blocks")
        fresh = found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        new = similar_pairs(materialise(near_pairs(fresh, sketches, percent), "fresh"))
        tested = materialise(tested.unionByName(found.select("a", "b")).distinct(), "pairs")
        if not new.isEmpty():
            linked = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = materialise(components(linked.unionByName(new)), "roots")
        # Groups in which pairs between components were left untested come again, with more forests.
        groups = materialise(groups.join(found.filter("more").select("hub").distinct(), "hub", "left_semi"), "groups")
        forests *= 8
    release_shuffles(spark)
    return roots


def similarity_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90
) -> DataFrame:
    """One row per row: key, n_shingles, component_id, the smallest key that links lead to.

    Two documents are linked when 100 * |A n B| >= percent * |A u B| for their sets of distinct word shingles (64-bit
    hashes; two sets are confused with odds of 2^-64). Null and empty texts have no shingles, no links and their own
    key. Rows that repeat a key count as documents with that key; null keys are ignored by the minimum, so a component
    of null keys alone has a null id. Other columns are ignored, an empty table gives no rows.
    """
    signed = materialise(signatures(docs, key, text, width, percent), "signatures")
    roots = linked_nodes(docs, signed, key, text, width, percent)
    rows = signed.select("key", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    some = rows.filter("size > 0")
    least = some.groupBy("root").agg(F.min("key").alias("component_id"))
    full = some.join(least, "root").select("key", "size", "component_id")
    empty = rows.filter("size = 0").select("key", "size", F.col("key").alias("component_id"))
    return full.unionByName(empty).select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of linked documents, that of the smallest key; all columns stay.

    Rows without words are no group and stay, and so do rows with a null key. Keys are taken as unique: rows that repeat
    a key stay or go together.
    """
    (other,) = unused(docs, "gone")
    with scratch(docs.sparkSession):
        found = similarity_components(docs, key, text, width, percent)
        gone = found.filter(F.col(f"`{key}`") != F.col("component_id")).select(F.col(f"`{key}`").alias(other)).distinct()
        # Written first, so that Spark knows its size when it chooses the join.
        gone = shared.materialise(gone, "gone")
    return docs.join(gone, F.col(f"`{key}`") == F.col(other), "left_anti")


def op8_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_components(table(spark, folder, "documents"))
