"""Merkle manifest of a data set: Pregel-style supersteps over RDDs hash leaves up to one root and hand sibling paths back down.

Every row is a leaf.  The leaves of a group, in order, are folded ``fanout`` at a time into a
subroot, and the groups' subroots in the same way into the root.  In an upward superstep each node sends its digest to
its ancestor a few levels above, and ancestors that have all their descendants hash these levels and forward.  In a downward superstep each
ancestor sends its descendants the path that it got itself, with the siblings in between in front, until the leaves can check
themselves against the root.  Digests are sha256, hashed as lower-case hexadecimal text.
"""

from __future__ import annotations

import math
from functools import partial
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that a task gets at least (as long as there are shuffle partitions for that) and at most, on average.
FEW, MANY = 6144, 500_000
#: Nodes that a superstep folds into one at most (or ``fanout``, where that is more).
BLOCK = 256


def leaf_hash(values: list[Column]) -> Column:
    """sha256 (binary) of the values one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def numbered(df: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """Add ``_i`` (place in the group, from 0) and ``_n`` (rows of the group); nulls come first.

    Rows are range partitioned by group and order and written to the checkpoint folder; a partition's rows are numbered on their own
    and shifted by what the partitions before it have of the group, so a hot group is numbered by many
    tasks.  Rows that are equal in ``order`` are placed by their hash of where they were read, which leaves no heap of ties.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    tied = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    placed = cut(tied.repartitionByRange(parts, *by, F.col("_tie")).withColumn("_part", F.spark_partition_id()))
    keys = ([group] if group else []) + ["_part"]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*([group] if group else [F.lit(0)]))
    before = F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")
    sizes = sizes.select(*keys, before.alias("_before"), F.sum("_rows").over(whole).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*by, "_tie")) - 1
    return placed.withColumn("_i", inside).join(sizes, keys).withColumn("_i", F.col("_i") + F.col("_before")).drop("_before", "_part", "_tie")


def _digest(parts: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in parts).encode()).digest()


def _tasks(nodes: int, most: int) -> int:
    return max(1, min(most, math.ceil(nodes / FEW)), math.ceil(nodes / MANY))


def _grown(family: list[tuple], levels: int, fanout: int) -> list[tuple[int, list[bytes]]]:
    """From a family's own level up to the one node above it: the nodes of the whole tree there, and the family's digests in order."""
    rows = [(family[0][1], [m[2] for m in family])]
    for _ in range(levels):
        nodes, row = rows[-1]
        rows.append((1, row) if nodes == 1 else (-(-nodes // fanout), [_digest(row[k : k + fanout]) for k in range(0, len(row), fanout)]))
    return rows


def _climb(nodes: RDD, size: int, trees: int, total: int, fanout: int, most: int) -> tuple[RDD, list[tuple[RDD, int, int]]]:
    """Supersteps upward over ((tree, place), (nodes of the tree, digest, payload)) until every tree is one node.

    A superstep rises as many levels at once as ``BLOCK`` allows, and all of them as many: its shuffles have a cost however few the nodes.
    Returns the tops, and of each step the families, ((tree, place of the ancestor), [(place in the family, nodes, digest, payload)]),
    with their number of tasks and of levels.  A tree that is down to one node before the others passes it on as it is.
    """
    depth = levels = 1
    while fanout**depth < size:
        depth += 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    rounds = -(-depth // levels)
    levels = -(-depth // rounds)
    width = fanout**levels
    send = lambda x: ((x[0][0], x[0][1] // width), (x[0][1] % width, *x[1]))
    steps: list[tuple[RDD, int, int]] = []

    def rise(family):
        count, (digest,) = _grown(family, levels, fanout)[-1]
        return count, digest, None

    for _ in range(rounds):
        family = nodes.map(send).groupByKey(tasks := _tasks(total, most)).mapValues(lambda ms: sorted(ms, key=lambda m: m[0]))
        nodes, total = family.mapValues(rise), total // width + trees
        steps.append((family, tasks, levels))
    return nodes, steps


def _hand(levels: int, fanout: int, x: tuple):
    """What a family gets from above, ((tree, place of the ancestor), (family, (path, told))), for each of its members."""
    (tree, place), (family, (path, told)) = x
    paths = [path]
    for nodes, row in reversed(_grown(family, levels, fanout)[:-1]):
        if nodes > 1:
            runs = [row[k : k + fanout] for k in range(0, len(row), fanout)]
            paths = [((at, b"".join(run[:at] + run[at + 1 :])), *above) for run, above in zip(runs, paths) for at in range(len(run))]
    for (at, _, digest, payload), path in zip(family, paths):
        yield (tree, place * fanout**levels + at), (path, told, digest, payload)


def _descend(got: RDD, steps: list[tuple[RDD, int, int]], fanout: int) -> RDD:
    """Supersteps downward from ((tree, 0), (path, told)) to the leaves' ((tree, place), (path, told, digest, payload)).

    A path is a tuple of (place in the run, digests of the others in a row), from the node's own run up.  Families stay
    where the way up has put them: what comes from above is dealt like them.
    """
    for family, tasks, levels in reversed(steps):
        reached = family.join(got.partitionBy(tasks), tasks).flatMap(partial(_hand, levels, fanout))
        got = reached.mapValues(lambda v: v[:2])
    return reached


def fold(leaf: bytes, path: tuple) -> bytes:
    """The root that a leaf and its siblings give."""
    for at, others in path:
        run = [others[k : k + 32] for k in range(0, len(others), 32)]
        leaf = _digest([*run[:at], leaf, *run[at:]])
    return leaf


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields=FIELDS, group: str = "source", order: str = "doc_id", fanout: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``order``, ``leaf``, ``subroot``, ``root``, ``at`` and ``proof``, ``folded``.

    ``proof`` has, from the leaf's run up to the root's, the digests of the other members of the run
    in one string (left to right), and ``at`` the row's own place there.  ``folded`` is the root that follows from ``proof`` and the
    row as it is found now, with ``changed`` in place of its columns: it equals ``root`` just where nothing has changed.

    Defined cases: nulls hash as ``-``, empty texts as ``0:``; a null group is a group and comes first, then groups by UTF-8 bytes;
    a null ``order`` comes first in its group, equal ones stand in the order of their leaves, and equal rows
    are leaves of their own; a group of one row is its own subroot, a run of one node is hashed like others; very
    long texts are hashed whole where they are read and never shuffled; an empty table gives no rows; columns outside
    ``fields``, ``group`` and ``order`` are ignored whatever their names.
    """
    spark = docs.sparkSession
    now = {f: docs[f] for f in fields} | (changed or {})
    named = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit("")).alias("_g")
    leaves = cut(docs.select(named, docs[order].alias("_id"), leaf_hash([docs[f] for f in fields]).alias("_leaf"), leaf_hash([now[f] for f in fields]).alias("_now")))
    placed = numbered(leaves, "_g", ["_id", "_leaf", "_now"])
    trees = cut(numbered(placed.groupBy("_g").agg(F.max("_n").alias("_size")), None, ["_g"]).withColumnsRenamed({"_i": "_t", "_n": "_trees"}))
    found = trees.agg(F.sum("_size").alias("rows"), F.max("_size").alias("size"), F.count(F.lit(1)).alias("trees")).first()
    kind = docs.schema[order].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, at array<int>, proof array<string>, folded string"
    if not found.rows:
        return spark.createDataFrame([], schema).withColumnRenamed("id", order)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.join(trees.select("_g", "_t"), "_g").select("_t", "_i", "_n", "_leaf", "_now", "_id")
    nodes = rows.rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), (r[5], bytes(r[4])))))
    tops, steps = _climb(nodes, found.size, found.trees, found.rows, fanout, most)
    roots, above = _climb(tops.map(lambda x: ((0, x[0][0]), (found.trees, x[1][1], None))), found.trees, 1, found.trees, fanout, most)
    subroots = _descend(roots.mapValues(lambda v: ((), v[1])), above, fanout)
    told = subroots.map(lambda x: ((x[0][1], 0), (x[1][0], (x[1][1], x[1][2]))))

    def check(x):
        path, (root, subroot), leaf, (ident, now) = x[1]
        return ident, leaf.hex(), subroot.hex(), root.hex(), [at for at, _ in path], [others.hex() for _, others in path], fold(now, path).hex()

    return spark.createDataFrame(_descend(told, steps, fanout).map(check), schema, verifySchema=False).withColumnRenamed("id", order)
