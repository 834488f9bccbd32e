"""Merkle manifest of a table, by pivoting the children of a node into slot columns.

A leaf is the digest of a row's fields.  Inside a group the leaves stand in the
order of their key, and every ``fanout`` consecutive nodes become their digest,
level by level, until one is left: the group's root.  The group roots, in the order
of the groups, give the root of the table the same way.

A parent's children are spread into ``fanout`` columns, one conditional aggregate
a slot.  The columns joined are what the parent hashes; the columns but one's own
are that child's siblings.  Paths are then handed down from the root: a child's
path is its siblings followed by its parent's path, so siblings that many rows share are
built once a run and not once a row.

* Positions come from one range shuffle: rows sorted by (group, key, leaf) are numbered inside their partition, and the
  partitions' sizes a group are added up.  A group of any size is spread over as many partitions as its rows need.
* Every level is written (``common.keep``), each a ``fanout``-th of the one below, so none is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of monotonically_increasing_id that number the rows of one partition.
ROW_BITS = 33


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of the fields one after another: ``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    shown = [f.cast("string") for f in fields]
    return sha256(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]))


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``pos`` inside their ``group`` by ``order``, from 0, and the group's size ``n``."""
    dealt = rows.repartitionByRange(F.col("group").asc_nulls_first(), *order).sortWithinPartitions(F.col("group").asc_nulls_first(), *order)
    placed = keep(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", ROW_BITS)
    sizes = placed.groupBy("group", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    # rows of this window: one a group and partition
    groups = Window.partitionBy("group")
    before = F.coalesce(F.sum("size").over(groups.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(
        F.col("group").alias("of"), F.col("part").alias("dealt"), (before - F.col("first")).alias("shift"), F.sum("size").over(groups).alias("n")
    )
    met = placed.join(offsets, F.col("group").eqNullSafe(F.col("of")) & (part == F.col("dealt")))
    return met.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def _runs(nodes: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """A row per parent of ``nodes`` (``group, pos, n, digest`` and ``carried``): its children in the columns ``s0, s1, …``."""
    slot = F.col("pos") % fanout
    spread = [F.max(F.when(slot == k, F.struct("digest", *carried))).alias(f"s{k}") for k in range(fanout)]
    return nodes.where("n > 1").groupBy("group", F.floor(F.col("pos") / fanout).alias("parent"), "n").agg(*spread)


def _parents(runs: DataFrame, fanout: int) -> DataFrame:
    joined = F.concat_ws("", *[F.col(f"s{k}.digest") for k in range(fanout)])
    return runs.select("group", F.col("parent").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), sha256(joined).alias("digest"))


def _rise(leaves: DataFrame, carried: list[str], fanout: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The runs of each level, from the leaves up, and beside them the nodes that are alone at that level: their groups' roots."""
    longest = leaves.agg(F.max("n")).first()[0] or 0
    runs, alone, nodes = [], [], leaves
    while True:
        alone.append(nodes.where("n = 1"))
        if longest <= 1:
            return runs, alone
        runs.append(keep(_runs(nodes, carried if not runs else [], fanout), f"{name}-runs"))
        nodes, longest = _parents(runs[-1], fanout), -(-longest // fanout)


def _descend(runs: list[DataFrame], alone: list[DataFrame], above: DataFrame | None, carried: list[str], fanout: int) -> DataFrame:
    """The leaves with their ``path`` to the root: ``above`` has the path of each group's root (``of, group_path, group_root``; None: an empty one)."""

    def at_the_top(nodes: DataFrame, columns: list[str]) -> DataFrame:
        if above is None:
            empty = F.array().cast("array<struct<left:string,right:string>>")
            return nodes.select("group", "pos", "digest", *columns, empty.alias("path"), F.col("digest").alias("group_root"))
        met = nodes.join(above, F.col("group").eqNullSafe(F.col("of")))
        return met.select("group", "pos", "digest", *columns, F.col("group_path").alias("path"), "group_root")

    paths = at_the_top(alone[len(runs)], carried if not runs else [])
    for level in range(len(runs) - 1, -1, -1):
        columns = carried if not level else []
        upper = paths.select(F.col("group").alias("of"), F.col("pos").alias("over"), F.col("path").alias("rest"), "group_root")
        met = runs[level].join(upper, F.col("group").eqNullSafe(F.col("of")) & (F.col("parent") == F.col("over")))
        children = F.array(*[F.col(f"s{k}") for k in range(fanout)])
        each = met.select("group", "parent", "rest", "group_root", *[f"s{k}" for k in range(fanout)], F.posexplode(children).alias("slot", "own"))
        digests = F.array(*[F.col(f"s{k}.digest") for k in range(fanout)])
        siblings = F.struct(
            F.array_join(F.slice(digests, F.lit(1), F.col("slot")), "").alias("left"),
            F.array_join(F.slice(digests, F.col("slot") + 2, F.lit(fanout)), "").alias("right"),
        )
        below = each.where("own is not null").select(
            "group", (F.col("parent") * fanout + F.col("slot")).alias("pos"), "own.digest", *[f"own.{c}" for c in columns],
            F.concat(F.array(siblings), F.col("rest")).alias("path"), "group_root",
        )
        paths = below.unionByName(at_the_top(alone[level], columns))
    return paths


def manifest(docs: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id", fanout: int = 16,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: ``key, group, leaf, subroot, root, path`` and the columns of ``carry``.

    ``path`` lists, level by level from the leaf to ``root``, the digests joined that stand ``left`` and ``right`` of the
    row's node in its run.  Groups stand by their bytes, null first; rows of a group by key, null first, then by leaf,
    and rows that agree in all fields are interchangeable.  Null fields and empty texts have digests of their own
    (``leaf_digest``).  An empty table gives no rows and has no root.  Columns other than ``fields``, ``group`` and ``key`` are read by ``carry`` only.
    """
    carried = list(carry or {})
    rows = docs.select(
        F.col(group).cast("string").alias("group"), F.col(key).alias("key"), leaf_digest(*[F.col(f) for f in fields]).alias("digest"),
        F.struct(*[c.alias(n) for n, c in (carry or {}).items()] or [F.lit(None).cast("string").alias("none")]).alias("more"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = keep(rows, "leaves")
    # rows alike in everything are told apart by number, so that a range shuffle can split them
    leaves = _numbered(rows, [F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")], "ordered-leaves").drop("row")
    own = ["key", "more"]
    runs, alone = _rise(leaves, own, fanout, "leaf")
    tops = [a.select(F.col("group").alias("name"), "digest") for a in alone]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    roots = keep(roots.withColumn("group", F.lit(0)), "group-roots")
    placed = keep(_numbered(roots, [F.col("name").asc_nulls_first()], "ordered-roots"), "placed-roots")
    top_runs, top_alone = _rise(placed, ["name"], fanout, "root")
    root = top_alone[-1].first()
    paths = _descend(top_runs, top_alone, None, ["name"], fanout)
    above = keep(paths.select(F.col("name").alias("of"), F.col("path").alias("group_path"), F.col("digest").alias("group_root")), "group-paths")
    every = _descend(runs, alone, above, own, fanout)
    return every.select(
        F.col("key").alias(key), F.col("group").alias(group), F.col("digest").alias("leaf"), F.col("group_root").alias("subroot"),
        F.lit(root["digest"] if root else None).cast("string").alias("root"), "path", *[f"more.{c}" for c in carried],
    )


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return sha256(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""))


def folded(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` gives along ``path``."""
    return F.aggregate(path, leaf, lambda node, s: sha256(F.concat(s.left, node, s.right)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def tampered_check(docs: DataFrame, fields: list[str], text: str = "text", key: str = "doc_id", every: int = 5) -> DataFrame:
    """Each row held against the manifest, after the ``text`` of those whose crc32 of the key is divisible by ``every`` lost its capitals A-Z.

    ``key, leaf, subroot, root, proof_sha256`` are the untampered table's; ``folded_root`` is computed anew from the row as
    it is now and its siblings, ``verified`` tells whether that is the root.
    """
    touched = F.crc32(F.col(key).cast("string")) % every == 0
    changed = leaf_digest(*[lower_ascii(F.col(f)) if f == text else F.col(f) for f in fields])
    rows = manifest(docs, fields, key=key, carry={"now": F.when(touched, changed)})
    shown = rows.withColumn("folded_root", folded(F.col("path"), F.coalesce("now", "leaf")))
    return shown.select(
        key, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
