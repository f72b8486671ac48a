"""Merkle manifest of a dataset: a content-addressed graph, and proofs by descent.

Rows are leaves of one tree per group, ordered by id; the trees' roots are leaves of a
tree over the groups. Every inner node is stored as one record (digest, children) under
its own digest, so equal subtrees are stored once. Requests for leaves descend from the
root: at each level the digit of the rank names the child to follow, and the other
children are collected. Requests that are still at one node descend as one row, so the
upper levels are small and no digest is hot. A path is collected from the root and
reversed for proofs, which run from the leaf. Only DataFrame and SQL functions run."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscore.llm.common import materialize, release

#: Children of a node, and levels that are built or descended in one job.
FAN, STEP = 3, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def row_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and the value; null is a hyphen."""
    texts = [v.cast("string") for v in values]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``, the row's number from 0 in its group by ``order`` (nulls first, repeated keys in any
    order), and ``n``, the group's rows. Rows are dealt by ranges of group and order, so a hot group
    spreads over tasks; only counts of (group, task) are summed up over a group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]] + [F.col("_tie").asc()]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    counts = materialize(ranged.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_at").alias("_first")), "counts")
    w = Window.partitionBy(*group)
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_part", "_first", F.sum("_c").over(w).alias("n"),
                           (F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))
    same = part == F.col("_part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = ranged.join(counts, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n")
    return materialize(out, "numbered")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _levels(leaves: Column, n: Column) -> Column:
    """STEP levels over the leaves' digests of a group, fewer where the tree ends: (levels, n, h), the first
    level being the leaves, n the tree's nodes at the last one, and h the levels added."""
    def one(below, i):
        run = F.transform(F.slice(below, i * FAN + 1, FAN), lambda x: x.digest)
        return F.struct(F.sha2(F.array_join(run, ""), 256).alias("digest"), run.alias("children"))

    def up(acc, _):
        below = F.element_at(acc.levels, -1)
        level = F.transform(F.sequence(F.lit(0), F.ceil(F.size(below) / FAN).cast("int") - 1), lambda i: one(below, i))
        return F.when(acc.n <= 1, acc).otherwise(F.struct(
            F.array_append(acc.levels, level).alias("levels"), F.ceil(acc.n / FAN).cast("long").alias("n"), (acc.h + 1).alias("h")))

    first = F.transform(leaves, lambda x: F.struct(x.alias("digest"), F.lit(None).cast("array<string>").alias("children")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEP)), F.struct(F.array(first).alias("levels"), n.cast("long").alias("n"), F.lit(0).alias("h")), up)


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Trees over ``leaves`` (tree, pos, n, digest): their roots (tree, height, digest), the records (digest,
    children) of their inner nodes, or None where there are none, and the greatest height. One aggregation
    builds STEP levels, from groups of FAN**STEP neighbours."""
    rows, roots, records, height = leaves.withColumn("height", F.lit(0)), [], [], 0
    n = leaves.agg(F.max("n")).first()[0] or 0
    while n > 1:
        roots.append(rows.where("n = 1"))
        run = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x.digest)
        up = (rows.where("n > 1").groupBy("tree", "height", F.floor(F.col("pos") / FAN**STEP).alias("pos"), "n").agg(run.alias("run"))
              .select("tree", "height", "pos", _levels(F.col("run"), F.col("n")).alias("x")))
        up = materialize(up.select("tree", "pos", "x.n", (F.col("height") + F.col("x.h")).alias("height"),
                                   F.element_at("x.levels", -1)[0].digest.alias("digest"),
                                   F.flatten(F.slice("x.levels", 2, STEP)).alias("records")), "merkle")
        records.append(up.select(F.explode("records").alias("r")).select("r.digest", "r.children"))
        rows = up.drop("records")
        for _ in range(STEP):
            height, n = height + (n > 1), -(-n // FAN)
    roots.append(rows.where("n = 1"))
    return _union(roots).select("tree", "height", "digest"), _union(records) if records else None, height


@dataclass
class Manifest:
    """``leaves`` (id, tree, pos, n, digest and what the caller added), ``groups`` (group, tree),
    ``records`` (digest, children; one row per digest), ``starts`` (tree, height, digest of each group's
    root), ``top`` (height and digest of the root; no row for an empty table)."""
    leaves: DataFrame
    groups: DataFrame
    records: DataFrame | None
    starts: DataFrame
    top: DataFrame
    heights: tuple[int, int]

    def release(self) -> None:
        for x in (self.leaves, self.groups, self.records):
            if x is not None:
                release(x)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns=COLUMNS, more: dict[str, Column] | None = None) -> Manifest:
    """The graph over ``docs``. ``more`` adds columns of ``docs`` to ``Manifest.leaves``.

    Leaves of a group ascend by id, then by digest (null ids first; rows equal in all ``columns`` are
    leaves of their own with one digest). Groups ascend bytewise, null first. A group of one row has its
    leaf as root, and so has a table of one group. Columns beyond ``columns`` do not count."""
    leaf = row_digest([F.col(c) for c in columns])
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf.alias("digest"),
                                   *[c.alias(k) for k, c in (more or {}).items()]), "leaves")
    placed = numbered(rows, ["grp"], ["id", "digest"])
    names = numbered(placed.select("grp").distinct().withColumn("one", F.lit(1)), ["one"], ["grp"])
    groups = names.select("grp", F.col("pos").alias("tree"))
    other = groups.select(F.col("grp").alias("_grp"), "tree")
    leaves = materialize(placed.join(other, placed.grp.eqNullSafe(other._grp)).drop("_grp", "grp"), "placed")
    release(rows), release(placed)
    starts, low, below = build(leaves.select("tree", "pos", "n", "digest"))
    starts = materialize(starts, "roots")
    top, high, above = build(starts.select(F.lit(-1).alias("tree"), F.col("tree").alias("pos"), F.lit(starts.count()).alias("n"), "digest"))
    stored = [x for x in (low, high) if x is not None]
    # by digest: equal subtrees are one record
    records = materialize(_union(stored).groupBy("digest").agg(F.min("children").alias("children")), "records") if stored else None
    return Manifest(leaves, names, records, starts, materialize(top, "top"), (below, above))


def step_down(at: DataFrame, records: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """From nodes (tree, pos, digest, path) to their children of the level below, each with one more segment
    of its path: the children left and right of it. With ``wanted`` (tree, pos), only to those."""
    child = F.posexplode("children").alias("digit", "digest")
    down = at.withColumnRenamed("digest", "parent").join(records.withColumnRenamed("digest", "parent"), "parent").select(
        "tree", F.col("pos").alias("above"), "path", "children", child)
    side = lambda a, b: F.array_join(F.slice("children", a, b), "")
    segment = F.struct(side(F.lit(1), F.col("digit")).alias("left"), side(F.col("digit") + 2, F.lit(FAN)).alias("right"))
    down = down.select("tree", (F.col("above") * FAN + F.col("digit")).alias("pos"), "digest", F.array_append("path", segment).alias("path"))
    return down if wanted is None else down.join(wanted, ["tree", "pos"], "left_semi")


def descend(starts: DataFrame, height: int, records: DataFrame | None, requests: DataFrame | None, stop: int) -> tuple[DataFrame, DataFrame]:
    """From ``starts`` (tree, height, digest, path) down to level ``stop``: the nodes there, and the starts
    that are lower. ``requests`` (tree, pos of leaves) limits the descent; None asks for all leaves."""
    at = None
    for level in range(height, stop - 1, -1):
        if at is not None:
            wanted = None if requests is None else requests.select("tree", F.floor(F.col("pos") / FAN**level).alias("pos")).distinct()
            at = step_down(at, records, wanted)
        here = starts.where(F.col("height") == level).select("tree", F.lit(0).cast("long").alias("pos"), "digest", "path")
        at = here if at is None else at.unionByName(here)
        if (height - level) % STEP == STEP - 1:  # the plan stays short
            at = materialize(at, "frontier")
    low = starts.where(F.col("height") < stop).select("tree", F.lit(0).cast("long").alias("pos"), "digest", "path")
    return (at if at is not None else low.limit(0)), low


NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``m.leaves`` (all columns but pos and n) with ``subroot``, ``root`` and ``path``: the siblings (left,
    right) of every level from the leaf to the root. ``requests`` (tree, pos) asks for some leaves only."""
    top, _ = descend(m.top.withColumn("path", F.expr(NO_PATH)), m.heights[1], m.records,
                     None if requests is None else requests.select(F.lit(-1).alias("tree"), F.col("tree").alias("pos")).distinct(), 0)
    top = top.select(F.col("pos").alias("tree"), "path").join(m.starts, "tree")
    if requests is not None:
        top = top.join(requests.select("tree").distinct(), "tree", "left_semi")
    top = materialize(top, "starts")
    # requests meet their leaves at the parents, so that a path moves once for all children
    parents, lone = descend(top, m.heights[0], m.records, requests, 1)
    extra = [c for c in m.leaves.columns if c not in ("tree", "pos", "n")]
    asked = m.leaves if requests is None else m.leaves.join(requests, ["tree", "pos"], "left_semi")
    family = asked.where("n > 1").groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos")).agg(
        F.collect_list(F.struct((F.col("pos") % FAN).cast("int").alias("digit"), *extra)).alias("members"))
    out = []
    if m.heights[0]:
        side = lambda a, b: F.array_join(F.slice("children", a, b), "")
        digit = F.col("m.digit")
        joined = parents.join(m.records, "digest").drop("digest").join(family, ["tree", "pos"]).select(
            "tree", "path", "children", F.explode("members").alias("m"))
        out.append(joined.select("tree", *[F.col(f"m.{c}").alias(c) for c in extra], F.array_append("path", F.struct(
            side(F.lit(1), digit).alias("left"), side(digit + 2, F.lit(FAN)).alias("right"))).alias("path")))
    out.append(asked.where("n = 1").select("tree", *extra).join(lone.select("tree", "path"), "tree"))
    root = m.top.select(F.first("digest")).scalar()
    return (_union(out).join(m.starts.select("tree", F.col("digest").alias("subroot")), "tree")
            .withColumn("root", root).withColumn("path", F.reverse("path")))


def proof_digest(path: str = "path") -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256)


def folded(leaf: str, path: str = "path") -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(path, F.col(leaf), lambda acc, s: hashed(s.left, acc, s.right))


def verified_manifest(docs: DataFrame, changed: dict[str, Column], id_col: str = "doc_id", group_col: str = "source", columns=COLUMNS) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` gives new values of some columns; a row whose digest they change must not verify.
    folded_root follows from the changed leaf and the original siblings, and verified tells whether it is
    the root. Nulls in any column are values of their own; an empty text differs from null. Rows may
    repeat, and an empty table gives no rows."""
    now = row_digest([changed.get(c, F.col(c)) for c in columns])
    m = manifest(docs, id_col, group_col, columns, {"now": now})
    out = proofs(m).select("id", "digest", "subroot", "root", proof_digest().alias("proof_sha256"), folded("now").alias("folded_root"))
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
