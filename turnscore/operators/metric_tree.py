"""A metric tree over unit vectors of two sides, and searches over pairs of its nodes.

Every node with more than ``leaf_rows`` vectors is split, round by round and without a
depth limit: each of its vectors goes to the nearest of FAN pivots drawn from the node,
so a child is a ball around its pivot whose radius is the largest angle to it. Vectors of
one direction, which no pivot divides, are dealt to leaves by hash. From centres and radii every node
pair has bounds on the cosine of all its vector pairs.

A search starts at the pair of roots and expands, in rounds, only node pairs whose bounds
can still hold a result. It runs inside the tasks that multiply the leaves (``products``),
so no table of pairs is made at any level. For extremes a dive through the most promising
pairs comes first: it ends at a few leaf pairs, whose products give the limits that prune
the search.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore.session import materialize, release

#: Children of a node, vectors of a leaf, and node pairs a dive follows at each end.
FAN, LEAF_ROWS, DIVE = 16, 1024, 8
#: Blocks of a side at least, bytes of a block's vectors at most, and numbers of a product at most.
BLOCKS, BLOCK_BYTES, PRODUCT = 8, 64 << 20, 1 << 21
#: Keeps the bounds safe from rounding (an angle near zero is off by up to 1e-8).
_SLACK = 1e-6
#: Cosines this close to one count as one direction.
_SAME = 1e-9


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


@dataclass
class Tree:
    """``children`` (parent, node, c, r, leaf, no): a node's children with centre and radius; a leaf is its own child
    and has a number. ``leaves`` (node, ids, us, no). Nodes are paths that begin with the side, ``r`` or ``s``."""
    children: DataFrame
    leaves: DataFrame

    def release(self) -> None:
        release(self.children), release(self.leaves)


def build(vectors: DataFrame, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Tree over ``vectors`` (side: true for ``s``; id; u: unit or zero vector). Written tables only; the driver
    holds none of the vectors."""
    open_ = materialize(vectors.select(F.when(F.col("side"), F.lit("s")).otherwise(F.lit("r")).alias("node"), "id", "u",
                                       F.lit(False).alias("closed")), "tree-members")
    done, inner, level = [], [], 0
    while True:
        size = materialize(open_.groupBy("node").agg(F.count("*").alias("n"), F.max("closed").alias("closed")), "tree-sizes")
        big = size.where((F.col("n") > leaf_rows) & ~F.col("closed"))
        done.append(open_.join(big, "node", "left_anti").select("node", "id", "u"))
        if big.isEmpty():
            break
        draw = F.pmod(F.xxhash64("id", F.lit(level)), F.col("n"))  # about 4 * FAN vectors of a node
        drawn = open_.join(big.select("node", "n"), "node").where(draw < 4 * FAN).groupBy("node").agg(
            F.slice(F.array_sort(F.collect_list(F.struct(draw.alias("h"), "id", "u"))), 1, FAN).alias("pivots"), F.first("n").alias("n"))
        drawn = materialize(drawn.select("node", "n", F.transform("pivots", lambda p: p.u).alias("pivots")), "tree-pivots")
        near = F.array_max(F.transform("pivots", lambda p, i: F.struct(dot(F.col("u"), p).alias("d"), (-i).alias("k"))))
        placed = materialize(open_.join(drawn, "node").select("node", "id", "u", near.alias("near")), "tree-placed")
        same = F.col("near.d") >= 1 - _SAME
        balls = placed.groupBy("node", (-F.col("near.k")).alias("k")).agg(
            F.count("*").alias("m"), F.min("near.d").alias("least"), F.count_if(same).alias("core")).join(drawn, "node")
        # a pivot that takes nearly all divides nothing: vectors of its own direction are dealt to leaves by hash
        parts = F.when(F.col("m") > 0.95 * F.col("n"), F.ceil(2 * F.col("core") / leaf_rows)).otherwise(F.lit(0)).cast("int")
        balls = materialize(balls.select(F.col("node").alias("parent"), "k", F.element_at("pivots", F.col("k") + 1).alias("c"),
                                         _angle(F.col("least")).alias("r"), parts.alias("parts")), "tree-balls")
        inner.append(balls.select("parent", F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("p"), "k", "c", "r").select(
            "parent", _path("parent", "k", "p").alias("node"), "c", "r"))
        to = balls.select(F.col("parent").alias("node"), "k", "parts")
        last, keys = open_, [placed.node == to.node, -F.col("near.k") == to.k]
        part = F.when((F.col("parts") > 0) & same, F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")) + 1).otherwise(F.lit(0))
        open_ = materialize(placed.join(to, keys).select(_path(placed.node, to.k, part).alias("node"), "id", "u", (part > 0).alias("closed")),
                            "tree-members")
        done[-1] = materialize(done[-1], "tree-done")
        release(last), release(size), release(placed), release(drawn)
        level += 1
    members = _union(done)
    kept = F.collect_list(F.when(F.col("u").isNotNull(), F.struct("id", "u"))).alias("x")  # null vectors have no pairs
    leaves = materialize(members.groupBy("node").agg(kept).where(F.size("x") > 0).select(
        "node", F.col("x.id").alias("ids"), F.col("x.u").alias("us"), F.monotonically_increasing_id().alias("no")), "tree-leaves")
    # a leaf's own centroid and radius are tighter than its ball
    own = _centred(leaves).select(F.col("node").alias("parent"), "node", "c", "r", F.lit(True).alias("leaf"), "no")
    edges = _union(inner) if inner else None
    if edges is not None:
        tight = own.select(F.col("node").alias("_n"), F.col("c").alias("_c"), F.col("r").alias("_r"), "no")
        edges = edges.join(tight, edges.node == tight._n, "left").select(
            "parent", "node", F.coalesce("_c", "c").alias("c"), F.coalesce("_r", "r").alias("r"), F.col("_n").isNotNull().alias("leaf"), "no")
        own = own.unionByName(edges)
    return Tree(materialize(own, "tree-nodes"), leaves)


def _union(frames):
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _path(parent, k, part) -> Column:
    return F.concat_ws(".", parent, F.concat_ws("-", F.col(k) if isinstance(k, str) else k, F.col(part) if isinstance(part, str) else part))


def _centred(leaves: DataFrame) -> DataFrame:
    """Adds the centroid ``c`` and the radius ``r`` (largest angle of a member to it) of the vectors ``us``."""
    zero = F.transform(F.col("us")[0], lambda x: x * 0.0)
    s = leaves.withColumn("_sum", F.aggregate("us", zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)))
    s = s.withColumn("_norm", F.sqrt(dot(F.col("_sum"), F.col("_sum"))))
    s = s.withColumn("c", F.when(F.col("_norm") > 0, F.transform("_sum", lambda x: x / F.col("_norm")))
                     .otherwise(F.transform("_sum", lambda x: x * 0.0)))
    s = s.withColumn("_mind", F.aggregate("us", F.lit(1.0), lambda acc, v: F.least(acc, dot(v, F.col("c")))))
    return s.withColumn("r", F.when(F.col("_norm") > 0, _angle(F.col("_mind"))).otherwise(F.lit(math.pi)))


def expand(pairs: DataFrame, tree: Tree, spread_out: bool = False) -> DataFrame:
    """Children of node pairs (a, b): (a, b, leaf, no_a, no_b, lb, ub) with bounds on the cosine of all their vectors
    (angle of the centres minus and plus both radii) and the numbers of leaves."""
    def side(x):  # merged, never broadcast: files of pairs are tiny for their rows, and the children grow with the table
        return tree.children.select(F.col("parent").alias(x), F.col("node").alias(f"n{x}"), F.col("c").alias(f"c{x}"),
                                    F.col("r").alias(f"r{x}"), F.col("leaf").alias(f"leaf{x}"), F.col("no").alias(f"no_{x}")).hint("merge")
    both = pairs.select("a", "b").join(side("a"), "a")
    if spread_out:  # few bytes, but much to compute
        both = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b")
    both = both.join(side("b"), "b")
    theta = _angle(dot(F.col("ca"), F.col("cb")))
    spread = F.col("ra") + F.col("rb")
    return both.select(F.col("na").alias("a"), F.col("nb").alias("b"), (F.col("leafa") & F.col("leafb")).alias("leaf"), "no_a", "no_b",
                       (F.cos(F.least(F.lit(math.pi), theta + spread)) - F.lit(_SLACK)).alias("lb"),
                       (F.cos(F.greatest(F.lit(0.0), theta - spread)) + F.lit(_SLACK)).alias("ub"))


def search(tree: Tree, keep: Callable[[DataFrame], DataFrame], name: str, bounds: bool = True) -> DataFrame:
    """Leaf pairs (a, b, leaf, no_a, no_b, lb, ub) reached from the roots through pairs that ``keep`` keeps; without
    ``bounds`` (no_a, no_b) alone, which are a tenth of the bytes."""
    at = tree.children.sparkSession.range(1).select(F.lit("r").alias("a"), F.lit("s").alias("b"))
    found, inner = None, 1
    while True:
        at = keep(expand(at, tree, inner > FAN))
        if not bounds:
            at = at.select(*[F.when(~F.col("leaf"), F.col(x)).alias(x) for x in ("a", "b")], "leaf", "no_a", "no_b")
        at = materialize(at, name)
        leaves = at.where("leaf") if bounds else at.where("leaf").select("no_a", "no_b")
        found = leaves if found is None else found.unionByName(leaves)
        at = at.where("not leaf")
        inner = at.count()
        if not inner:
            return found


def block(column: str, blocks: int) -> Column:
    """The block, of so many, to which a leaf or vector belongs."""
    return F.pmod(F.xxhash64(column, F.lit("block")), F.lit(blocks)).cast("int")


def blocks_of(rows: int, dim: int) -> int:
    """Blocks of a side with so many vectors: a task holds one, which takes BLOCK_BYTES at most."""
    return max(BLOCKS, math.ceil(8 * rows * dim / BLOCK_BYTES))


def products(tree: Tree, each: Callable, schema: str, low: float = -2.0, high: float = 2.0, pairs: list | None = None,
             without: list = ()) -> DataFrame:
    """Rows of ``schema`` that ``each`` makes of the products of leaf pairs: it is given, for a task, an iterator over
    (real ids, synthetic ids, matrix of their cosines) and yields record batches.

    Multiplied are the leaf pairs that a search from the roots reaches through node pairs with lb <= ``low`` or
    ub >= ``high``, but for those numbered in ``without``; or else just those numbered in ``pairs`` (few).

    Leaves of either side are dealt to a few blocks, and a pair of blocks is a cell, to which also the nodes above its
    leaves go. The search runs inside the cells, for one synthetic leaf after the other, so that no list of node or leaf
    pairs is made anywhere, and a vector is shuffled as often as the other side has blocks, however many leaf pairs
    there are. A task holds the real leaves of a cell; synthetic ones pass by."""
    size = tree.children.agg(F.max(F.size("c"))).first()[0] or 1
    rows = tree.leaves.where(F.col("node").startswith("r")).agg(F.sum(F.size("ids"))).first()[0] or 0
    n_r, n_s = blocks_of(rows, size), BLOCKS
    steps = F.split("node", "[.]")
    above = F.when(F.size(steps) > 2, F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, F.lit(1), k), ".")))

    def side(letter, own, other, kind):
        """Rows of the side's inner nodes (of ``kind``) and vectors (of the next one), in every cell of their blocks."""
        leaves = tree.leaves.where(F.col("node").startswith(letter))
        if pairs is not None:
            leaves = leaves.where(F.col("no").isin([p[letter == "s"] for p in pairs]))
        cell = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        cell = ("own", cell.alias("other")) if letter == "r" else (cell.alias("other"), "own")
        number = (F.col("own") * n_s + F.col("other") if letter == "r" else F.col("other") * n_s + F.col("own")).alias("cell")
        vectors = leaves.select("node", "no", block("no", own).alias("own"), F.explode(F.arrays_zip("ids", "us")).alias("x")).select(
            *cell, F.lit(kind + 1).alias("kind"), "node", "no", F.lit(0.0).alias("r"), F.col("x.ids").cast("long").alias("id"), F.col("x.us").alias("u"))
        inner = leaves.select(F.explode(above).alias("node"), block("no", own).alias("own")).distinct().join(
            tree.children.where(~F.col("leaf")).select("node", "c", "r"), "node").select(
            *cell, F.lit(kind).alias("kind"), "node", F.lit(-1).cast("long").alias("no"), "r", F.lit(-1).cast("long").alias("id"), F.col("c").alias("u"))
        both = vectors if pairs is not None else inner.unionByName(vectors)
        return both.select(number, "kind", "node", "no", "r", "id", "u")
    dealt = side("r", n_r, n_s, 0).unionByName(side("s", n_s, n_r, 2)).repartition(n_r * n_s, "cell").sortWithinPartitions("cell", "kind", "node", "no")
    most, slack, partners = PRODUCT, _SLACK, {}
    for a, b in without if pairs is None else pairs:
        partners.setdefault(b, []).append(a)

    def nodes_of(batches):
        """((cell, kind, node, number), radius, ids, vectors) of inner nodes and leaves."""
        # self-contained (numpy / pyarrow only): workers need no import of this package
        import numpy as np
        import pyarrow as pa
        at, r, ids, us = None, 0.0, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, kind, no = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind", "no"))
            node, vectors = batch.column("node"), batch.column("u")
            code = node.dictionary_encode().indices.to_numpy()
            new = (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1]) | (code[1:] != code[:-1])
            cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(cell)]]).tolist()
            for a, b in zip(cut, cut[1:]):
                key = int(cell[a]), int(kind[a]), node[a].as_py(), int(no[a])
                if key != at:
                    if ids:
                        yield at, r, pa.concat_arrays(ids), np.concatenate(us)
                    at, r, ids, us = key, batch.column("r")[a].as_py(), [], []
                ids.append(batch.column("id").slice(a, b - a))
                us.append(vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
        if ids:
            yield at, r, pa.concat_arrays(ids), np.concatenate(us)

    def ball(x):
        """Centroid and radius of a leaf's vectors."""
        import numpy as np
        c = x.sum(axis=0)
        norm = np.sqrt(c @ c)
        if not norm > 0:
            return c * 0.0, np.pi
        c = c / norm
        d = x @ c
        return c, float(np.arccos(np.clip(np.where(np.isnan(d), 1.0, d).min(), -1.0, 1.0)))

    def chain(node):
        """The node's ancestors below the root, and itself."""
        at = node.split(".")
        return [".".join(at[:k]) for k in range(2, len(at))] + [node]

    def levels_of(leaves, inner):
        """Per depth: centres and radii of the nodes there (a leaf is its own child), and each one's place in the depth above."""
        import numpy as np
        chains, out, seen = [chain(node) for node, _, _ in leaves], [], {}
        for t in range(max(map(len, chains))):
            place, up = {}, []
            for x in chains:
                node = x[min(t, len(x) - 1)]
                if node not in place:
                    place[node] = len(place)
                    up.append(seen[x[min(t - 1, len(x) - 1)]] if t else 0)
            balls = dict((node, (c, r)) for node, c, r in leaves)
            balls = [balls[node] if node in balls else inner[node] for node in place]
            out.append((np.stack([c for c, _ in balls]), np.array([r for _, r in balls]), np.array(up)))
            seen = place
        return out

    def reached(levels, path, known):
        """Which real leaves a search reaches beside a synthetic one, given as (node, centre, radius) from the root's
        child on; ``known`` keeps what holds for nodes above it."""
        import numpy as np
        near = np.arccos(np.clip(high - slack, -1.0, 1.0)) if high - slack <= 1 else -np.inf
        far = np.arccos(np.clip(low + slack, -1.0, 1.0)) if low + slack >= -1 else np.inf
        same = True
        for t in range(max(len(levels), len(path))):
            node, c, r = path[min(t, len(path) - 1)]
            same = same and t < len(known) and known[t][0] == node
            if same:
                continue
            del known[t:]
            centres, radii, up = levels[min(t, len(levels) - 1)]
            before = known[t - 1][1] if t else np.ones(1, bool)
            ok = before[up] if t < len(levels) else before.copy()
            at = np.flatnonzero(ok)
            if len(at):
                cos = (centres[at] if len(at) < len(ok) else centres) @ c
                theta = np.arccos(np.clip(np.where(np.isnan(cos), 1.0, cos), -1.0, 1.0))
                spread = radii[at] + r
                ok[at] = (theta - spread <= near) | (np.minimum(np.pi, theta + spread) >= far)
            known.append((node, ok))
        return known[max(len(levels), len(path)) - 1][1]

    def multiplied(batches):
        import numpy as np
        import pyarrow as pa
        now = None
        for (cell, kind, node, no), r, ids, x in nodes_of(batches):
            if cell != now:
                now, inner, leaves, number, held, ids_r, us_r, levels, inner_s, known = cell, {}, [], [], [0], [], [], None, {}, []
            if kind == 0 or kind == 2:
                (inner if kind == 0 else inner_s)[node] = x[0], r
                continue
            if kind == 1:
                leaves.append((node, *ball(x))), number.append(no), held.append(held[-1] + len(ids))
                ids_r.append(ids), us_r.append(x)
                continue
            if not leaves:
                continue
            if len(us_r) > 1 or isinstance(number, list):  # the block is whole
                ids_r, us_r = [pa.concat_arrays(ids_r)], [np.concatenate(us_r)]
                number, held = np.array(number), np.array(held)
            if pairs is not None:
                wanted = np.isin(number, partners.get(no, []))
            else:
                levels = levels or levels_of(leaves, inner)
                wanted = reached(levels, [(n, *inner_s[n]) for n in chain(node)[:-1]] + [(node, *ball(x))], known)
                if no in partners:
                    wanted = wanted & ~np.isin(number, partners[no])
            at = np.flatnonzero(wanted)
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(at) != 1)  # neighbours in the block are one product
            step = max(1, most // len(ids))
            for a, b in zip(held[at[np.append(0, cut + 1)]].tolist(), held[at[np.append(cut, len(at) - 1)] + 1].tolist()):
                for c in range(a, b, step):
                    d = min(b, c + step)
                    yield ids_r[0].slice(c, d - c), ids, us_r[0][c:d] @ x.T

    return dealt.mapInArrow(lambda batches: each(multiplied(batches)), schema)


def dive(pairs: DataFrame) -> DataFrame:
    """The DIVE pairs with the highest upper and as many with the lowest lower bound."""
    return pairs.orderBy(F.desc("ub")).limit(DIVE).unionByName(pairs.orderBy("lb").limit(DIVE)).distinct()
