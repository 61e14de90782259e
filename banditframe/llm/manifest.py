"""A Merkle manifest of a table with a witness for every row, by aligned appends.

Leaves stand in the order of their ids, one tree for each group, and every 8 consecutive nodes have a parent. An `Appender` takes the
nodes of a block one after the other. A node that comes in begins with no witness; when its run of siblings is complete, they become the
next part of the witness of every leaf below each of them, and their parent is appended one level up, where the same happens. So
witnesses grow while the leaves stream in, and only open runs are kept.

Blocks of 512 leaves begin at multiples of 512, so a block's root is a node of the whole tree, whatever the other blocks are. Tasks take
blocks; their roots are appends to the next round's blocks, until one node is left of each group; these subroots are the appends of
the tree above the groups. A leaf's witness is its part inside its block and then its block's witness. That is put together on the
way down, one row a block, and not shipped with leaves.

Cases: a null field counts as "-"; ids ascend with null first, equal ids by their leaf, so repeated rows have a leaf and a
witness each; a null group is a group and comes first; a group of one row has its leaf as subroot; a table of one group has its
subroot as root; a lone node in the last run of its level gets a parent if the level has more nodes; an empty table gives an empty
result; columns that are not fields are not looked at.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditframe.llm.common import cut
from banditframe.plans.index import with_index

ARITY = 8
#: Leaves of a block: a power of ARITY.
BLOCK = ARITY**3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_WITNESS = "array<struct<at:int,others:array<string>>>"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields, each with its length in bytes, or "-" where it is null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, fields)), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


class Appender:
    """A tree of at most `levels` levels above its leaves that grows by appends; witness[k] is what is known of leaf k's so far: for
    each level its place in its run and the others of the run."""

    def __init__(self, levels: int) -> None:
        self.levels = levels
        self.open: list[list[tuple[str, list[int]]]] = [[] for _ in range(levels + 1)]
        self.witness: list[list[tuple[int, list[str]]]] = []

    def append(self, node: str) -> None:
        self.witness.append([])
        self._push(0, node, [len(self.witness) - 1])

    def _push(self, level: int, node: str, leaves: list[int]) -> None:
        self.open[level].append((node, leaves))
        if level < self.levels and len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for at, (_, leaves) in enumerate(run):
            part = (at, nodes[:at] + nodes[at + 1 :])
            for k in leaves:
                self.witness[k].append(part)
        self._push(level + 1, digest(nodes), [k for _, leaves in run for k in leaves])

    def close(self) -> str:
        """No more leaves come: runs that are open are complete as they are. The root."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]


def fold(node: str, witness: list[tuple[int, list[str]]]) -> str:
    """The root that follows from a node and its witness."""
    for at, others in witness:
        node = digest([*others[:at], node, *others[at:]])
    return node


def _grown(nodes: pa.Table) -> tuple[pa.Table, Appender, str]:
    nodes = nodes.sort_by("idx")
    n = nodes["n"][0].as_py()
    tree = Appender(height(n) if n <= BLOCK else height(BLOCK))
    for node in nodes["node"].to_pylist():
        tree.append(node)
    return nodes, tree, tree.close()


def _roots(nodes: pa.Table) -> pa.Table:
    nodes, _, root = _grown(nodes)
    n = nodes["n"][0].as_py()
    return pa.table({"tree": nodes["tree"][:1], "idx": nodes["block"][:1], "n": [-(-n // BLOCK)], "node": [root]})


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, idx, n, node), their blocks' roots as nodes, and so on until each tree has one node."""
    out = [nodes]
    while len(out) == 1 or (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        rows = out[-1].select("tree", "idx", "n", "node", F.floor(F.col("idx") / BLOCK).alias("block"))
        out.append(cut(rows.groupBy("tree", "block").applyInArrow(_roots, "tree long, idx long, n long, node string")))
    return out


def _spread(nodes: DataFrame, above: DataFrame, whole: bool) -> DataFrame:
    """nodes with subroot and root, and either with their witness, or with the digest of its parts (proof_sha256) and what a node
    `presented` in their place folds to. above: (tree, idx, witness, subroot, root) of the blocks' roots."""
    rows = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK))
    added = f"subroot string, root string, witness {_WITNESS}" if whole else "subroot string, root string, proof_sha256 string, folded_root string"
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields])
    witness_type = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))

    def one(rows: pa.Table, over: pa.Table) -> pa.Table:
        rows, tree, _ = _grown(rows)
        upper = [(p["at"], p["others"]) for p in over["witness"][0].as_py()]
        made = {c: pa.array([over[c][0].as_py()] * rows.num_rows, pa.string()) for c in ("subroot", "root")}
        if whole:
            made["witness"] = pa.array([[{"at": at, "others": others} for at, others in [*w, *upper]] for w in tree.witness], witness_type)
        else:
            rest = [x for _, others in upper for x in others]
            made["proof_sha256"] = pa.array([digest([*(x for _, others in w for x in others), *rest]) for w in tree.witness], pa.string())
            made["folded_root"] = pa.array([None if x is None else fold(x, [*w, *upper]) for x, w in zip(rows["presented"].to_pylist(), tree.witness)], pa.string())
        for name, column in made.items():
            rows = rows.append_column(name, column)
        return rows

    over = above.select("tree", F.col("idx").alias("block"), "witness", "subroot", "root")
    return rows.groupBy("tree", "block").cogroup(over.groupBy("tree", "block")).applyInArrow(one, schema).drop("block")


def _down(rounds: list[DataFrame], above: DataFrame, whole: bool = True) -> DataFrame:
    """The first round's nodes with what _spread adds, from the witness of each tree's last node (above)."""
    for k, nodes in reversed(list(enumerate(rounds[:-1]))):
        above = _spread(nodes, above, whole or k > 0)
        above = cut(above) if k else above
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: list[str] | None = None, presented: Column | None = None, witnesses: bool = False) -> DataFrame:
    """(id, group, position in the group, leaf, subroot, root) of each row, with its witness (for each level its place in the run and
    the others there), or else proof_sha256, the digest of all of these, and folded_root, which `presented` (a leaf; the own one if
    not given) and the witness fold to."""
    own = leaf([F.col(c) for c in fields or FIELDS])
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), own.alias("node"), (own if presented is None else presented).alias("presented"))
    leaves = cut(leaves)
    groups = with_index(leaves.groupBy("group").agg(F.count("*").alias("n")), [], ["group"], "tree")
    groups = cut(groups.select(F.col("group").alias("of"), "n", "tree"))
    rows = leaves.join(groups, leaves["group"].eqNullSafe(groups["of"])).drop("of")
    rows = with_index(rows, ["tree"], ["id", "node"], "idx")
    rounds = _rounds(cut(rows))
    # the subroots are the leaves of the tree above
    top = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(groups.count()).cast("long").alias("n"), "node")
    over = _rounds(cut(top))
    start = over[-1].select("tree", "idx", F.array().cast(_WITNESS).alias("witness"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    above = _down(over, start).select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "witness", F.col("node").alias("subroot"), "root")
    found = _down(rounds, cut(above), witnesses)
    rest = ["witness"] if witnesses else ["presented", "proof_sha256", "folded_root"]
    return found.select(F.col("id").alias(id_col), F.col("group").alias(group_col), F.col("idx").alias("position"), F.col("node").alias("leaf"), "subroot", "root", *rest)
