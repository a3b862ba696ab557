"""Merkle manifest of a dataset: a tree per group, and one tree over their roots.

Each row is a leaf: SHA-256 of its fields, every field as ``-`` if null, else
its UTF-8 byte count, a colon and the value.  Leaves of a group ascend by key;
runs of ``FANOUT`` neighbours become the SHA-256 of their digests as hex text,
level by level, until one node is left, the subroot.  Subroots, ordered by group
(null first, bytewise), form the upper tree in the same way.

Spark hashes leaves and parents itself, sorts rows by range, so that a group
with a third of all rows spreads over tasks, and builds one level at a time;
levels shrink by the fan-out.  A run of leaves then meets the children of its
ancestors (one chain of bounded lists for 16 leaves), and a task folds all its
leaves: a parent is a running SHA state, copied before each child slot and kept
for the leaves that follow; a replacement resumes the copy of its slot and takes
in the right siblings only, never those on the left.

Defined results: null keys come first in their group; a null group is a group;
rows of equal key are ordered by their digest, and equal rows are leaves of
their own; an empty table gives no rows.  Other columns than key, group and
fields do not matter and are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from busweave.llm.ranks import ranked
from busweave.session import settle

_BITS = 4
FANOUT = 1 << _BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_MOST_PARENTS = 2048


class Manifest(NamedTuple):
    """Written tables of a manifest.

    ``leaves``: (tree, size, run, members, digest), ``levels``: (tree, run, n,
    children, digest) per level above, ``groups``: (tree, __group, size,
    subroot), ``upper``: the levels over the subroots.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    upper: list[DataFrame]
    key_type: str


def field_text(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field_text, fields)), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(children: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(children, _hex), ""), 256))


def _up(place: Column | str, levels: int = 1) -> Column:
    """Number of the ancestor so many levels above."""
    return F.shiftright(F.col(place) if isinstance(place, str) else place, _BITS * levels)


def _count_at(level: int) -> Column:
    """Nodes of a tree at a level, from its number of leaves."""
    return _up(F.col("size") + ((1 << _BITS * level) - 1), level)


def _placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with (tree, size, place), and the groups (tree, __group, size).

    Rows are range-sorted and written once; their places come from a small table
    of one row per partition and group.
    """
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    sorted_rows = settle(spread.withColumn("__row", F.monotonically_increasing_id()), "manifest-rows")
    part = F.shiftright("__row", 33)
    per = settle(
        sorted_rows.groupBy(group, part.alias("__part")).agg(F.min("__row").alias("__low"), F.count("*").alias("__n")),
        "manifest-parts",
    )
    sizes = per.groupBy(group).agg(F.sum("__n").alias("size"))
    groups = settle(ranked(sizes, [], [group], "tree", "manifest-groups"), "manifest-trees")
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per.withColumn("__shift", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low"))
    trees = groups.withColumnRenamed(group, "__of")
    shifts = shifts.join(trees, F.col(group).eqNullSafe(F.col("__of"))).select(
        F.col("__part").alias("__p"), "__of", "__shift", "size", "tree"
    )
    shifts = settle(shifts, "manifest-shifts")
    same = (part == F.col("__p")) & F.col(group).eqNullSafe(F.col("__of"))
    placed = sorted_rows.join(shifts, same).withColumn("place", F.col("__row") + F.col("__shift"))
    return placed.drop("__row", "__p", "__of", "__shift", group), groups


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables (tree, run, n, children, digest) of the nodes (tree, place, n, digest) with n > 1, bottom up."""
    levels = []
    while most > 1:
        runs = nodes.filter("n > 1").groupBy("tree", "n", _up("place").alias("run")).agg(
            F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("__members")
        )
        children = F.transform("__members", lambda m: m["digest"])
        runs = runs.select("tree", "run", "n", children.alias("children")).withColumn("digest", _parent(F.col("children")))
        levels.append(settle(runs, f"manifest-level-{len(levels)}"))
        most = -(-most // FANOUT)
        nodes = levels[-1].select("tree", F.col("run").alias("place"), _up(F.col("n") + FANOUT - 1).alias("n"), "digest")
    return levels


def build(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    fields: tuple[str, ...] = FIELDS,
    changed: Column | None = None,
) -> Manifest:
    """The manifest's tables; ``changed`` is a digest to fold in a leaf's stead, null for its own."""
    none = F.lit(None).cast("binary")
    leaves = settle(
        docs.select(
            F.col(key).alias("__key"),
            F.col(group).alias("__group"),
            leaf_digest(*(F.col(f) for f in fields)).alias("leaf"),
            (none if changed is None else changed).alias("changed"),
        ),
        "manifest-leaves",
    )
    placed, groups = _placed(leaves, "__group", ["__key", "leaf"])
    member = F.struct("place", F.col("__key").alias("key"), "leaf", "changed")
    runs = placed.groupBy("tree", "size", _up("place").alias("run")).agg(
        F.sort_array(F.collect_list(member)).alias("members")
    )
    children = F.transform("members", lambda m: m["leaf"])
    lone = F.col("size") == 1
    digest = F.when(lone, F.col("members")[0]["leaf"]).otherwise(_parent(children))
    runs = settle(runs.withColumn("digest", digest), "manifest-runs")

    most = groups.agg(F.max("size"), F.count("*")).first()
    nodes = runs.select("tree", F.col("run").alias("place"), _count_at(1).alias("n"), "digest")
    levels = _levels(nodes, -(-(most[0] or 0) // FANOUT))
    tops = runs.filter(F.col("size") <= FANOUT).select("tree", "digest")
    for level in levels:
        tops = tops.union(level.filter(F.col("n") <= FANOUT).select("tree", "digest"))
    groups = settle(groups.join(tops.withColumnRenamed("digest", "subroot"), "tree"), "manifest-subroots")
    upper = _levels(
        groups.select(
            F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"),
            F.lit(most[1]).cast("long").alias("n"), F.col("subroot").alias("digest"),
        ),
        most[1],
    )
    return Manifest(runs, levels, groups, upper, leaves.schema["__key"].dataType.simpleString())


def _chains(manifest: Manifest) -> DataFrame:
    """(tree, run, chain): children lists of all ancestors above the runs of leaves with number div FANOUT = run."""
    above = None
    for runs in reversed(manifest.upper):
        own = F.array("children")
        if above is None:
            above = runs.select("run", own.alias("chain"))
        else:
            below = runs.select("run", "children", _up("run").alias("__up"))
            top = above.select(F.col("run").alias("__up"), "chain")
            above = below.join(top, "__up").select("run", F.concat(own, "chain").alias("chain"))
    trees = manifest.groups.select("tree", "size")
    if above is None:
        tops = trees.withColumn("chain", F.array().cast("array<array<binary>>"))
    else:
        tops = trees.withColumn("run", _up("tree")).join(above, "run").drop("run")
    tops = settle(tops.withColumn("run", F.lit(0).cast("long")), "manifest-tops")
    chain = None
    for level in range(len(manifest.levels), -1, -1):
        nodes = _count_at(level)
        ends = tops.filter((nodes <= FANOUT) & (nodes > (0 if level == 0 else 1))).select("tree", "run", "chain")
        upper = ends if chain is None else chain.union(ends)
        if level == 0:
            return upper
        runs = manifest.levels[level - 1].select("tree", "run", "children", _up("run").alias("__up"))
        upper = upper.withColumnRenamed("run", "__up")
        chain = settle(
            runs.join(upper, ["tree", "__up"]).select("tree", "run", F.concat(F.array("children"), "chain").alias("chain")),
            f"manifest-chain-{level}",
        )
    raise AssertionError


class Parent:
    """A node's hash with the states kept before each child's slot."""

    def __init__(self, children: list[bytes]):
        state = hashlib.sha256()
        self.before = []
        texts = [c.hex().encode() for c in children]
        for text in texts:
            self.before.append(state.copy())
            state.update(text)
        self.text = b"".join(texts)
        self.width = len(texts[0])
        self.digest = state.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        """The node's hash with another child in the slot."""
        state = self.before[slot].copy()
        state.update(replacement.encode())
        state.update(self.text[self.width * (slot + 1) :])
        return state.hexdigest()

    def siblings(self, slot: int) -> bytes:
        return self.text[: self.width * slot] + self.text[self.width * (slot + 1) :]


def _ancestors(tree: int, size: int, run: int, chain: list, known: dict) -> list[tuple[Parent, int]]:
    """Parents above a run of leaves with the slot that its path takes, bottom up."""
    out, heights, n = [], 0, -(-size // FANOUT)
    while n > 1:
        n, heights = -(-n // FANOUT), heights + 1
    at = run
    for i, children in enumerate(chain):
        if i == heights:
            at = tree
        name = (tree, i, at // FANOUT) if i < heights else (-1, i - heights, at // FANOUT)
        if name not in known:
            if len(known) >= _MOST_PARENTS:
                known.clear()
            known[name] = Parent(children)
        out.append((known[name], at % FANOUT))
        at //= FANOUT
    return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        keys, out = [], []
        for row in batch.to_pylist():
            size, members = row["size"], row["members"]
            above = _ancestors(row["tree"], size, row["run"], row["chain"], known)
            heights = len(above) - row["upper"]
            rest = b"".join(parent.siblings(slot) for parent, slot in above)
            first = Parent([m["leaf"] for m in members]) if size > 1 else None
            own = first.digest if first else members[0]["leaf"].hex()
            subroot = above[heights - 1][0].digest if heights else own
            root = above[-1][0].digest if above else own
            for slot, m in enumerate(members):
                leaf = m["leaf"].hex()
                now = (m["changed"] or m["leaf"]).hex()
                now = first.fold(slot, now) if first else now
                for parent, place in above:
                    now = parent.fold(place, now)
                proof = hashlib.sha256((first.siblings(slot) if first else b"") + rest).hexdigest()
                keys.append(m["key"])
                out.append((leaf, subroot, root, proof, now, now == root))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kind = batch.schema.field("members").type.value_type.field("key").type
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, kind), *(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.bool_())],
            names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def verify(manifest: Manifest, key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) per leaf.

    ``proof_sha256`` is the hash of all siblings from the leaf up to the root;
    ``folded_root`` is computed from the changed leaf, or the leaf itself, and
    ``verified`` tells whether it is the root.
    """
    chains = _chains(manifest).withColumnRenamed("run", "__up")
    runs = manifest.leaves.select("tree", "size", "run", "members", _up("run").alias("__up"))
    joined = runs.join(chains, ["tree", "__up"]).drop("__up").withColumn("upper", F.lit(len(manifest.upper)))
    schema = f"key {manifest.key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return joined.mapInArrow(_folded, schema).withColumnRenamed("key", key)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents, those with lower-cased text among them found out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", upper, upper.lower())
    other = leaf_digest(*(lowered if f == "text" else F.col(f) for f in FIELDS))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return verify(build(docs, changed=F.when(tampered, other)))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
