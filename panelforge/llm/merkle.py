"""Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf. The leaves of a group (a language) ascend by id; runs of ``fanout`` consecutive nodes become their hash until one node, the
subroot, remains; subroots, in the order of their groups, are the leaves of a last tree of the same rule, which gives the root.

1. Leaves are hashed where the text lies; only digests move. They take exact positions from a range exchange: a place in the sorted partition
   plus the counts of the partitions before it. Consecutive positions form partitions of ``fanout ** levels`` leaves, aligned with the tree.
2. Each partition folds its leaves to its subtree root.
3. Butterfly rounds: in round r, aligned groups of ``fanout`` subtrees of ``fanout ** r`` partitions swap their roots: each partition asks one partition of
   each sibling subtree (spread over that subtree, also where the last one is short) and hashes the common ancestor itself. All partitions of a subtree
   do so redundantly, so after the last round each holds the root and its own upper proof, and nothing has to travel down again.
4. The partition joins its lower proofs with its upper proof.

The same rounds over the subroots complete the proofs. A round is one join of a table with one row per partition, written to the shared folder.

Defined results: a null value is hashed as ``-``; ids that are null come first; rows of one id follow by their digest, and rows equal in that too share
digests, so their order shows nowhere; a null group comes first; a group of one leaf has that leaf as its subroot; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.staging import staged
from panelforge.llm.common import ROW, hash_parts, with_row

FANOUT = 2
LEVELS = 12
PER_TASK = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"
LOW_BITS = (1 << 33) - 1  # of monotonically_increasing_id: the row's place in its partition


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """The leaf over some values, in order."""
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def folded(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """All levels of a tree, the leaves first; ``levels`` of them above the leaves, or as many as lead to one node."""
    out = [nodes]
    while len(out) - 1 < levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([_hash("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return out


def siblings(tree: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """What stands left and right of the leaf's ancestors in their runs, level by level."""
    found = []
    for level in tree[:-1]:
        start = at - at % fanout
        found.append(("".join(level[start:at]), "".join(level[at + 1 : start + fanout])))
        at //= fanout
    return found


def numbered(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Rows (grp, key columns starting with ``k_``, leaf, more) with their partition ``part``, the group's number of ``parts`` and place ``at`` in the partition."""
    keys = ["grp", *(c for c in rows.columns if c.startswith("k_"))]
    parts = hash_parts(rows, rows.count(), PER_TASK)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_BITS))
    dealt = staged(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"_task": F.spark_partition_id(), "_place": place}), "sorted")
    counts = dealt.groupBy("grp", "_task").agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    before = Window.partitionBy("grp").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).withColumn("size", F.sum("n").over(Window.partitionBy("grp")))
    offsets = staged(offsets.select("grp", "_task", "offset", "size"), "offsets")
    block = fanout**levels
    position = F.col("offset") + F.col("_place")
    spread = {"part": F.floor(position / block).cast("long"), "at": (position % block).cast("int"), "parts": F.ceil(F.col("size") / block).cast("long")}
    return dealt.join(offsets, ["grp", "_task"]).withColumns(spread).drop("_task", "_place", "offset", "size", *keys[1:])


def subtrees(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """grp, part, parts, root of the partition's subtree and an empty proof."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        parts = table.column("parts")[0].as_py()
        root = folded(table.column("leaf").to_pylist(), fanout, levels if parts > 1 else None)[-1][0]
        return pa.table([table.column(c).slice(0, 1) for c in ("grp", "part", "parts")] + [pa.array([root])], names=["grp", "part", "parts", "root"])

    found = leaves.select("grp", "part", "parts", "at", "leaf").groupBy("grp", "part").applyInArrow(run, "grp string, part long, parts long, root string")
    return found.withColumn("proof", F.array().cast(PROOF))


def butterfly(state: DataFrame, fanout: int) -> DataFrame:
    """Rounds of exchange until every partition holds its group's root and its upper proof."""
    state = staged(state, "round")
    most, stride = state.agg(F.coalesce(F.max("parts"), F.lit(1))).first()[0], 1
    while stride < most:
        mine = F.floor(F.col("part") / stride)
        other = (mine - mine % fanout + F.col("j")).cast("long")
        begin = other * stride
        partner = begin + (F.col("part") - mine * stride) % F.least(F.lit(stride), F.col("parts") - begin)
        slots = F.sequence(F.lit(0), F.lit(fanout - 1))
        asks = state.select("grp", "part", "parts", F.explode(slots).alias("j")).where((F.col("j") != mine % fanout) & (begin < F.col("parts")))
        asks = asks.select("grp", "part", "j", partner.cast("long").alias("partner"))
        told = asks.join(state.select("grp", F.col("part").alias("partner"), F.col("root").alias("given")), ["grp", "partner"])
        told = told.groupBy("grp", "part").agg(F.sort_array(F.collect_list(F.struct("j", "given"))).alias("told"))  # fanout - 1 at most
        joined = state.join(told, ["grp", "part"], "left")

        def side(keep):
            return F.coalesce(F.concat_ws("", F.transform(F.filter("told", keep), lambda t: t["given"])), F.lit(""))

        left, right = side(lambda t: t["j"] < mine % fanout), side(lambda t: t["j"] > mine % fanout)
        climbs = F.col("parts") > stride
        root = F.when(climbs, F.sha2(F.concat(left, "root", right).cast("binary"), 256)).otherwise(F.col("root"))
        proof = F.when(climbs, F.concat("proof", F.array(F.struct(left.alias("left"), right.alias("right"))))).otherwise(F.col("proof"))
        state = staged(joined.select("grp", "part", "parts", root.alias("root"), proof.alias("proof")), "round")
        stride *= fanout
    return state


def climbed(leaf: str, proof: list[tuple[str, str]]) -> str:
    for left, right in proof:
        leaf = _hash(left + leaf + right)
    return leaf


def _finished(fanout: int, levels: int, names: list[str]):
    def run(leaves: pa.Table, upper: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("at")
        nodes = leaves.column("leaf").to_pylist()
        tree = folded(nodes, fanout, levels if leaves.column("parts")[0].as_py() > 1 else None)
        above = [(s["left"], s["right"]) for s in upper.column("proof")[0].as_py()]
        proofs, tops = [], []
        for at, (leaf, claimed) in enumerate(zip(nodes, leaves.column("claimed").to_pylist())):
            proof = siblings(tree, at, fanout) + above
            proofs.append(_hash("".join(left + right for left, right in proof)))
            tops.append(climbed(claimed or leaf, proof))
        n = len(nodes)
        same = [pa.array([upper.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")]
        return pa.table([*(leaves.column(c) for c in names), *same, pa.array(proofs), pa.array(tops)], names=[*names, "subroot", "root", "proof_sha256", "folded_root"])

    return run


def forest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Proofs of all leaves.

    ``rows``: grp (string, not null, groups ascend by it), key columns ``k_...`` that order a group, leaf, claimed (another digest to be
    folded with the proof, or null) and any more. Returns these but the keys, with part, at, parts, subroot, root, proof_sha256 and folded_root.
    """
    leaves = staged(numbered(rows, fanout, levels), "leaves")
    state = butterfly(subtrees(leaves, fanout, levels), fanout)
    subroots = state.where("part = 0").select(F.lit("").alias("grp"), F.col("grp").alias("k_grp"), F.col("grp").alias("of"), F.col("root").alias("leaf"))
    tops = staged(numbered(subroots, fanout, levels), "subroots")
    top = butterfly(subtrees(tops, fanout, levels), fanout)

    def lower(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree = folded(table.column("leaf").to_pylist(), fanout, levels if table.column("parts")[0].as_py() > 1 else None)
        above = upper.column("proof")[0].as_py()
        proofs = [[{"left": a, "right": b} for a, b in siblings(tree, at, fanout)] + above for at in range(table.num_rows)]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table([table.column("of"), pa.array([upper.column("root")[0].as_py()] * table.num_rows), pa.array(proofs, kind)], names=["grp", "root", "more"])

    last = tops.groupBy("grp", "part").cogroup(top.groupBy("grp", "part")).applyInArrow(lower, f"grp string, root string, more {PROOF}")
    upper = state.select("grp", "part", F.col("root").alias("subroot"), "proof").join(staged(last, "tops"), "grp")
    upper = staged(upper.select("grp", "part", "subroot", "root", F.concat("proof", "more").alias("proof")), "proofs")
    kinds = ", ".join(f"`{n}` {k}" for n, k in leaves.dtypes)
    out = f"{kinds}, subroot string, root string, proof_sha256 string, folded_root string"
    return leaves.groupBy("grp", "part").cogroup(upper.groupBy("grp", "part")).applyInArrow(_finished(fanout, levels, leaves.columns), out)


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row.

    Rows where ``tampered`` holds are folded from the leaf that one more in n_chars gives; all proofs are those of the rows as they are.
    """
    cols = {c: F.col(c) for c in FIELDS}
    marked = with_row(docs.select(*FIELDS))
    other = F.when(F.coalesce(tampered if tampered is not None else F.lit(False), F.lit(False)), digest(*(cols | {"n_chars": F.col("n_chars") + 1}).values()))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    key = F.struct(F.col("doc_id").alias("id"), digest(*cols.values()).alias("leaf"))
    rows = marked.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), other.alias("claimed"), ROW)
    rows = staged(rows.select("grp", F.col("doc_id").alias("k_1"), F.col("key.leaf").alias("k_2"), F.col(ROW).alias("k_3"), "doc_id", F.col("key.leaf").alias("leaf"), "claimed"), "digests")
    found = forest(rows, fanout, levels)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
