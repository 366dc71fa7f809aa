"""The trie of conversation prefixes, with subtree sums by the Euler tour technique.

A node is a distinct sequence of first turns, named by 128 bits: running sums of hashes of (position, role, text), so a
prefix is named without gathering its turns. The tour enters and leaves every node once: an enter arc is followed by the
enter arc of the first child, or by the node's own exit arc; an exit arc by the enter arc of the next sibling, or by the
parent's exit arc. ``list_ranking`` ranks the tour over the cluster and gives the prefix sums at every arc; what lies
between the two arcs of a node is its subtree.

The children of one parent can be a large part of all nodes (those of the root are). They are cut into pieces by a hash of
their id, the next sibling is found inside the piece, and a table of one row per parent and piece links the pieces and
brings the parent's id and name. A conversation of more than ``PIECE_TURNS`` turns is summed in pieces. The names of the
conversations that end at a node pass its digest in ascending runs, so no task holds them all.

Defined results: turns are in the order of ``turn`` (null first), then role, then text; null role or text is empty;
repeated rows are turns of their own; rows without a conv_id take no part; conversations without turns are members of the
root; no conversation gives no node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.llm.common import text_or_empty, written
from cohortspark.llm.list_ranking import WALKED, prefix_sums
from cohortspark.operators.ordered import row_numbers

#: Nodes per piece of children, about, if one parent had all of them.
PIECE_NODES = 1000
#: Turns of a conversation that one task may number and sum; more are cut.
PIECE_TURNS = 100_000
#: Conversations whose names make one run have an id in common up to so many low bits.
RUN_BITS = 12

_WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """conv_id, place (from 1), two hashes of role and text, and the number of words of every turn."""
    role, text = text_or_empty("role").cast("string"), text_or_empty("text").cast("string")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.coalesce(F.col("turn").cast("decimal(20,0)"), F.lit(Decimal(-10) ** 19)).alias("turn"),
        role.alias("role"), text.alias("text"))
    numbered = row_numbers(rows, ["conv_id"], [("turn", False), ("role", False), ("text", False)], "place", piece_turns)
    return numbered.select(
        "conv_id", "place", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"),
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"))


def _names(depth: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    return F.xxhash64(depth, s1, s2), F.xxhash64(s2, depth, s1)


def prefixes(turns: DataFrame, ids: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """A row per conversation and depth, 0 included: the name of the prefix (k1, k2) and of its parent (p1, p2), the words
    of its last turn, and whether the conversation ends there. ``turns``: conv_id, place, h1, h2, words, places from 1
    without a gap; ``ids``: all conv_ids.
    """
    number = lambda c: F.xxhash64("place", *c).cast("decimal(20,0)")
    rows = turns.select("conv_id", F.col("place").cast("long").alias("depth"), "words",
                        number(["h1", "h2"]).alias("a1"), number(["h2", "h1"]).alias("a2"))
    zero = F.lit(0).cast("decimal(20,0)")
    rows = rows.unionByName(ids.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), zero.alias("a1"), zero.alias("a2")))
    piece = F.floor(F.col("depth") / piece_turns)
    rows = rows.withColumn("piece", piece)
    whole = Window.partitionBy("conv_id", "piece").orderBy("depth")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("conv_id", "depth", "piece", "words", "a1", "a2", F.sum("a1").over(upto).alias("s1"),
                       F.sum("a2").over(upto).alias("s2"), F.lead("depth").over(whole).isNull().alias("ends"))
    if turns.where(F.col("place") >= piece_turns).isEmpty():
        sums = sums.drop("piece")
    else:
        totals = rows.groupBy("conv_id", "piece").agg(F.sum("a1").alias("t1"), F.sum("a2").alias("t2"))
        before = Window.partitionBy("conv_id").orderBy("piece")
        earlier = before.rowsBetween(Window.unboundedPreceding, -1)
        totals = written(totals.select(
            F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece"), F.sum("t1").over(earlier).alias("t1"),
            F.sum("t2").over(earlier).alias("t2"), F.lead("piece").over(before).isNull().alias("last")), "trie-pieces")
        met = sums.join(totals, (F.col("conv_id") == F.col("_conv")) & (F.col("piece") == F.col("_piece")))
        sums = met.select("conv_id", "depth", "words", "a1", "a2", (F.col("s1") + F.coalesce("t1", F.lit(0))).alias("s1"),
                          (F.col("s2") + F.coalesce("t2", F.lit(0))).alias("s2"), (F.col("ends") & F.col("last")).alias("ends"))
    fixed = lambda c: c.cast("decimal(38,0)")  # noqa: E731  one type, so that equal sums hash alike
    s1, s2 = F.col("s1"), F.col("s2")
    k1, k2 = _names(F.col("depth"), fixed(s1), fixed(s2))
    p1, p2 = _names(F.col("depth") - 1, fixed(s1 - F.col("a1")), fixed(s2 - F.col("a2")))
    return sums.select("conv_id", "depth", "words", "ends", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"))


def _ends(rows: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of nodes at which conversations end: the digest of their ids, ascending, comma-joined."""
    runs = rows.where("ends").groupBy("k1", "k2", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (k1, k2) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["k1", "k2", "ends_sha256"])
                done = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], names=["k1", "k2", "ends_sha256"])

    dealt = runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "run").select("k1", "k2", "ids")
    return dealt.mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def _tour(nodes: DataFrame, piece_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The arcs of the tour (id, next, position, leaves, saved), and per node its parent's name and number of children."""
    pieces = max(1, math.ceil(nodes.count() / piece_nodes))
    children = nodes.where("depth > 0").select(
        "id", "p1", "p2", F.pmod(F.xxhash64("id"), F.lit(pieces)).alias("piece"))
    groups = children.groupBy("p1", "p2", "piece").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "k1", "k2")
    groups = groups.join(parents, (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2"))).select(
        F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), F.col("piece").alias("_piece"), "first", "last", "n", "parent", "parent_conv_id")
    groups = written(groups.withColumn("next_first", F.lead("first").over(Window.partitionBy("parent").orderBy("_piece"))), "trie-pieces")
    inside = Window.partitionBy("p1", "p2", "piece").orderBy("id")
    sibling = children.withColumn("sibling", F.lead("id").over(inside)).join(
        groups, (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2")) & (F.col("piece") == F.col("_piece"))).select(
        F.col("id").alias("_child"), F.coalesce("sibling", "next_first").alias("sibling"), "parent", "parent_conv_id")
    families = groups.groupBy(F.col("parent").alias("_node")).agg(
        F.min_by("first", "_piece").alias("child"), F.sum("n").alias("n_children"))
    known = nodes.join(families, F.col("id") == F.col("_node"), "left").join(sibling, F.col("id") == F.col("_child"), "left")
    known = written(known.select(
        "id", "k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "words", "child", "sibling", "parent"), "trie-family")
    enter, leave = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    none = F.lit(0).cast("long")
    arcs = known.select(F.inline(F.array(
        F.struct(enter("id").alias("id"), F.coalesce(enter("child"), leave("id")).alias("next"), F.lit(1).cast("long").alias("position"),
                 (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")),
        F.struct(leave("id").alias("id"), F.coalesce(enter("sibling"), leave("parent")).alias("next"), F.lit(1).cast("long").alias("position"),
                 none.alias("leaves"), none.alias("saved")))))
    return arcs, known


def prefix_trie(turns: DataFrame, ids: DataFrame, piece_nodes: int = PIECE_NODES, piece_turns: int = PIECE_TURNS,
                walked: int = WALKED) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    positions of its two arcs in the tour. Its text is that of the first ``depth`` turns of conversation ``conv_id``."""
    rows = written(prefixes(turns, ids, piece_turns), "trie-prefixes")
    nodes = rows.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "*"), "trie-nodes")
    arcs, known = _tour(nodes, piece_nodes)
    sums = prefix_sums(arcs, ["position", "leaves", "saved"], walked)
    entered = F.col("id") % 2 == 0
    at = sums.groupBy(F.shiftright("id", 1).alias("_id")).agg(*[
        F.max(F.when(entered == first, F.col(c))).alias(f"{c}_{name}")
        for c in ("position", "leaves", "saved") for name, first in (("in", True), ("out", False))])
    ends = _ends(rows).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    met = known.join(at, F.col("id") == F.col("_id")).join(ends, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    return met.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_out") - F.col("leaves_in")).alias("n_leaves"), (F.col("saved_out") - F.col("saved_in")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("position_in").alias("enter_position"), F.col("position_out").alias("exit_position"))


def with_shared_openings(turns: DataFrame, family: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations rebuilt to share openings: with h = crc32 of the decimal id modulo ``longest``,
    conversation c begins with the first h turns of conversation c - c % ``family`` and goes on with its own turns after
    its first h."""
    turns = written(turns, "trie-turns")
    opening = lambda c: F.crc32(F.encode(F.col(c).cast("string"), "utf-8")) % longest
    base = lambda c: F.col(c) - F.col(c) % family
    heads = turns.where((F.col("place") < longest) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("_base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "h1", "h2", "words"))).alias("heads"))
    heads = written(heads, "trie-openings")
    ids = written(turns.select("conv_id").distinct(), "trie-ids")
    opened = ids.join(heads, base("conv_id") == F.col("_base")).select(
        "conv_id", F.inline(F.slice("heads", F.lit(1), opening("conv_id").cast("int"))))
    sizes = heads.select("_base", F.size("heads").alias("n"))
    own = turns.where(F.col("place") > opening("conv_id")).join(sizes, base("conv_id") == F.col("_base"), "left")
    shift = opening("conv_id") - F.least(opening("conv_id"), F.coalesce("n", F.lit(0)))
    own = own.select("conv_id", (F.col("place") - shift).alias("place"), "h1", "h2", "words")
    return opened.unionByName(own), ids
