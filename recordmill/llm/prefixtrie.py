"""Prefix trie of conversations by fixed-length block hashing.

1. Every turn has a digest of its role and text; texts stay where they are read.  ``BLOCK``
   successive turns are one block.  A block's key hashes all digests from the conversation's
   start to the block's end (running sums of values drawn from place and digest), so equal
   keys mean equal beginnings, and conversations are grouped by the keys of their successive
   blocks, counted map-side.
2. A group with one following block, or none, needs nothing more: its members agree on all turns
   inside that block.  Only where siblings diverge are turn boundaries refined: the turns of
   one representative of each sibling are grouped by the keys at every turn.
3. A node is known by its smallest member and its depth.  The nodes of one smallest member are
   a chain, and chains hang on chains.  What lies below a chain is summed by pointer doubling
   over the chains, and below a node by a running sum up its chain.

Keys have 128 bits.  No conversation, group or chain has to fit in one task: positions and
running sums are computed in bounded runs (``plans.ordered``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.textarrays import prepare
from recordmill.plans.ordered import Running, dense_positions, ordinal, running
from recordmill.session import materialize

#: Turns of a block.
BLOCK = 4
#: Characters of a piece of a joined id list.
_PIECE = 1 << 16
_LANES = ("s0", "s1", "s2", "s3")


def ordered_turns(
    conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, at, d0, d1, chars): turns numbered from 1 with digests of role and text.

    Turns are ordered by turn, null first, and those that tie by their digests; repeated rows
    all count.  A null role or text is empty.  Rows without a conv_id are no conversation and
    are left out.  Other columns are not read; texts may be of any length.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    half = lambda k: _long(F.substring("__digest", k, 8)) * F.lit(1 << 31) + F.shiftright(_long(F.substring("__digest", k + 8, 8)), 1)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.length(text_).alias("chars"), digest.alias("__digest")
    )
    rows = rows.select("conv_id", "turn", half(1).alias("d0"), half(17).alias("d1"), F.col("chars").cast("long").alias("chars"))
    placed = dense_positions(rows, ["conv_id", "turn", "d0", "d1"], "pos")
    numbered = ordinal(placed, "pos", "at", within=["conv_id"])
    return numbered.select("conv_id", (F.col("at") + 1).alias("at"), "d0", "d1", "chars")


def _long(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def borrowed_heads(turns: DataFrame, *, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(members, turns) of conversations whose beginnings are those of their neighbours.

    Conversation c starts with the first h turns of conversation c - c % ``span`` (all if it has
    fewer, none if there is none), where h is crc32 of the decimal c modulo ``most``; its own turns
    after its first h follow.
    """
    members = materialize(
        turns.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("own"))
        .select(
            "conv_id",
            "own",
            (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"),
            (F.col("conv_id") - F.col("conv_id") % span).alias("base"),
        ),
        "members",
    )
    lengths = members.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    heads = members.join(lengths, "base", "left").select(
        "conv_id", "base", "h", F.least(F.col("h"), F.coalesce("there", F.lit(0))).alias("taken")
    )
    kept = turns.join(heads, "conv_id").where(F.col("at") > F.col("h"))
    kept = kept.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "d0", "d1", "chars")
    first = turns.where(F.col("at") < most).withColumnRenamed("conv_id", "base")
    taken = first.join(heads, "base").where(F.col("at") <= F.col("taken"))
    taken = taken.select("conv_id", F.col("at").alias("depth"), "d0", "d1", "chars")
    return members.select("conv_id"), kept.unionByName(taken)


def build(members: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, depth from 1, d0, d1, chars), from the root.

    ``members`` holds the conv_id of every conversation once, also of those without turns.
    Returns conv_id (the smallest member) and depth, which name a node; parent_conv_id;
    n_convs; n_children; n_leaves and saved_tokens of the subtree; ends_sha256 of the sorted
    ids of the members that end here.  Without members there is no node.
    """
    blocks = materialize(_blocks(turns), "blocks")
    nodes = materialize(_nodes(members, blocks), "nodes")
    chains = materialize(_chains(nodes), "chains")
    below = materialize(_below(chains), "below")
    ends = _end_digests(members, blocks)

    hung = below.groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved")
    )
    placed = (
        nodes.join(chains.select("conv_id", "top", "end", "parent"), "conv_id")
        .join(hung, ["conv_id", "depth"], "left")
        .withColumn("n_children", F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("end")).cast("long"))
    )
    leaf = (F.col("n_children") == 0).cast("long") + F.coalesce("hung_leaves", F.lit(0))
    saved = (F.col("n_convs") - 1) * F.col("chars") + F.coalesce("hung_saved", F.lit(0))
    summed = running(
        placed, "depth", [Running("n_leaves", leaf), Running("saved_tokens", saved)], within=["conv_id"], descending=True
    )
    return summed.join(ends, ["k0", "k1"], "left").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _keys(lanes: list[Column], depth: Column) -> list[Column]:
    """128 bits that stand for a beginning: the lanes summed up to its last turn, and its length."""
    return [F.xxhash64(F.lit(seed), *lanes, depth.cast("long")) for seed in (11, 12)]


def _blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: its turns in order, and the sums before it."""
    drawn = turns.select(
        "conv_id",
        F.expr(f"(depth - 1) div {BLOCK}").alias("block"),
        F.struct(
            F.col("depth").cast("long").alias("depth"),
            *[F.xxhash64(F.lit(seed), "depth", "d0", "d1").alias(f"x{seed}") for seed in (0, 1)],
            "chars",
        ).alias("turn"),
    )
    low, high = (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftrightunsigned(c, 32))
    lanes = [low("turn.x0"), high("turn.x0"), low("turn.x1"), high("turn.x1")]
    cut = drawn.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), *[F.sum(v).alias(s) for v, s in zip(lanes, _LANES, strict=True)]
    )
    sums = [Running(f"before_{s}", F.col(s), exclusive=True) for s in _LANES]
    return running(cut, "block", sums, within=["conv_id"])


def _nodes(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv_id, depth, n_convs, chars, k0, k1, above0, above1): the nodes and their keys."""
    depth = F.col("block") * BLOCK + F.size("turns")
    key = _keys([F.col(f"before_{s}") + F.col(s) for s in _LANES], depth)
    above = _keys([F.col(f"before_{s}") for s in _LANES], F.col("block") * BLOCK)
    keyed = blocks.select(
        "conv_id", "block", "turns", *[f"before_{s}" for s in _LANES],
        key[0].alias("k0"), key[1].alias("k1"), above[0].alias("above0"), above[1].alias("above1"),
    )
    # Groups by successive block keys; equal keys mean equal beginnings, so any member shows them.
    carried = ["turns", "above0", "above1", *[f"before_{s}" for s in _LANES]]
    groups = materialize(
        keyed.groupBy("k0", "k1").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*carried), "conv_id").alias("shown")
        ).select("conv_id", "n", "shown.*"),
        "groups",
    )
    siblings = groups.groupBy("above0", "above1").agg((F.count(F.lit(1)) > 1).alias("diverge"))
    spread = groups.join(siblings, ["above0", "above1"]).withColumn("turn", F.explode(_turn_keys()))
    cells = spread.select("diverge", "conv_id", "n", "turn.*")
    alone = cells.where(~F.col("diverge")).select("conv_id", "depth", F.col("n").alias("n_convs"), "chars", "k0", "k1", "above0", "above1")
    refined = cells.where("diverge").groupBy("k0", "k1", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), *[F.min(c).alias(c) for c in ("chars", "above0", "above1")]
    )
    nothing = _keys([F.lit(0).cast("long")] * 4, F.lit(0))
    root = (
        members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        .where("n_convs > 0")
        .select(
            "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars"),
            nothing[0].alias("k0"), nothing[1].alias("k1"), F.lit(None).cast("long").alias("above0"), F.lit(None).cast("long").alias("above1"),
        )
    )
    return alone.unionByName(refined).unionByName(root)


def _turn_keys() -> Column:
    """The turns of a block, each with its own key and the key before it."""
    parts = {
        "s0": lambda t: t["x0"].bitwiseAND(0xFFFFFFFF),
        "s1": lambda t: F.shiftrightunsigned(t["x0"], 32),
        "s2": lambda t: t["x1"].bitwiseAND(0xFFFFFFFF),
        "s3": lambda t: F.shiftrightunsigned(t["x1"], 32),
    }

    def added(part):
        return lambda total, turn: total + part(turn)

    def shown(turn: Column, k: Column) -> Column:
        def upto(n: Column) -> list[Column]:
            taken = F.slice("turns", 1, n)
            return [F.aggregate(taken, F.col(f"before_{s}"), added(part)) for s, part in parts.items()]

        here, there = _keys(upto(k + 1), turn["depth"]), _keys(upto(k), turn["depth"] - 1)
        return F.struct(
            turn["depth"].alias("depth"), turn["chars"].alias("chars"),
            here[0].alias("k0"), here[1].alias("k1"), there[0].alias("above0"), there[1].alias("above1"),
        )

    return F.transform("turns", shown)


def _chains(nodes: DataFrame) -> DataFrame:
    """(conv_id, top, end, saved, parent): the nodes of one smallest member, and whose chain holds
    the parent of the topmost one (null above the root)."""
    chains = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"),
        F.max("depth").alias("end"),
        F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.min_by(F.struct("above0", "above1"), "depth").alias("above"),
    )
    parents = nodes.select(F.col("k0").alias("above0"), F.col("k1").alias("above1"), F.col("conv_id").alias("parent"))
    return (
        chains.select("conv_id", "top", "end", "saved", "above.above0", "above.above1")
        .join(parents, ["above0", "above1"], "left")
        .select("conv_id", "top", "end", "saved", "parent")
    )


def _below(chains: DataFrame) -> DataFrame:
    """(conv_id, top, parent, leaves, saved) of every chain but the root's, all chains below added.

    Each round adds what hangs as many chains below as the rounds before have reached.
    """
    hung = chains.where("parent IS NOT NULL").select(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("end")).distinct()
    leafy = chains.join(hung.withColumn("inner", F.lit(True)), ["conv_id", "end"], "left")
    root = chains.where("parent IS NULL").select("conv_id").first()  # one row, none without members
    state = materialize(
        leafy.where("parent IS NOT NULL").select(
            "conv_id", "top", "parent", F.col("inner").isNull().cast("long").alias("leaves"), "saved",
            F.when(F.col("parent") != F.lit(root[0] if root else None), F.col("parent")).alias("to"),
        ),
        "below",
    )
    while state.where("to IS NOT NULL").limit(1).count():
        added = state.where("to IS NOT NULL").groupBy(F.col("to").alias("conv_id")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        further = state.select(F.col("conv_id").alias("to"), F.col("to").alias("beyond"))
        state = materialize(
            state.join(added, "conv_id", "left")
            .join(further, "to", "left")
            .select(
                "conv_id",
                "top",
                "parent",
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                F.col("beyond").alias("to"),
            ),
            "below",
        )
    return state.drop("to")


def _end_digests(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256): digest of the ids of the conversations that end at a node.

    A digest runs over its ids in order.  Tasks join runs of ids first, so one task per node
    reads only these pieces, one after another.
    """
    depth = F.col("block") * BLOCK + F.size("turns")
    key = _keys([F.col(f"before_{s}") + F.col(s) for s in _LANES], depth)
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct(key[0].alias("k0"), key[1].alias("k1")), "block").alias("key"))
    nothing = _keys([F.lit(0).cast("long")] * 4, F.lit(0))
    ended = members.join(last, "conv_id", "left").select(
        F.coalesce("key.k0", nothing[0]).alias("k0"), F.coalesce("key.k1", nothing[1]).alias("k1"), "conv_id"
    )
    ended = materialize(ended, "ends")
    prepare(members.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for k0, k1, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[:2] == (k0, k1) and held[4] < _PIECE:
                    held[3].append(str(conv))
                    held = (*held[:4], held[4] + len(held[3][-1]) + 1)
                else:
                    out += [held] if held else []
                    held = (k0, k1, conv, [str(conv)], len(str(conv)))
            yield _piece_batch(out)
            out = []
        yield _piece_batch([held] if held else [])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k0, k1, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == (k0, k1):
                    state.update(b"," + ids.encode())
                else:
                    done += [(*key, state.hexdigest())] if key else []
                    key, state = (k0, k1), hashlib.sha256(ids.encode())
            yield _digest_batch(done)
        yield _digest_batch([(*key, state.hexdigest())] if key else [])

    order = ["k0", "k1", "conv_id"]
    joined = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "k0 bigint, k1 bigint, start bigint, ids string")
    dealt = joined.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "start")
    return dealt.mapInArrow(digests, "k0 bigint, k1 bigint, ends_sha256 string")


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [[r[k] for r in rows] for k in range(3)] + [[",".join(r[3]) for r in rows]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k0", "k1", "start", "ids"])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [[r[k] for r in rows] for k in range(3)]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k0", "k1", "ends_sha256"])
