"""Membership bit arrays, and subtree filters over a parent table.

Bit k of a bit array is bit k % 32 of its integer k div 32; integers that are not there
hold zeros.  A taxonomy is a table of nodes and parents.  Numbering it once gives every node an
interval that holds the numbers of all nodes below it, so "below a taxon" becomes a range
test on one column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.plans.ordered import Running, dense_positions, running
from recordmill.session import materialize

WORD_BITS = 32


def member(bits: Column | str, k: int | Column) -> Column:
    """Whether bit ``k`` is set; false for a null array."""
    k = F.lit(k) if isinstance(k, int) else k
    word = F.coalesce(F.get(bits, F.floor(k / WORD_BITS).cast("int")), F.lit(0)).cast("long")
    return F.getbit(word, (k % WORD_BITS).cast("int")) == 1


def members_all(bits: Column | str, ks: Sequence[int]) -> Column:
    out = F.lit(True)
    for k in ks:
        out = out & member(bits, k)
    return out


def members_any(bits: Column | str, ks: Sequence[int]) -> Column:
    out = F.lit(False)
    for k in ks:
        out = out | member(bits, k)
    return out


def bit_array(ks: Column, words: int) -> Column:
    """Array of ``words`` integers with the bits of the integer array ``ks`` set."""
    per_word = [
        F.aggregate(
            _of_word(ks, w),
            F.lit(0).cast("long"),
            lambda total, k: total.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (k % WORD_BITS).cast("int"))),
        )
        for w in range(words)
    ]
    return F.array(*per_word)


def _of_word(ks: Column, word: int) -> Column:
    return F.filter(ks, lambda k: F.floor(k / WORD_BITS) == word)


def union_members(records: DataFrame, key: str, bits: str) -> DataFrame:
    """(key, bits): per key all bits that one of its records has, combined map-side word by word."""
    words = records.select(F.col(key).alias("key"), F.posexplode_outer(bits).alias("word", "value"))
    merged = words.groupBy("key", "word").agg(F.bit_or("value").alias("value"))
    cells = F.filter(F.collect_list(F.struct("word", "value")), lambda c: c["word"].isNotNull())
    # One row per key and word; a word none of a key's records has counts as zero.
    grouped = merged.groupBy("key").agg(F.map_from_entries(cells).alias("words"), F.coalesce(F.max("word"), F.lit(-1)).alias("last"))
    filled = F.transform(
        F.when(F.col("last") >= 0, F.sequence(F.lit(0), F.col("last"))).otherwise(F.array().cast("array<int>")),
        lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0).cast("long")),
    )
    return grouped.select("key", filled.alias("bits"))


def member_counts(records: DataFrame, bits: str) -> DataFrame:
    """(k, records): number of records with bit k, for every bit that some record has."""
    words = records.select(F.posexplode(bits).alias("word", "value")).groupBy("word", "value").count()
    ks = words.select("count", "word", "value", F.explode(F.sequence(F.lit(0), F.lit(WORD_BITS - 1))).alias("bit"))
    set_ = ks.where(F.getbit(F.col("value").cast("long"), F.col("bit")) == 1)
    return set_.groupBy((F.col("word") * WORD_BITS + F.col("bit")).alias("k")).agg(F.sum("count").alias("records"))


# --- taxonomy ---


def number_taxa(parents: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, low, high): the nodes below a node, itself included, have low <= their low < high.

    A root has a null parent, itself, or one that is no node.  Nodes are unique.  Sizes of
    subtrees are summed, and places summed down from the root, by pointer doubling: the rounds
    grow with the logarithm of the depth.  A circle of parents is an error.
    """
    rows = parents.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    known = rows.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    tree = rows.join(known, "parent", "left").select(
        "node", F.when(F.col("known") & (F.col("node") != F.col("parent")), F.col("parent")).alias("parent")
    )
    tree = materialize(tree, "taxa")
    rounds = max(1, tree.count()).bit_length() + 1

    state = materialize(tree.select("node", F.col("parent").alias("to"), F.lit(1).cast("long").alias("size")), "sizes")
    for _ in range(rounds):
        if not state.where("to IS NOT NULL").limit(1).count():
            break
        added = state.where("to IS NOT NULL").groupBy(F.col("to").alias("node")).agg(F.sum("size").alias("more"))
        state = materialize(
            _leap(state.join(added, "node", "left").select("node", "to", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), state),
            "sizes",
        )
    else:
        raise ValueError("the parents of some nodes go round in a circle")

    # A node stands behind its parent and the subtrees of its smaller siblings.
    placed = dense_positions(tree.join(state.select("node", "size"), "node"), ["node"], "at")
    siblings = placed.withColumn("of", F.coalesce(F.col("parent").cast("string"), F.lit("")))
    before = running(siblings, "at", [Running("before", F.col("size"), exclusive=True)], within=["of"])
    step = F.col("before") + F.col("parent").isNotNull().cast("long")
    state = materialize(before.select("node", "size", F.col("parent").alias("to"), step.alias("low")), "places")
    while state.where("to IS NOT NULL").limit(1).count():
        above = state.select(F.col("node").alias("to"), F.col("low").alias("more"), F.col("to").alias("beyond"))
        state = materialize(
            state.join(above, "to", "left").select(
                "node", "size", F.col("beyond").alias("to"), (F.col("low") + F.coalesce("more", F.lit(0))).alias("low")
            ),
            "places",
        )
    return state.select("node", "low", (F.col("low") + F.col("size")).alias("high"))


def _leap(moved: DataFrame, state: DataFrame) -> DataFrame:
    further = state.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
    rest = [c for c in moved.columns if c != "to"]
    return moved.join(further, "to", "left").select(*rest, F.col("beyond").alias("to"))


def below(records: DataFrame, taxon_column: str, numbered: DataFrame, taxa: Sequence) -> DataFrame:
    """The records whose taxon is one of ``taxa`` or below one of them; unknown taxa hold none."""
    bounds = numbered.where(F.col("node").isin(list(taxa))).select("low", "high").collect()  # a row for each asked taxon
    inside = F.lit(False)
    for low, high in bounds:
        inside = inside | F.col("low").between(low, high - 1)
    wanted = numbered.where(inside).select(F.col("node").alias(taxon_column))
    return records.join(wanted, taxon_column, "left_semi")


def below_by_defline(records: DataFrame, id_column: str, deflines: str, numbered: DataFrame, taxa: Sequence, k: int) -> DataFrame:
    """Records with a defline (struct with taxid and memberships) below ``taxa`` that is in membership ``k``."""
    lines = records.select(F.col(id_column).alias("__id"), F.explode(F.filter(deflines, lambda d: member(d["memberships"], k))).alias("__d"))
    found = below(lines.select("__id", F.col("__d.taxid").alias("taxid")), "taxid", numbered, taxa)
    return records.join(found.select(F.col("__id").alias(id_column)).distinct(), id_column, "left_semi")
