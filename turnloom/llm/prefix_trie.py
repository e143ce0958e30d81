"""Prefix trie of conversations, built level by level.

At each depth the live conversations are grouped by (parent node, next turn), and the smallest conv_id names the new node; then leaves and
savings are rolled up by joins from the deepest level to the root. Conversations that are wholly alike are one class with a weight, and a node with
one class is the top of a chain, so levels end where the last two different conversations part, not where the longest one ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop

#: Ids that one row of an intermediate list of ids holds.
LIST_IDS = 1024
NOBODY = hashlib.sha256(b"").hexdigest()
TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PLACE = (1 << 33) - 1
_KIND = ["s1", "s2", "length", "total"]


def ranked(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (1, 2, ... by turn), key (SHA-256 of role and text), size (code points of the text), upto (their sum up to here).

    A null turn comes first; turns of equal number go by role, then text; null roles and texts are empty. Rows without conv_id belong to no
    conversation. Repeated rows are turns of their own. The order is a range sort of all rows, so a long conversation lies in many tasks; each
    task's part of a conversation gets its start from one row of sums a task. The table is written to the scratch folder.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]  # row: rows alike in all else need not share a task
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.select(
        "conv_id", key.alias("key"), F.length("text").cast("long").alias("size"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("place"),
    ))
    parts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    earlier = Window.partitionBy("conv_id").orderBy("part")  # a row for each task that holds turns of it
    parts = parts.select("conv_id", "part", (F.sum("n").over(earlier) - F.col("n")).alias("n0"), (F.sum("all").over(earlier) - F.col("all")).alias("all0"))
    inside = Window.partitionBy("conv_id", "part").orderBy("place")
    out = placed.join(parts, ["conv_id", "part"]).select(
        "conv_id", (F.col("n0") + F.row_number().over(inside)).cast("long").alias("pos"), "key", "size", (F.col("all0") + F.sum("size").over(inside)).alias("upto")
    )
    done = cut(out)
    drop(placed)
    return done


def shared_heads(turns: DataFrame, ids: DataFrame, head: Column, lender: Column, most: int) -> DataFrame:
    """Ranked turns of conversations that begin with another's first turns: the first `head` of conversation `lender` (all if it has fewer,
    none if there is none), then their own after their first `head`. head (0 to most) and lender are expressions over conv_id; ids: all conv_id."""
    reach = [F.coalesce(F.max(F.when(F.col("pos") <= k, F.col("upto"))), F.lit(0)).alias(f"u{k}") for k in range(1, most + 1)]
    facts = ids.join(turns.groupBy("conv_id").agg(F.max("pos").alias("n"), *reach), "conv_id", "left").na.fill(0)
    plan = facts.withColumn("head", head).withColumn("lender", lender)
    lend = facts.select(F.col("conv_id").alias("lender"), F.col("n").alias("n_lent"), F.array(F.lit(0), *[f"u{k}" for k in range(1, most + 1)]).alias("lent"))
    plan = plan.join(lend, "lender", "left")
    none = F.lit(0).cast("long")
    plan = plan.select(
        "conv_id", "lender", "head", F.least("head", F.coalesce("n_lent", none)).alias("begun"),
        F.coalesce(F.get("lent", F.col("head").cast("int")), none).alias("begun_upto"),
        F.get(F.array(F.lit(0), *[f"u{k}" for k in range(1, most + 1)]), F.col("head").cast("int")).alias("own_upto"),
    )
    rest = turns.join(plan, "conv_id").where(F.col("pos") > F.col("head"))
    rest = rest.select("conv_id", (F.col("begun") + F.col("pos") - F.col("head")).alias("pos"), "key", "size", (F.col("begun_upto") + F.col("upto") - F.col("own_upto")).alias("upto"))
    first = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "lender")
    start = plan.select("conv_id", "lender", "head").join(first, "lender").where(F.col("pos") <= F.col("head")).select("conv_id", "pos", "key", "size", "upto")
    return start.unionByName(rest)


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (class, conv_id) rows to rows of at most LIST_IDS ids of one class, comma-joined; lists may end with a batch."""
    for batch in batches:
        at, out = None, []
        for *kind, conv_id in batch.itertuples(index=False, name=None):
            if kind != at or len(out[-1][-1]) == LIST_IDS:
                at = kind
                out.append((*kind, conv_id, []))
            out[-1][-1].append(str(conv_id))
        yield pd.DataFrame([(*x[:-1], len(x[-1]), ",".join(x[-1])) for x in out], columns=[*_KIND, "conv_id", "n", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted lists of each class to one row with the digest of all its ids; only a running digest is held."""
    at, first, n, digest = None, 0, 0, None

    def row() -> pd.DataFrame:
        return pd.DataFrame([(first, n, at[2], at[3], digest.hexdigest())], columns=["rep", "weight", "length", "total", "ends"])

    for batch in batches:
        done = []
        for s1, s2, length, total, conv_id, some, ids in batch.itertuples(index=False, name=None):
            if (s1, s2, length, total) != at:
                if at is not None:
                    done.append(row())
                at, first, n, digest = (s1, s2, length, total), conv_id, some, hashlib.sha256(ids.encode())
            else:
                n += some
                digest.update(b"," + ids.encode())
        if done:
            yield pd.concat(done)
    if at is not None:
        yield row()


def classes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """rep (smallest conv_id), weight, length, total (code points), ends (digest of the sorted ids) for each distinct conversation.

    Conversations are known as equal by two 64-bit sums over hashes of their (pos, key), their length and size, so no conversation is gathered.
    Ids are range-sorted over all tasks and joined to lists there; the task of a class reads a row for each list and keeps a running digest.
    """
    bound_batches()

    def total(k: int) -> Column:
        return F.sum(F.xxhash64(F.lit(k), "pos", "key").cast("decimal(20,0)")).cast("string").alias(f"s{k}")

    signs = turns.groupBy("conv_id").agg(total(1), total(2), F.max("pos").alias("length"), F.max("upto").alias("total"))
    signs = ids.join(signs, "conv_id", "left").na.fill({"s1": "", "s2": "", "length": 0, "total": 0}).select(*_KIND, "conv_id")
    order = [*_KIND, "conv_id"]
    kind = "s1 string, s2 string, length long, total long, conv_id long, n long, ids string"
    lists = signs.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_lists, kind)
    lists = lists.repartition(*_KIND).sortWithinPartitions(*order)
    return lists.mapInPandas(_digests, "rep long, weight long, length long, total long, ends string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the trie over ranked turns (see ranked) and all conversation ids, those without turns included: columns of TRIE.

    A level costs a join of its live classes with the turns at its depth, read from a table sorted by pos, a grouping, and on the way back a
    join with its children. There are as many levels as turns that two different conversations share at their start, and one. No ids: no nodes.
    """
    spark = turns.sparkSession
    kinds = cut(classes(turns, ids))
    top = kinds.agg(F.min("rep").alias("node"), F.sum("weight").alias("members"), F.count(F.lit(1)).alias("kinds"), F.max(F.when(F.col("length") == 0, F.col("rep"))).alias("ender")).first()
    if not top["kinds"]:
        return spark.createDataFrame([], TRIE)
    own = turns.join(kinds.select(F.col("rep").alias("conv_id"), "weight", "length", "total"), "conv_id").withColumnRenamed("conv_id", "rep")
    own = cut(own.repartitionByRange("pos", "rep").sortWithinPartitions("pos", "rep"))

    level, depth, levels = kinds.select("rep", F.lit(top["node"]).alias("node"), F.lit(top["kinds"]).alias("kinds"), "length"), 0, []
    deeper = top["kinds"] > 1
    while deeper:
        depth += 1
        live = level.where((F.col("kinds") > 1) & (F.col("length") >= depth)).select("rep", F.col("node").alias("parent"))
        turn = live.join(own.where(F.col("pos") == depth).drop("pos"), "rep")
        groups = turn.groupBy("parent", "key").agg(
            F.min("rep").alias("node"), F.sum("weight").alias("members"), F.count(F.lit(1)).alias("kinds"),
            F.max(F.when(F.col("length") == depth, F.col("rep"))).alias("ender"),
        )
        level = cut(turn.join(groups, ["parent", "key"]).withColumn("depth", F.lit(depth).cast("long")).drop("key"))
        levels.append(level)
        deeper = bool(level.agg(F.max((F.col("kinds") > 1) & (F.col("length") > depth))).first()[0])

    columns = ["node", "depth", "parent", "members", "kinds", "ender", "n_children", "n_leaves", "saved"]
    done, kids = [], None
    for level in reversed(levels):
        nodes = level.where(F.col("rep") == F.col("node"))
        alone = F.col("kinds") == 1  # the top of a chain: all below has one class
        if kids is None:
            nodes = nodes.select("*", *[F.lit(None).cast("long").alias(c) for c in ("k_n", "k_leaves", "k_saved")])
        else:
            nodes = nodes.join(kids, nodes["node"] == kids["k_parent"], "left").drop("k_parent")
        spared = F.when(alone, F.col("total") - F.col("upto") + F.col("size")).otherwise(F.col("size")) * (F.col("members") - 1)
        done.append(cut(nodes.select(
            "node", "depth", "parent", "members", "kinds", "ender",
            F.when(alone, (F.col("length") > F.col("depth")).cast("long")).otherwise(F.coalesce("k_n", F.lit(0))).alias("n_children"),
            F.when(alone, F.lit(1)).otherwise(F.coalesce("k_leaves", F.lit(1))).cast("long").alias("n_leaves"),
            (spared + F.coalesce("k_saved", F.lit(0))).alias("saved"),
        )))
        kids = done[-1].groupBy(F.col("parent").alias("k_parent")).agg(F.count(F.lit(1)).alias("k_n"), F.sum("n_leaves").alias("k_leaves"), F.sum("saved").alias("k_saved"))
    for level in levels:
        drop(level)

    if kids is None:  # one class: the root is the top of a chain
        root = kinds.select(F.lit(0).alias("k_n"), F.lit(1).alias("k_leaves"), (F.col("total") * (F.col("weight") - 1)).alias("k_saved"), F.least(F.col("length"), F.lit(1)).alias("k_n1"))
        root = root.select(F.col("k_n1").alias("k_n"), "k_leaves", "k_saved")
    else:
        root = kids.select("k_n", "k_leaves", "k_saved")
    root = root.select(
        F.lit(top["node"]).alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(top["members"]).alias("members"),
        F.lit(top["kinds"]).alias("kinds"), F.lit(top["ender"]).cast("long").alias("ender"), F.col("k_n").alias("n_children"), F.col("k_leaves").alias("n_leaves"), F.col("k_saved").alias("saved"),
    )
    nodes = root
    if done:
        nodes = nodes.unionByName(spark.read.schema(done[0].schema).parquet(*[x.scratch_path for x in done]))
    tops = nodes.where(F.col("kinds") == 1).select(F.col("node").alias("rep"), F.col("depth").alias("from"))
    chain = own.join(tops, "rep").where(F.col("pos") > F.col("from"))
    end = F.col("pos") == F.col("length")
    chain = chain.select(
        F.col("rep").alias("node"), F.col("pos").alias("depth"), F.col("rep").alias("parent"), F.col("weight").alias("members"), F.lit(1).cast("long").alias("kinds"),
        F.when(end, F.col("rep")).alias("ender"), (~end).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("total") - F.col("upto") + F.col("size")) * (F.col("weight") - 1)).alias("saved"),
    )
    out = nodes.select(*columns).unionByName(chain).join(kinds.select(F.col("rep").alias("ender"), "ends"), "ender", "left")
    names = {"node": "conv_id", "depth": "depth", "parent": "parent_conv_id", "members": "n_convs", "n_children": "n_children", "n_leaves": "n_leaves", "saved": "saved_tokens"}
    return out.select(*[F.col(c).cast("long").alias(n) for c, n in names.items()], F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of a table of turns as it is; columns: see ranked. Other columns of the table, whatever their names, are not read."""
    turns = ranked(conversations, **columns)
    return trie(turns, turns.select("conv_id").distinct())
