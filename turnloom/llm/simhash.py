"""SimHash near-duplicates through vantage-point trees.

Fingerprints: XXH64 (seed 42) of every word shingle, repeats included; a bit is 1 if more than half of the
hashes have it. More than one 64-bit lane can be asked for; further lanes mix the same hashes again.

Trees: a fingerprint's bits are dealt to `blocks` blocks. Two fingerprints within the radius are within radius // blocks in at
least one block, so each block has a tree of its own with that smaller radius. Each level of a tree has a vantage point and
parts fingerprints by their Hamming distance to it, in the block's bits: near up to the cut, far beyond it. By the
triangle inequality two fingerprints within the block's radius differ by no more than it in that distance, so a branch
that lies further off is pruned; a near one within the radius of the boundary goes to the far shard as well. Every
pair meets in a shard of some tree. As all nodes of a level share its vantage point, a tree is one short list however
many shards it has: levels are added until a shard is small for the number of fingerprints. Vantage points and cuts are
chosen on a bounded sample; every fingerprint is routed.

Shards: rows within the radius of a vantage point of the shard are tied to it at once; of the other pairs those are compared
that differ by no more than the radius in their distance to a vantage point. Only connections matter, so rows already tied are
not compared. A shard of too many rows is parted: its rows are tied to a few centres, what is tied to the centre with
the most rows needs no comparison among itself, and the rest meets all rows of the shard, block by block.

Where the radius is a fifth of the bits no bound prunes: random fingerprints differ by less in their distance to any
vantage point. Then shards come from the texts (`anchors`): each text is dealt to as many shards as asked, each named by two
min-hashes of its shingles, and within a shard all is as above. Two texts whose shingles overlap by J miss each other
with a probability of (1 - J * J) ** anchors: 16 anchors, J 0.8: 8e-8, 2/3: 8e-5.

Equal fingerprints are one node from the start, and a shard ties each group it finds to one of its rows, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop
from .components import components

SHINGLE = 4
RADIUS = 4
BLOCKS = 3
#: Fingerprints that vantage points are chosen on: about this many, twice as many at most, and no more than this share of all.
SAMPLE_ROWS, SAMPLE_SHARE = 16_384, 0.25
#: Rows of a shard that a tree aims at; levels at most (a shard's name has as many bits); vantage points tried for a level.
LEAF_ROWS, LEVELS, VANTAGES = 2048, 48, 6
#: A level is added if its larger half has at most this share of the rows.
WORTH = 0.9
#: Shards above this many rows are parted by centres and blocks of this many rows.
SHARD_ROWS = 8192
#: Rows that one group of small shards holds, on average.
BIN_ROWS = 40_000
#: Rows that tie others in a shard; rows of the tiles in which the others are compared.
CENTRES, TILE = 8, 32
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SEED = 7


# --- fingerprints -----------------------------------------------------------------------------------------

def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words (A-Z lower-cased), or of all words if there are fewer."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Other hashes of the same shingles."""
    with np.errstate(over="ignore"):
        h = hashes + np.uint64(_MIX[0] * salt % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[1])
        h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[2])
        return h ^ (h >> np.uint64(31))


def majorities(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The fingerprint's lanes, as unsigned 64-bit numbers; no hashes: zeros."""
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 255):  # up to 255 rows are added in bytes
        part = hashes[at : at + 255]
        each = np.stack([part, *(_mixed(part, lane) for lane in range(1, lanes))], 1) if lanes > 1 else part[:, None]
        bits = np.unpackbits(np.ascontiguousarray(each, dtype="<u8").view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int = SHINGLE, lanes: int = 1) -> list[int]:
    """One unsigned 64-bit number for each lane; texts without words: zeros."""
    return majorities(shingle_hashes(text, words), lanes).tolist()


def anchor_names(hashes: np.ndarray, anchors: int) -> np.ndarray:
    """Names of the shards of a text: each a hash of two min-hashes of its shingles; a text without any has one, zero."""
    if not len(hashes):
        return np.zeros(1, np.int64)
    salts = (np.arange(1000, 1000 + 2 * anchors, dtype=np.uint64) * np.uint64(_MIX[0])) | np.uint64(1)
    least = np.full(2 * anchors, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            h = hashes[at : at + 4096, None] * salts[None, :]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[1])
            least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0))
        names = _mixed(least[:anchors], 5) + _mixed(least[anchors:], 9) + salts[:anchors]
    return np.unique(names).view(np.int64)


def fingerprints(text: Column, words: int = SHINGLE, lanes: int = 1, anchors: int = 0) -> Column:
    """struct<fp array<bigint>, anchors array<bigint>>: the lanes, as signed longs, and the names of the text's shards."""

    def batch(texts: pd.Series) -> pd.DataFrame:
        fps, names = [], []
        for x in texts:
            hashes = shingle_hashes(x, words)
            fps.append(majorities(hashes, lanes).view(np.int64))
            names.append(anchor_names(hashes, anchors) if anchors else np.empty(0, np.int64))
        return pd.DataFrame({"fp": pd.Series(fps, dtype=object), "anchors": pd.Series(names, dtype=object)})

    bound_batches()
    return F.pandas_udf(batch, "fp array<bigint>, anchors array<bigint>")(text)


# --- distances and shards ---------------------------------------------------------------------------------

def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x: lanes x rows, y: lanes x rows or one row's lanes."""
    return np.bitwise_count(x ^ (y if y.ndim == 2 else y[:, None])).sum(axis=0, dtype=np.int32)


def _within(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of x and y (lanes x rows) are within radius. Half of the lanes decide on most pairs."""
    half = (len(x) + 1) // 2
    far = np.zeros((x.shape[1], y.shape[1]), np.uint8 if half * 64 < 256 else np.uint16)
    bits = np.empty(far.shape, np.uint64)
    for a, b in zip(x[:half], y[:half], strict=True):
        far += np.bitwise_count(np.bitwise_xor(a[:, None], b[None, :], out=bits))
    i, j = np.divmod(np.flatnonzero(far.ravel() <= radius), max(y.shape[1], 1))
    if half == len(x):
        return i, j
    close = far[i, j] + _distances(x[half:, i], y[half:, j]) <= radius
    return i[close], j[close]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a and b in label, which holds the smallest row of each row's group."""
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        low = np.minimum(left, right)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while not np.array_equal(up := label[label], label):
            label[:] = up


def tie(marks: np.ndarray, radius: int) -> np.ndarray:
    """For each column of marks (lanes x rows) the smallest row that it is connected with by distances within radius."""
    n = marks.shape[1]
    label, loose = np.arange(n), np.arange(n)
    if n < 2:
        return label
    for _ in range(CENTRES):  # rows within the radius of a vantage point
        close = _distances(marks[:, loose], marks[:, loose[0]]) <= radius
        label[loose[close]] = loose[0]
        tied, loose = int(close.sum()), loose[~close]
        if not len(loose) or tied * CENTRES < len(loose):
            break
    big = int(np.bincount(label).argmax())
    if (label == big).all():
        return label
    from_vantage = _distances(marks, marks[:, big])
    order = np.argsort(from_vantage, kind="stable")
    d, rest = from_vantage[order], label[order] != big
    asking = np.flatnonzero(rest)
    for at in range(0, len(asking), TILE):
        ask = asking[at : at + TILE]
        lo, hi = np.searchsorted(d, (d[ask[0]] - radius, d[ask[-1]] + radius + 1))
        there = np.arange(lo, hi)
        there = there[~rest[lo:hi] | (there >= ask[0])]  # pairs of two that ask are compared once
        i, j = _within(marks[:, order[ask]], marks[:, order[there]], radius)
        _merge(label, order[ask[i]], order[there[j]])
    return label


# --- trees ------------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """A tree over one block of bits: vantage point and cut of each level."""

    masks: np.ndarray
    radius: int
    vantage: list[np.ndarray]
    cuts: list[int]

    def route(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, shards) of lanes x rows: every shard that the ball around a row may hold a partner in."""
        own, rows = marks & self.masks[:, None], np.arange(marks.shape[1])
        shards = np.zeros(len(rows), np.int64)
        for v, at in zip(self.vantage, self.cuts, strict=True):
            d = _distances(own, v)[rows]
            near, far = d <= at, d > at - self.radius
            rows = np.concatenate([rows[near], rows[far]])
            shards = np.concatenate([shards[near] << 1, shards[far] << 1 | 1])
        return rows, shards


def grow(sample: np.ndarray, masks: np.ndarray, radius: int, count: int, leaf_rows: int, seed: int) -> Tree:
    """A tree for `count` fingerprints, on a sample of them (lanes x rows)."""
    rng, own = np.random.default_rng((_SEED, seed)), sample & masks[:, None]
    tree, n, width = Tree(masks, radius, [], []), sample.shape[1], int(np.bitwise_count(masks).sum())
    rows, shards, size = np.arange(n), np.zeros(n, np.int64), float(count)
    while n and size > leaf_rows and len(tree.cuts) < LEVELS:
        best = None
        for v in own[:, rng.choice(n, VANTAGES)].T:
            d = _distances(own, v)
            upto = np.cumsum(np.bincount(d, minlength=width + 1)).astype(float)
            behind = np.concatenate((np.zeros(radius), upto))[: width + 1]  # rows that go to the near shard alone
            at = int((upto**2 + (n - behind) ** 2).argmin())
            near, far = d <= at, d > at - radius
            cost = sum(float((np.unique(shards[part[rows]], return_counts=True)[1].astype(float) ** 2).sum()) for part in (near, far))
            if best is None or cost < best[0]:
                best = (cost, v, at, near, far)
        _, v, at, near, far = best
        share = max(near.sum(), far.sum()) / n
        if share > WORTH:
            break
        tree.vantage.append(v)
        tree.cuts.append(at)
        rows, shards = np.concatenate([rows[near[rows]], rows[far[rows]]]), np.concatenate([shards[near[rows]] << 1, shards[far[rows]] << 1 | 1])
        if len(rows) > 8 * SAMPLE_ROWS:  # the choice needs no more than some of them
            some = rng.choice(len(rows), SAMPLE_ROWS, replace=False)
            rows, shards = rows[some], shards[some]
        size *= share
    return tree


def block_masks(lanes: int, blocks: int) -> list[np.ndarray]:
    """For each block its bits in each lane: 64 * lanes bits dealt as evenly as they go."""
    edges, out = [64 * lanes * i // blocks for i in range(blocks + 1)], []
    for lo, hi in zip(edges, edges[1:], strict=False):
        masks = [0] * lanes
        for bit in range(lo, hi):
            masks[bit // 64] |= 1 << bit % 64
        out.append(np.array(masks, np.uint64))
    return out


def _matrix(fps: pd.Series, lanes: int) -> np.ndarray:
    """lanes x rows of unsigned numbers."""
    if not len(fps):
        return np.empty((lanes, 0), np.uint64)
    return np.ascontiguousarray(np.stack(fps.to_numpy()).astype(np.int64, copy=False).view(np.uint64).T)


def tree_shards(nodes: DataFrame, lanes: int, radius: int, blocks: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(shard, node, fp): every fingerprint of nodes(node, fp) in all shards, of every block's tree, that may hold a partner."""
    count, sample = nodes.count(), np.empty((lanes, 0), np.uint64)
    if count > leaf_rows:
        share = min(SAMPLE_SHARE, SAMPLE_ROWS / count)
        picked = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").limit(2 * SAMPLE_ROWS).collect()
        sample = np.array(sorted(r["fp"] for r in picked), np.int64).reshape(-1, lanes).view(np.uint64).T
    trees = [grow(sample, masks, radius // blocks, count, leaf_rows, b) for b, masks in enumerate(block_masks(lanes, blocks))]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks, node, fp = _matrix(batch["fp"], lanes), batch["node"].to_numpy(np.int64), batch["fp"].to_numpy()
            for b, tree in enumerate(trees):
                rows, shards = tree.route(marks)
                yield pd.DataFrame({"shard": shards + (b << LEVELS + 1), "node": node[rows], "fp": fp[rows]})

    bound_batches()
    return nodes.select("node", "fp").mapInPandas(deal, "shard long, node long, fp array<bigint>")


# --- links ------------------------------------------------------------------------------------------------

def _parted(hot: DataFrame, lanes: int, radius: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Edges to the centres of large shards, and (shard, i, j, node, fp): rows that still have to be compared, in blocks.

    hot: shard, node, fp and n, the rows of the shard.
    """
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "fp")).alias(f"c{k}") for k in range(CENTRES)]
    centres = cut(hot.groupBy("shard").agg(*picks).select("shard", F.array(*[f"c{k}" for k in range(CENTRES)]).alias("centres")))

    def near(c: Column) -> Column:
        return sum((F.bit_count(F.get("fp", F.lit(lane)).bitwiseXOR(F.get(c["fp"], F.lit(lane)))) for lane in range(lanes)), F.lit(0)) <= radius

    kind = F.array_position(F.transform("centres", near), F.lit(True)).cast("int")  # 0: none is near
    told = cut(hot.join(centres, "shard").withColumn("kind", kind).withColumn("centre", F.get("centres.node", F.col("kind") - 1)).drop("centres"))
    main = told.where("kind > 0").groupBy("shard", "kind").agg(F.count("*").alias("m")).groupBy("shard").agg(F.max(F.struct("m", "kind")).alias("main"))
    parts = told.groupBy("shard").agg(F.max("n").alias("n_all")).join(main, "shard", "left")
    rest = F.greatest(F.col("n_all") - F.coalesce("main.m", F.lit(0)), F.lit(1))
    blocks = lambda n: F.ceil(n / shard_rows).cast("int")
    parts = cut(parts.select("shard", F.coalesce("main.kind", F.lit(-1)).alias("main"), blocks(F.col("n_all")).alias("n_j"), blocks(rest).alias("n_i")))
    rows = told.join(parts, "shard")
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit(99)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = rows.withColumn("j", dealt("n_j")).withColumn("i", every("n_i"))
    asking = rows.where("kind <> main").withColumn("i", dealt("n_i")).withColumn("j", every("n_j"))
    names = ["shard", "i", "j", "node", "fp"]
    return told.where("kind > 0").select(F.col("centre").alias("a"), F.col("node").alias("b")), shown.select(names).unionByName(asking.select(names))


def linked(shards: DataFrame, lanes: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) that connect all rows of a shard linked by distances within radius; shards(shard, node, fp) read from files."""
    total = shards.count()
    large = cut(shards.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows))
    some = not large.isEmpty()
    small = shards.join(large, "shard", "left_anti") if some else shards
    cells, ties = small.select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "fp"), None
    if some:
        ties, parted = _parted(shards.join(large, "shard"), lanes, radius, shard_rows)
        cells = cells.unionByName(parted)
    cells = cells.withColumn("bin", F.pmod(F.xxhash64("shard", "i", "j"), F.lit(max(64, -(-total // BIN_ROWS)))))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[["shard", "i", "j"]].to_numpy(np.int64)
        order = np.lexsort((pdf["node"].to_numpy(np.int64), *keys.T[::-1]))
        keys, nodes = keys[order], pdf["node"].to_numpy(np.int64)[order]
        edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        marks, out = _matrix(pdf["fp"].iloc[order], lanes), []
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(nodes)], strict=True):
            if hi - lo > 1:
                label = tie(np.ascontiguousarray(marks[:, lo:hi]), radius)
                tied = np.flatnonzero(label != np.arange(hi - lo))
                out.append(np.stack([nodes[lo + label[tied]], nodes[lo + tied]], 1))
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 2), np.int64), columns=["a", "b"])

    found = cells.groupBy("bin").applyInPandas(search, "a long, b long")
    return (found if ties is None else found.unionByName(ties)).where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS,
    lanes: int = 1, anchors: int = 0, leaf_rows: int = LEAF_ROWS, shard_rows: int = SHARD_ROWS, row: Column | None = None,
) -> DataFrame:
    """(id, fp, component, group, row) for each row of docs; component: the smallest id linked, directly or by others; group: a
    number of the rows linked; row: what was given for it, null without.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay repeated, and rows that repeat an id
    are linked by their texts alone. Ids are whole numbers; a row with a null id has the smallest id of its group, null if
    there is none. Nothing is read but id and text, so other columns may have any name. An empty table gives an empty table.
    """
    made = docs.select(F.col(id_col).cast("long").alias("id"), fingerprints(F.col(text_col), words, lanes, anchors).alias("f"), (F.lit(None).cast("long") if row is None else row).alias("row"))
    marked = cut(made.select("id", "f.fp", "f.anchors", "row"))
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    if anchors:
        texts = marked.select("fp", "anchors").distinct().select("fp", F.explode("anchors").alias("shard")).distinct()
        dealt = texts.join(nodes.select("fp", "node"), "fp").select("shard", "node", "fp")
    else:
        dealt = tree_shards(nodes, lanes, radius, blocks, leaf_rows)
    shards = cut(dealt)
    edges = cut(linked(shards, lanes, radius, shard_rows))
    drop(shards)
    groups = components(edges)
    drop(edges)
    named = cut(nodes.join(groups, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("group")))
    least = cut(named.groupBy("group").agg(F.min("least").alias("component")))
    told = cut(named.join(least, "group").select("fp", "group", "component"))  # from files, so that a group of many is split
    return marked.join(told, "fp").select("id", "fp", "component", "group", "row")
