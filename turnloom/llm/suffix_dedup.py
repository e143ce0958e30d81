"""Exact removal of repeated byte strings by a sparse suffix array in deep-shallow order.

A string of `length` bytes that occurs twice has the same minimizer both times: the place, among its windows of
GRAM bytes, with the least hash. So only suffixes that start at minimizers need an order, about one byte in 85.
They are dealt to tasks by their first GRAM bytes; suffixes whose gram occurs once are dropped on the way. Places of one text
that follow each other at one distance with the same gram, as in periodic text, travel as one run, and those
with the same bytes around them as one suffix.

Shallow: a multikey quicksort, eight bytes to a key, orders a task's suffixes by their first GRAM bytes. Deep: each
group that still ties goes into a blind trie, which compares a suffix once, with one leaf, and keeps only the
depths where suffixes branch. Two suffixes of a group share a string of `length` bytes at an offset if what they share to
the left reaches the offset and what they share to the right reaches the string's end. So every node of the trie,
with its depth and the longest left match of each suffix among the node's others, says which strings are repeated.

A gram of very many places is not one task's: its suffixes are first reduced to distinct surroundings by a partial aggregate.
Where those are still many, each string of `length` bytes around the gram is named by a 128-bit hash, and names that
two surroundings have are found by another partial aggregate.

Positions are named by a 96-bit hash of the whole text, not by document: copies of a text are one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop

LENGTH = 200
#: Bytes that the hash of a minimizer covers; strings of LENGTH have LENGTH - GRAM + 1 of them to choose from.
GRAM = 32
#: Suffixes of one group of a task, on average; places, and then surroundings, of a gram that are too many for one task.
BIN_ROWS = 40_000
HOT_PLACES = 20_000
#: Suffixes that the multikey quicksort leaves to a plain sort; surroundings that a task hands on at a time.
FEW, HANDED = 48, 4000
#: Bytes that are hashed at a time.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = np.uint64((1 << 22) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, base, np.uint64))), dtype=np.uint64)


class Minimizers:
    """Finds the minimizers of byte strings."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        most = CHUNK * 2 + length
        self.up, self.down = _powers(_BASE, most), _powers(_INVERSE, most)
        self.table = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run of `gram` bytes."""
        n = len(data) - self.gram + 1
        if n < 1:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            total = np.concatenate(([np.uint64(0)], np.cumsum(self.table[data] * self.up[: len(data)], dtype=np.uint64)))
            h = (total[self.gram :] - total[:n]) * self.down[:n]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))

    def _least(self, h: np.ndarray, ok: np.ndarray | None = None) -> np.ndarray:
        """Places that are the first least of some run of windows; ok: which runs count."""
        width = self.length - self.gram + 1
        if len(h) < width:
            return np.empty(0, np.int64)
        best = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < width:
            best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
        places = (best & _PLACE).astype(np.int64)
        if ok is not None:
            places = places[ok[: len(places)]]
        return places[np.concatenate(([True], places[1:] != places[:-1]))] if len(places) else places

    def of_many(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the text, places, hashes) for texts of at least `length` bytes; long ones come in several parts."""
        part: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) >= CHUNK:
                yield from ((i, p, h) for p, h in self._long(np.frombuffer(text, np.uint8)))
            elif len(text) >= self.length:
                part.append(i)
                size += len(text)
                if size >= CHUNK:
                    yield from self._pack(texts, part)
                    part, size = [], 0
        if part:
            yield from self._pack(texts, part)

    def _pack(self, texts: list[bytes], part: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"".join([texts[i] for i in part]), np.uint8)
        sizes = np.array([len(texts[i]) for i in part])
        ends = np.cumsum(sizes)
        h = self.hashes(data)
        inside = np.zeros(len(data) + 1, np.int32)  # runs that cross a text's end do not count
        np.add.at(inside, ends - self.length + 1, 1)
        np.add.at(inside, ends, -1)
        places = self._least(h, np.cumsum(inside)[: len(data)] == 0)
        cuts = np.searchsorted(places, ends)
        lo = 0
        for i, hi, end, n in zip(part, cuts, ends, sizes, strict=True):
            yield i, places[lo:hi] - (end - n), h[places[lo:hi]]
            lo = hi

    def _long(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and hashes chunk by chunk; places never fall, so only a chunk's first can be the last one's last."""
        last = -1
        for at in range(0, len(data) - self.length + 1, CHUNK):
            h = self.hashes(data[at : at + CHUNK + self.length - 1])
            p = self._least(h)
            p = p[p + at > last]
            if len(p):
                last = int(p[-1]) + at
                yield p + at, h[p]


class BlindTrie:
    """Suffixes by the depths where they branch; the bytes in between are not kept.

    Nodes are [depth, children by next byte (-1: the suffix ends), any suffix below]; leaves are numbers.
    """

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, None
        for i in range(len(texts)):
            self._add(i)

    def _add(self, i: int) -> None:
        if self.root is None:
            self.root = [len(self.texts[i]), {-1: i}, i]
            return
        text, n = self.texts[i], len(self.texts[i])
        node = self.root
        while True:  # down by the branching bytes alone
            depth = node[0]
            nxt = node[1].get(text[depth] if depth < n else -1) if depth <= n else None
            if nxt is None or isinstance(nxt, int):
                break
            node = nxt
        shared = common_prefix(text, self.texts[nxt if isinstance(nxt, int) else node[2]])
        parent, step, node = None, None, self.root
        while node[0] < shared:
            step_next = text[node[0]]
            nxt = node[1].get(step_next)
            if nxt is None or isinstance(nxt, int):
                break
            parent, step, node = node, step_next, nxt
        mine = text[shared] if shared < n else -1
        if node[0] == shared:
            node[1][mine] = i
            return
        if node[0] < shared:  # branch off on the way to a leaf
            leaf = node[1][text[node[0]]]
            other = self.texts[leaf]
            node[1][text[node[0]]] = [shared, {other[shared] if shared < len(other) else -1: leaf, mine: i}, leaf]
            return
        other = self.texts[node[2]]
        new = [shared, {other[shared] if shared < len(other) else -1: node, mine: i}, node[2]]
        if parent is None:
            self.root = new
        else:
            parent[1][step] = new

    def ordered(self) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Suffixes in order, and (depth, first, last + 1 in that order) of each node with two or more below."""
        order: list[int] = []
        nodes: list[tuple[int, int, int]] = []
        stack: list = [(self.root, None)] if self.root is not None else []
        while stack:
            node, began = stack.pop()
            if isinstance(node, int):
                order.append(node)
            elif began is not None:
                if len(order) - began > 1:
                    nodes.append((node[0], began, len(order)))
            else:
                stack.append((node, len(order)))
                stack.extend((node[1][c], None) for c in sorted(node[1], reverse=True))
        return order, nodes


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def repeated_offsets(lefts: list[bytes], rights: list[bytes], copies: list[bool], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(suffix, least offset, largest offset) of strings of `length` bytes that another suffix has as well.

    lefts: what stands before each suffix, backwards. Pairs (left, right) are distinct; copies: there is another
    suffix just like this one. An offset counts from the suffix's start, and is 0 or less.
    """
    out = []
    for i, many in enumerate(copies):
        if many and len(rights[i]) + len(lefts[i]) >= length:
            out.append((i, -len(lefts[i]), min(0, len(rights[i]) - length)))
    n = len(lefts)
    if n < 2:
        return out
    if n == 2:
        lo, hi = -common_prefix(*lefts), min(0, common_prefix(*rights) - length)
        return out + [(i, lo, hi) for i in (0, 1)] if lo <= hi else out
    kinds: dict[bytes, list[int]] = {}
    for i, r in enumerate(rights):
        kinds.setdefault(r, []).append(i)
    order, nodes = BlindTrie(list(kinds)).ordered()
    below = list(kinds.values())
    by_right = np.array([i for k in order for i in below[k]])
    starts = np.cumsum([0, *(len(below[k]) for k in order)])
    spans = [(d, starts[a], starts[b]) for d, a, b in nodes]
    spans += [(len(rights[below[k][0]]), starts[j], starts[j + 1]) for j, k in enumerate(order) if len(below[k]) > 1]
    left_kinds: dict[bytes, list[int]] = {}
    for i, x in enumerate(lefts):
        left_kinds.setdefault(x, []).append(i)
    names, sets = list(left_kinds), list(left_kinds.values())
    left_order, _ = BlindTrie(names).ordered()
    by_left = [i for k in left_order for i in sets[k]]
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    step = np.array([0, *(common_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:], strict=False))])
    best = np.ones(n, np.int64)  # the least offset found so far of each suffix; 1: none
    for depth, a, b in sorted(spans, key=lambda s: -s[0]):
        if depth < length - int(step.max()):
            break
        there = np.sort(rank[by_right[a:b]])
        between = np.minimum.reduceat(np.append(step, 0), np.stack([there[:-1] + 1, there[1:] + 1], 1).ravel())[::2]
        most = np.zeros(len(there), np.int64)
        most[:-1] = between
        most[1:] = np.maximum(most[1:], between)
        hi = min(0, depth - length)
        for r, m in zip(there.tolist(), most.tolist(), strict=True):
            i = by_left[r]
            if -m <= hi and -m < best[i]:
                best[i] = -m
                out.append((i, -m, hi))
    return out


def multikey(keys: np.ndarray, plain: list[bytes]) -> list[np.ndarray]:
    """The rows of keys (rows x words, compared word by word) in order, as groups of rows that are alike in all words.

    Quicksort in three parts by one word at a time: the rows below and above a pivot are parted by the same word again, those
    like it by the next word. Few rows are sorted plainly. plain: the rows' words as bytes, which sort alike.
    """
    out: list[np.ndarray] = []
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        rows, word = stack.pop()
        if len(rows) < 2 or word == keys.shape[1]:
            if len(rows):
                out.append(rows)
            continue
        if len(rows) <= FEW:
            ordered = sorted(rows.tolist(), key=plain.__getitem__)
            at = 0
            for i in range(1, len(ordered) + 1):
                if i == len(ordered) or plain[ordered[i]] != plain[ordered[at]]:
                    out.append(np.array(ordered[at:i]))
                    at = i
            continue
        values = keys[rows, word]
        some = np.sort(values[:: len(values) // 9])
        pivot = some[len(some) // 2]
        # The part to come first is pushed last.
        stack.extend(((rows[values > pivot], word), (rows[values == pivot], word + 1), (rows[values < pivot], word)))
    return out


def _find(length: int, gram: int, names: list[str]):
    """From suffixes (names, n, before, rest) those that share a string with another: names, least and largest offset."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["rest"].map(len) >= gram]
        right, before, places = pdf["rest"].tolist(), pdf["before"].tolist(), pdf["n"].tolist()
        plain = [r[:gram] for r in right]
        keys = np.frombuffer(b"".join(plain), ">u8").reshape(-1, gram // 8)
        rows: list[tuple[int, int, int]] = []
        for group in multikey(keys, plain):
            if len(group) == 1 and places[group[0]] < 2:
                continue
            same: dict[tuple[bytes, bytes], list[int]] = {}
            for i in group.tolist():
                same.setdefault((before[i][::-1], right[i]), []).append(i)
            members = list(same.values())
            many = [sum(places[i] for i in m) > 1 for m in members]
            found = repeated_offsets([k[0] for k in same], [k[1] for k in same], many, length)
            rows.extend((i, lo, hi) for u, lo, hi in found for i in members[u])
        out = pdf[names].iloc[[r[0] for r in rows]].reset_index(drop=True)
        return out.assign(lo=np.array([r[1] for r in rows], np.int32), hi=np.array([r[2] for r in rows], np.int32))

    return find


def runs_of(places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where runs start: places with the same gram that follow each other at one distance."""
    if not len(places):
        return np.empty(0, np.int64)
    same, gap = hashes[1:] == hashes[:-1], np.diff(places)
    turn = np.zeros(len(same), bool)
    turn[1:] = same[1:] & same[:-1] & (gap[1:] != gap[:-1])
    return np.concatenate(([0], np.flatnonzero(~same | turn) + 1))


def _as_runs(places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First place, hash, distance (0: alone) and number of places of each run."""
    first = runs_of(places, hashes)
    n = np.diff(np.append(first, len(places)))
    step = np.where(n > 1, np.append(np.diff(places), 0)[first], 0)
    return places[first], hashes[first], step, n


def _window_names(before: bytes, rest: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, names: offsets x 2) of all strings of `length` bytes around a gram."""
    data = np.frombuffer(before + rest, np.uint8).astype(np.uint64)
    first = np.arange(0, min(len(before), len(data) - length) + 1)
    names = []
    with np.errstate(over="ignore"):
        for base in (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)):
            up, down = _powers(base, len(data)), _powers(np.uint64(pow(int(base), -1, 2**64)), len(data))
            mixed = (data + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            total = np.concatenate(([np.uint64(0)], np.cumsum(mixed * up, dtype=np.uint64)))
            h = (total[first + length] - total[first]) * down[first]
            names.append(h ^ (h >> np.uint64(31)))
    return first - len(before), np.stack(names, 1).view(np.int64)


def _windows(surroundings: DataFrame, length: int) -> DataFrame:
    """(c1, c2, lo, hi) for each string that two surroundings (c1, c2, before, rest) have; lo and hi are its offset."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                found = [_window_names(b, r, length) if len(b) + len(r) >= length else (np.empty(0, np.int64), np.empty((0, 2), np.int64)) for b, r in zip(part["before"], part["rest"], strict=True)]
                sizes, names = [len(o) for o, _ in found], np.concatenate([n for _, n in found])
                yield pd.DataFrame({
                    "c1": np.repeat(part["c1"].to_numpy(), sizes), "c2": np.repeat(part["c2"].to_numpy(), sizes),
                    "lo": np.concatenate([o for o, _ in found]), "w1": names[:, 0], "w2": names[:, 1],
                })

    each = cut(surroundings.select("c1", "c2", "before", "rest").mapInPandas(name, "c1 long, c2 int, lo int, w1 long, w2 long"))
    who, name_at = F.struct("c1", "c2"), ["w1", "w2", "lo"]  # the gram at one offset only: a place's other grams name its strings too
    shared = each.groupBy(*name_at).agg(F.min(who).alias("a"), F.max(who).alias("b")).where("a <> b").select(*name_at)
    return each.join(cut(shared), name_at, "left_semi").select("c1", "c2", "lo", F.col("lo").alias("hi"))


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_places: int = HOT_PLACES) -> DataFrame:
    """(k1, k2, spans array<struct<lo, hi>>): first places of repeated strings, from lo to hi, of each text.

    texts: k1, k2 (name of the text) and data (binary). Copies of one text count once. Only texts with a repeated
    string have a row.
    """
    reach = length - gram

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, seen = Minimizers(length, gram), set()
        for batch in batches:
            names = list(zip(batch["k1"].tolist(), batch["k2"].tolist(), strict=True))
            batch = batch[[not (x in seen or seen.add(x)) for x in names]]  # a copy has no places of its own
            data, k1, k2 = batch["data"].tolist(), batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for some in [range(i, min(i + 500, len(data))) for i in range(0, len(data), 500)]:
                parts = [(some[i], *_as_runs(p, h)) for i, p, h in found.of_many([data[j] for j in some])]
                if parts:
                    which = np.repeat([i for i, *_ in parts], [len(p) for _, p, *_ in parts])
                    p, h, step, n = (np.concatenate([x[k] for x in parts]) for k in (1, 2, 3, 4))
                    yield pd.DataFrame({"h": h.view(np.int64), "k1": k1[which], "k2": k2[which], "pos": p, "step": step, "n": n})

    bound_batches()
    marks = cut(texts.select("k1", "k2", "data").mapInPandas(sample, "h long, k1 long, k2 int, pos int, step int, n int"))
    # A gram at two places or more. Its rows are many only in the join, whose large keys can be split.
    place = F.xxhash64("k1", "k2", "pos")
    twice = marks.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.sum("n").alias("total")).where("lo <> hi or total > 1")
    twice = cut(twice.select(F.col("h").alias("of_h"), (F.col("total") > hot_places).alias("hot")))
    kept = marks.join(twice, marks.h == twice.of_h).select("k1", "k2", F.struct("pos", "step", "n", "hot").alias("run"))
    places = cut(kept.groupBy(F.col("k1").alias("j1"), F.col("k2").alias("j2")).agg(F.collect_set("run").alias("runs")))
    drop(marks)  # the places are written by now
    drop(twice)
    count = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + F.when(r["hot"], 0).otherwise(1))
    totals = places.agg(F.sum(count).alias("n"), F.max(F.exists("runs", lambda r: r["hot"])).alias("hot")).first()
    names = ["k1", "k2", "at", "hot", "c1", "c2", "n", "before", "rest"]

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = None, {}
        for batch in batches:
            for k1, k2, data, found in zip(batch["k1"], batch["k2"], batch["data"], batch["runs"], strict=True):
                if (k1, k2) == last:  # copies of a text come one after another
                    continue
                last = (k1, k2)
                for r in found:
                    for p in range(r["pos"], r["pos"] + max(r["step"], 1) * r["n"], max(r["step"], 1)):
                        seen.setdefault((k1, k2, r["hot"], data[max(0, p - reach) : p], data[p : p + length]), []).append(p)
                    if len(seen) >= HANDED:
                        yield handed(seen)
                        seen = {}
            if seen:
                yield handed(seen)
                seen = {}

    def handed(seen: dict) -> pd.DataFrame:
        rows = []
        for (k1, k2, hot, before, rest), at in seen.items():
            name = hashlib.blake2b(len(before).to_bytes(2, "big") + before + rest, digest_size=12).digest() if hot else bytes(12)
            rows.append((k1, k2, at, hot, int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True), len(at), before, rest))
        return pd.DataFrame(rows, columns=names)

    schema = "k1 long, k2 int, at array<int>, hot boolean, c1 long, c2 int, n int, before binary, rest binary"
    met = texts.join(places, (texts.k1 == places.j1) & (texts.k2 == places.j2)).select("k1", "k2", "data", "runs")
    near = met.mapInPandas(around, schema)
    bins = max(64, -(-(totals["n"] or 0) // BIN_ROWS))
    dealt = F.pmod(F.xxhash64(F.substring("rest", 1, gram)), F.lit(bins)).alias("bin")
    if totals["hot"]:
        near = cut(near)
    plain = near.where("not hot") if totals["hot"] else near
    found = plain.select("k1", "k2", "at", "n", "before", "rest", dealt).groupBy("bin").applyInPandas(_find(length, gram, ["k1", "k2", "at"]), "k1 long, k2 int, at array<int>, lo int, hi int")
    if totals["hot"]:
        hot, name = near.where("hot"), ["c1", "c2"]
        sides = hot.groupBy(*name).agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        sides = cut(sides.withColumn("g", F.xxhash64(F.substring("rest", 1, gram))))
        many = cut(sides.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > hot_places))
        few = sides.join(many, "g", "left_anti").select(*name, "n", "before", "rest", dealt)
        told = few.groupBy("bin").applyInPandas(_find(length, gram, name), "c1 long, c2 int, lo int, hi int")
        rest = sides.join(many, "g", "left_semi")
        whole = rest.where((F.col("n") > 1) & (F.length("before") + F.length("rest") >= length))
        told = told.unionByName(whole.select(*name, (-F.length("before")).alias("lo"), F.least(F.lit(0), F.length("rest") - length).alias("hi")))
        told = cut(told.unionByName(_windows(rest, length)) if not many.isEmpty() else told)
        spans = cut(told.groupBy(*name).agg(F.collect_set(F.struct("lo", "hi")).alias("offsets")))
        back = hot.select("k1", "k2", "at", *name).join(spans, name).select("k1", "k2", "at", F.explode("offsets").alias("o"))
        found = found.unionByName(back.select("k1", "k2", "at", F.col("o.lo").alias("lo"), F.col("o.hi").alias("hi")))

    def spread(ats: pd.Series, los: pd.Series, his: pd.Series) -> pd.Series:
        return pd.Series([[{"lo": a, "hi": b} for a, b in joined(np.sort(at), lo, hi)] for at, lo, hi in zip(ats, los, his, strict=True)], dtype=object)

    spans = F.pandas_udf(spread, "array<struct<lo:int,hi:int>>")("at", "lo", "hi")
    return found.select("k1", "k2", spans.alias("s")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("s")).alias("spans"))


def joined(at: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Runs of first places: at[i] + lo to at[i] + hi for each rising place, those that touch as one."""
    ends = np.flatnonzero(np.diff(at) > hi - lo + 1)
    firsts, lasts = np.concatenate(([0], ends + 1)), np.concatenate((ends, [len(at) - 1]))
    return [(int(at[a] + lo), int(at[b] + hi)) for a, b in zip(firsts, lasts, strict=True)]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_places: int = HOT_PLACES) -> DataFrame:
    """(id, n_bytes, removed array<struct<start, end>>, kept binary) for each row of docs.

    removed: maximal runs of bytes that some string of `length` bytes covers which starts anywhere else as well, in
    this document or another; kept: the other bytes. Null texts count as empty. Repeated rows are documents of
    their own, so texts of `length` bytes or more that come twice lose everything.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).alias("id"), data.alias("data"))
    texts = texts.withColumn("k1", F.xxhash64("data")).withColumn("k2", F.hash("data"))
    sizes = texts.select("k1", "k2").groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    spans = repeats(texts.where(F.length("data") >= length), length, gram, hot_places)
    known = sizes.where("copies > 1").join(spans, ["k1", "k2"], "full").withColumnsRenamed({"k1": "j1", "k2": "j2"})
    known = cut(known.select("j1", "j2", F.coalesce("copies", F.lit(1)).alias("copies"), "spans"))
    both = texts.join(known, (texts.k1 == known.j1) & (texts.k2 == known.j2), "left").select("id", "data", "copies", "spans")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, data, copies, spans in zip(batch["id"], batch["data"], batch["copies"], batch["spans"], strict=True):
                if copies == copies and copies is not None and copies > 1 and len(data) >= length:
                    runs = [(0, len(data))]
                else:
                    runs = merged([] if spans is None else [(s["lo"], s["hi"] + length) for s in spans])
                edges = [0, *(x for r in runs for x in r), len(data)]
                rows.append((i, len(data), [{"start": a, "end": b} for a, b in runs], b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInPandas(strip, f"id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


