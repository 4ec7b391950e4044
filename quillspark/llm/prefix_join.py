"""Jaccard join of n-gram sets with prefix trees, and the components of its links.

Two sets with 100 * intersection >= 75 * union share an element among the first
n - ceil(0.75 n) + 1 of each in any fixed global order. The order here is by hash,
with shingles that are frequent in the corpus last, so lists of sets with a common
prefix element stay short unless the sets really are alike.

1. Equal sets are one set, known by a 64-bit digest.
2. In the list of every prefix element the smallest set leads; each other set is
   compared with the one that leads it most often, then with those leaders that are
   still in another component. Large lists are led part by part, and the parts' leaders
   by one leader, so no list meets in one task.
3. Links make components. Lists in which several components are left are searched
   in full: every set outside the largest component against all others. Lists with the
   same members are searched once, large ones in parts. A set's search ends at a few
   candidates first; where it did, it is done again among the components as they are by
   then, which leaves out all that is linked, with more candidates, in the end with all.

Comparisons run in prefix trees. With a leader, a walk over the ordered prefixes shares
the overlap of common beginnings, and leaves out subtrees that can't reach the threshold
by what is left on both sides: the prefixes tell the overlap up to the smaller of their
last elements, the lengths bound the rest. In a list, a probe is compared with all members
at once, by places, sizes and counts of a few patterns, and a pair with a common element
before the list's is left out: it meets in the list of that element. So no pair is compared in more than one list. What
passes is compared by shortened whole sets, which never count too little, then by whole
sets. Copies and chains of copies are thus found without all pairs of a group, and no
link between components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import Tables, components, rows_of, sized
from .words import chunks, member, shingle_sets, text_buffer

WIDTH = 5
#: Entries of the summary of frequent shingles; it only orders elements, so it decides about speed, not results.
FREQUENT = 1 << 17
FAN_IN = 32
#: Parts of a long list that get a leader each, and sets in a tree.
PARTS = 64
TREE_SETS = 2048
#: Similar sets differ in size by a factor of 4/3 at most: its logarithm in millionths, rounded up twice.
RATIO = 287_684
#: Sets whose prefix a task has already given.
SEEN = 1 << 20
#: Candidates that a set in a list may have in the first round, and how many times as many in the second; the third has no limit.
FEW = 4
MORE = 16
#: Patterns by which a probe is compared with a whole list, and members at a time.
COARSE = 128
COARSE_ROWS = 2048


def similar(common: int, a: int, b: int) -> bool:
    """100 * common >= 75 * (a + b - common)."""
    return 7 * common >= 3 * (a + b)


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


class Node:
    __slots__ = ("run", "children", "entries", "least", "most", "group", "mixed")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.entries = run, {}, []
        self.least, self.most, self.group, self.mixed = 1 << 62, 0, None, False

    def note(self, n: int, group: object) -> None:
        self.least, self.most = min(self.least, n), max(self.most, n)
        if self.group is None:
            self.group = group
        elif self.group != group:
            self.mixed = True


class PrefixTree:
    """Ascending prefixes of sets, those with a common beginning on a common path."""

    def __init__(self) -> None:
        self.root = Node(np.zeros(0, np.uint64))

    def insert(self, items: np.ndarray, n: int, key: object, group: object = None) -> None:
        """Add the prefix `items` of a set of `n` elements."""
        last, i, node = len(items), 0, self.root
        while True:
            node.note(n, group)
            if i == last:
                node.entries.append((key, n, group))
                return
            child = node.children.get(items[i])
            if child is None:
                child = node.children[items[i]] = Node(items[i:])
                child.note(n, group)
                child.entries.append((key, n, group))
                return
            m = min(len(child.run), last - i)
            other = np.flatnonzero(child.run[:m] != items[i : i + m])
            k = int(other[0]) if len(other) else m
            if k < len(child.run):
                upper = Node(child.run[:k])
                upper.least, upper.most, upper.group, upper.mixed = child.least, child.most, child.group, child.mixed
                child.run = child.run[k:]
                upper.children[child.run[0]] = child
                node.children[items[i]] = upper
                child = upper
            i += k
            node = child

    def search(self, items: np.ndarray, n: int, group: object = None) -> Iterator[tuple[object, object]]:
        """(key, group) of all sets, but those of the same group, that may be similar to a set of `n` elements with the prefix `items`.

        Whole sets as prefixes give exactly the similar ones.
        """
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, common, depth, place = stack.pop()
            if group is not None and not node.mixed and node.group == group:
                continue
            if len(node.run):
                # beyond the last known element of the probe nothing is known
                run = node.run[: np.searchsorted(node.run, items[-1], side="right")]
                common += int(np.count_nonzero(member(run, items)))
                depth += len(run)
                place = int(np.searchsorted(items, node.run[-1], side="right"))
            # of all lengths in the subtree, the one that uses up what is left of both has the best chance
            length = min(max(depth + n - place, node.least), node.most)
            if not similar(common + min(length - depth, n - place), length, n):
                continue
            for key, size, own in node.entries:
                if (group is None or own != group) and similar(common + min(size - depth, n - place), size, n):
                    yield key, own
            stack.extend((child, common, depth, place) for child in node.children.values())


def shortened(items: np.ndarray) -> np.ndarray:
    """How many elements of a set begin with each pattern of bits, in half a byte each; there are about as many patterns as elements, and COARSE at least."""
    bits = max(COARSE.bit_length() - 1, int(len(items) - 1).bit_length())
    while True:
        counts = np.bincount((items >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max(initial=0) < 16:
            return (counts[0::2] << 4 | counts[1::2]).astype(np.uint8)
        bits += 1


def counted(short: np.ndarray) -> np.ndarray:
    """The numbers of a shortened set, unpacked."""
    out = np.empty(2 * len(short), np.uint8)
    out[0::2], out[1::2] = short >> 4, short & 15
    return out


def most_common(a: np.ndarray, b: np.ndarray) -> int:
    """No less than the number of common elements, from the numbers of both: in each pattern the smaller one at most."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = a.reshape(len(b), -1).sum(axis=1)
    return int(np.minimum(a, b).sum())


def coarse(counts: np.ndarray) -> np.ndarray:
    """The numbers of a shortened set for COARSE patterns, in two bytes each if they fit."""
    sums = counts.reshape(COARSE, -1).sum(axis=1, dtype=np.int64)
    return sums.astype(np.uint16) if sums.max() < 1 << 16 else sums


class ListMembers:
    """Members of a list, which a probe is compared with all at once: by places and sizes, then by coarse counts, and only what passes one by one."""

    def __init__(self) -> None:
        self.before, self.shorts, self.rows, self.arrays = [], [], [], None

    def add(self, before: np.ndarray, n: int, key: int, group: int, short: np.ndarray) -> None:
        """A set of `n` elements, with what precedes the list's element in it and the numbers of the shortened set."""
        self.before.append(before)
        self.shorts.append(short)
        self.rows.append((n, len(before), key, group))

    def search(self, before: np.ndarray, n: int, group: int, short: np.ndarray) -> Iterator[int]:
        """Keys of the sets of other groups that may be similar and have no element in common with `before`."""
        if not self.rows:
            return
        if self.arrays is None:
            self.arrays = np.array(self.rows, np.int64), np.stack([coarse(x) for x in self.shorts])
        rows, counts = self.arrays
        sizes, places, keys, groups = rows.T
        need = 3 * (sizes + n)
        at = np.flatnonzero((groups != group) & (7 * np.minimum(sizes - places, n - len(before)) >= need))
        for lo in range(0, len(at), COARSE_ROWS):
            some = at[lo : lo + COARSE_ROWS]
            common = np.minimum(counts[some], coarse(short)).sum(axis=1, dtype=np.int64)
            for i in some[7 * common >= need[some]].tolist():
                if similar(most_common(short, self.shorts[i]), n, int(sizes[i])) and not member(self.before[i], before).any():
                    yield int(keys[i])


def _trim(hashes: np.ndarray, counts: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    if len(hashes) <= entries:
        return hashes, counts
    cut = np.partition(counts, len(counts) - entries - 1)[len(counts) - entries - 1]
    keep = counts > cut
    return hashes[keep], counts[keep] - cut


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return hashes, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(hashes)).astype(np.int64)


def frequent_shingles(df: DataFrame, text: str = "text", width: int = WIDTH, entries: int = FREQUENT) -> np.ndarray:
    """Hashes (ascending) of shingles in many texts, by mergeable summaries over the whole column; never more than `entries`."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            for own in shingle_sets(batch[text], width):
                held.append((own, np.ones(len(own), np.int64)))
                size += len(own)
                if size > 1 << 20:
                    total = _trim(*_add([total, *held]), 4 * entries)
                    held, size = [], 0
        total = _trim(*_add([total, *held]), entries)
        yield _summary(TaskContext.get().partitionId(), *total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), None
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"] if part is None else min(part, row["part"])
                total = _trim(*_add([total, (np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], np.int64))]), entries)
        if part is not None:
            yield _summary(part // FAN_IN, *total)

    schema = "part long, hashes binary, counts binary"
    parts = df.select(text).mapInArrow(summarise, schema)
    n = max(1, df.rdd.getNumPartitions())
    while n > 1:
        n = -(-n // FAN_IN)
        parts = (parts.repartitionByRange(n, F.floor(F.col("part") / FAN_IN)) if n > 1 else parts.repartition(1)).mapInArrow(merge, schema)
    got = parts.collect()  # one summary of bounded size
    return np.sort(np.frombuffer(got[0]["hashes"], np.uint64)) if got else np.zeros(0, np.uint64)


def _summary(part: int, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([hashes.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["part", "hashes", "counts"])


def digest(items: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


#: Elements that come last have the highest bit, the others haven't; so the order of numbers is the global order.
LATE = np.uint64(1 << 63)


def ordered(items: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set's elements as numbers in the global order."""
    late = member(items, frequent)
    codes = items >> np.uint64(1)
    return np.concatenate((codes[~late], codes[late] | LATE))


def signatures(df: DataFrame, frequent: np.ndarray, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """Rows (key, n, sid, prefix, rare): size and digest of each text's set, and its prefix, of which the first `rare` aren't frequent.

    A task gives the prefix of equal sets once. A text without words has a null sid.
    """
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for i, j in chunks(text_buffer(whole[text])[1], 1 << 22):
                batch = whole.slice(i, j - i)
                n, sid, prefix, rare = [], [], [], []
                for own in shingle_sets(batch[text], width):
                    n.append(len(own))
                    sid.append(digest(own) if len(own) else None)
                    if len(seen) >= SEEN:
                        seen.clear()
                    if not len(own) or sid[-1] in seen:
                        prefix.append(own[:0])
                        rare.append(0)
                        continue
                    seen.add(sid[-1])
                    first = ordered(own, shared.value)[: prefix_length(len(own))]
                    prefix.append(first)
                    rare.append(int(np.count_nonzero(first < LATE)))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in prefix]))).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *prefix]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch[key], pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(rare, pa.int32())], names=["key", "n", "sid", "prefix", "rare"])

    return df.select(key, text).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, n long, sid long, prefix array<long>, rare int")


def may_start(n: str, i: str, other_n: str, other_i: str) -> Column:
    """Whether two sets can be similar if their first common element is the i-th of one and the other_i-th of the other: what is left of either must reach the threshold."""
    need = 3 * (F.col(n) + F.col(other_n))
    return (7 * (F.col(n) - F.col(i)) >= need) & (7 * (F.col(other_n) - F.col(other_i)) >= need)


def with_limits(tables: Tables, lists: DataFrame) -> DataFrame:
    """The lists with `most` and `leader_most`: the largest set that either can be similar to, if its own prefix ends first.

    Of two similar sets, the prefix that ends first has all but n - threshold of its elements
    in the other's prefix too. So a set with `s` elements in lists, of `p` in its prefix, has
    only partners of a size for which s >= p - n + 3 (n + size) / 7.
    """
    each = lists.select("token", "sid", "n").union(lists.select("token", F.col("leader").alias("sid"), F.col("leader_n").alias("n"))).distinct()
    p = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1
    most = F.floor((7 * (F.col("s") + F.col("n") - p) - 3 * F.col("n")) / 3).cast("int")
    with Tables(tables.spark) as own:
        limits = own.write(each.groupBy("sid", "n").agg(F.count(F.lit(1)).alias("s")).select("sid", most.alias("most")), "limits")
        leading = sized(limits.select(F.col("sid").alias("leader"), F.col("most").alias("leader_most")), rows_of(limits))
        out = lists.join(sized(limits), "sid").join(leading, "leader")
        return tables.write(out.select("token", "leader", "leader_n", "leader_i", "leader_most", "sid", "n", "i", "most"), "lists")


def star_lists(tables: Tables, found: DataFrame) -> DataFrame:
    """Rows (token, leader, leader_n, leader_i, sid, n, i): every set in the list of a prefix element, with its place there, beside a smaller one that leads it."""
    all_ = found.where("sid IS NOT NULL").select("sid", "n", "rare", F.posexplode("prefix").alias("i", "token"))
    part = F.when(F.col("i") >= F.col("rare"), F.pmod("sid", F.lit(PARTS)) + 1).otherwise(F.lit(0)).cast("int")
    all_ = all_.select("token", part.alias("part"), "sid", F.col("n").cast("int").alias("n"), "i")
    lead = F.first(F.struct("sid", "n", "i")).over(W.partitionBy("token", "part").orderBy("sid").rowsBetween(W.unboundedPreceding, W.currentRow))
    small = all_.withColumn("lead", lead).where("sid <> lead.sid")
    tops = all_.where("part > 0").groupBy("token", "part").agg(F.min(F.struct("sid", "n", "i")).alias("top"))
    top = F.first("top").over(W.partitionBy("token").orderBy("top.sid").rowsBetween(W.unboundedPreceding, W.currentRow))
    large = tops.withColumn("lead", top).where("top.sid <> lead.sid").select("token", "lead", F.col("top.sid").alias("sid"), F.col("top.n").alias("n"), F.col("top.i").alias("i"))
    out = small.select("token", "lead", "sid", "n", "i").union(large)
    return tables.write(out.select("token", F.col("lead.sid").alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.i").alias("leader_i"), "sid", "n", "i").distinct(), "lists")


def _rows_with(own: Tables, df: DataFrame, found: DataFrame, wanted: DataFrame, key: str, text: str, most: int | None) -> tuple[DataFrame, DataFrame]:
    """The wanted sids, and texts that have their sets, from one row each where keys are unique; some rows may have other sets."""
    wanted = own.write(wanted, "wanted", most)
    n = rows_of(wanted)
    keys = found.where("sid IS NOT NULL").join(sized(wanted, n), "sid", "left_semi").groupBy("sid").agg(F.min("key").alias("key"))
    keys = own.write(keys.where("key IS NOT NULL").select(F.col("key").alias(key)), "keys", n)
    rows = df.select(key, text)
    return sized(wanted, n), rows.join(sized(keys, n), key, "left_semi").unionByName(rows.where(F.col(key).isNull()))


def fetch_sets(tables: Tables, df: DataFrame, found: DataFrame, wanted: DataFrame, key: str, text: str, width: int = WIDTH, most: int | None = None) -> DataFrame:
    """Rows (sid, items) with the whole sets of the wanted sids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in chunks(text_buffer(whole[text])[1], 1 << 22):
                own = [x for x in shingle_sets(whole[text].slice(i, j - i), width) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["sid", "items"])

    with Tables(tables.spark) as own:
        wanted, rows = _rows_with(own, df, found, wanted, key, text, most)
        return tables.write(rows.mapInArrow(run, "sid long, items binary").join(wanted, "sid", "left_semi"), "sets")


def fetch_profiles(tables: Tables, df: DataFrame, found: DataFrame, wanted: DataFrame, frequent: np.ndarray, key: str, text: str, width: int = WIDTH, most: int | None = None) -> DataFrame:
    """Rows (sid, n, prefix, short): the wanted sets' sizes, their prefixes in the global order, and the shortened whole sets."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in chunks(text_buffer(whole[text])[1], 1 << 22):
                own = [x for x in shingle_sets(whole[text].slice(i, j - i), width) if len(x)]
                prefix = [ordered(x, shared.value)[: prefix_length(len(x))].tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int32()), pa.array(prefix, pa.binary()), pa.array([shortened(x).tobytes() for x in own], pa.binary())], names=["sid", "n", "prefix", "short"])

    with Tables(tables.spark) as own:
        wanted, rows = _rows_with(own, df, found, wanted, key, text, most)
        return tables.write(rows.mapInArrow(run, "sid long, n int, prefix binary, short binary").join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "profiles")


def _prefixes(tables: Tables, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (sid, n, short), one for each set of the pairs. `short` has the upper halves of the prefix's numbers: equal elements have equal ones, so counts of common ones are never too small."""
    short = F.transform("prefix", lambda x: F.shiftright(x, 32).cast("int"))
    with Tables(tables.spark) as own:
        wanted = own.write(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "wanted", 2 * rows_of(pairs))
        rows = found.where("size(prefix) > 0").join(sized(wanted), "sid", "left_semi")
        return tables.write(rows.select("sid", F.col("n").cast("int").alias("n"), short.alias("short")).dropDuplicates(["sid"]), "prefixes")


def leader_candidates(groups: DataFrame) -> DataFrame:
    """Rows (a, b) of leaders and sets that may be similar: in every (tree, part) the probe (kind 1) against the tree of the members (kind 0).

    Rows come in sorted, so a task holds one tree at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for i, (t, part, kind, sid, n) in enumerate(zip(*(batch[c].to_pylist() for c in ("tree", "part", "kind", "sid", "n")))):
                if (t, part) != now:
                    now, tree = (t, part), PrefixTree()
                items = np.asarray(batch["short"][i].values).view(np.uint32)
                if kind == 0:
                    tree.insert(items.copy(), n, sid)
                    continue
                found = [other for other, _ in tree.search(items, n)]
                a += [sid] * len(found)
                b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = groups.repartition("tree", "part").sortWithinPartitions("tree", "part", "kind", "sid")
    return dealt.select("tree", "part", "kind", "sid", "n", "short").mapInArrow(run, "a long, b long")


def list_candidates(groups: DataFrame, limit: int | None) -> DataFrame:
    """Rows (tree, a, b) of sets that may be similar and whose first common element is that of the list: probes (kind 1) against the members (kind 0).

    Sets of one component (`comp`) aren't compared. The search for a probe ends at more
    than `limit` candidates; a row (tree, a, null) then says that there are others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ListMembers()
        for batch in batches:
            lists: list[int] = []
            a: list[int] = []
            b: list[int | None] = []
            for i, (t, part, block, kind, sid, n, comp) in enumerate(zip(*(batch[c].to_pylist() for c in ("tree", "part", "block", "kind", "sid", "n", "comp")))):
                if (t, part, block) != now:
                    now, held = (t, part, block), ListMembers()
                ahead = np.frombuffer(batch["before"][i].as_buffer(), np.uint64)
                short = counted(np.frombuffer(batch["short"][i].as_buffer(), np.uint8))
                if kind == 0:
                    held.add(ahead.copy(), n, sid, comp, short)
                    continue
                found = 0
                for other in held.search(ahead, n, comp, short):
                    if found == limit:
                        b.append(None)
                        break
                    b.append(other)
                    found += 1
                a += [sid] * (len(b) - len(a))
                lists += [t] * (len(b) - len(lists))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["tree", "a", "b"])

    dealt = groups.repartition("tree", "part", "block").sortWithinPartitions("tree", "part", "block", "kind", "sid")
    return dealt.select("tree", "part", "block", "kind", "sid", "n", "comp", "before", "short").mapInArrow(run, "tree long, a long, b long")


def _dealt(own: Tables, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with a part of a's pairs, of some TREE_SETS each, so that one set with many partners isn't one task's work."""
    n = rows_of(pairs)
    sizes = own.write(pairs.groupBy("a").agg((F.count(F.lit(1)) / TREE_SETS + 1).cast("int").alias("parts")), "sizes", n)
    return own.write(pairs.join(sized(sizes), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")), "dealt", n)


def verified(tables: Tables, df: DataFrame, found: DataFrame, pairs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """Those of the written pairs (a, b) that are similar as whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            a, b = [], []
            for i, (t, kind, sid) in enumerate(zip(*(batch[c].to_pylist() for c in ("a", "kind", "sid")))):
                items = np.frombuffer(batch["items"][i].as_buffer(), np.uint64)
                if kind == 0:
                    now, own = t, items.copy()
                elif similar(int(np.count_nonzero(member(items, own))), len(items), len(own)):
                    a.append(now)
                    b.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    with Tables(tables.spark) as own:
        pairs = _dealt(own, pairs)
        sets = fetch_sets(own, df, found, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), key, text, width, 2 * rows_of(pairs))
        left = own.write(pairs.select("a", "part").distinct(), "left", rows_of(pairs))
        one = sets.join(sized(left), sets.sid == F.col("a")).select("a", "part", F.lit(0).alias("kind"), "sid", "items")
        two = sets.join(sized(pairs), sets.sid == F.col("b")).select("a", "part", F.lit(1).alias("kind"), "sid", "items")
        dealt = one.union(two).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
        return tables.write(dealt.select("a", "kind", "sid", "items").mapInArrow(run, "a long, b long"), "links")


def _leader_pairs(tables: Tables, lists: DataFrame) -> DataFrame:
    """Rows (a, b, tokens) of leaders and the sets they lead that may be similar, with the number of lists."""
    near = may_start("leader_n", "leader_i", "n", "i") & ((F.col("n") <= F.col("leader_most")) | (F.col("leader_n") <= F.col("most")))
    pairs = lists.where(near).groupBy(F.col("leader").alias("a"), F.col("sid").alias("b")).agg(F.count(F.lit(1)).alias("tokens"))
    return tables.write(pairs, "pairs")


def _apart(tables: Tables, pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components."""
    a = sized(comps.select(F.col("node").alias("a"), F.col("root").alias("ra")), rows_of(comps))
    b = sized(comps.select(F.col("node").alias("b"), F.col("root").alias("rb")), rows_of(comps))
    rows = pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    return tables.write(rows.select("a", "b"), "apart")


def _leader_candidates(tables: Tables, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    with Tables(tables.spark) as own:
        pairs = _dealt(own, pairs)
        members = prefixes.join(sized(pairs), prefixes.sid == F.col("b")).select(F.col("a").alias("tree"), "part", F.lit(0).alias("kind"), "sid", "n", "short")
        left = own.write(pairs.select("a", "part").distinct(), "left", rows_of(pairs))
        probes = prefixes.join(sized(left), prefixes.sid == F.col("a")).select(F.col("a").alias("tree"), "part", F.lit(1).alias("kind"), "sid", "n", "short")
        return tables.write(leader_candidates(members.union(probes)).distinct(), "candidates")


def _open_lists(tables: Tables, lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (token, sid, i, comp, m): the members of lists with several components and pairs that no leader was in, each list once.

    Of lists with the same members the one of the first element stands for all, for there
    the places are the smallest. A member stays only if the list has a partner for it by
    sizes, places (`may_start`) and limits (`with_limits`). Partners lie within a ratio of
    sizes, so in a frame of fixed width over their logarithms.
    """
    with Tables(tables.spark) as own:
        members = lists.select("token", "sid", "n", "i", "most").union(lists.select("token", F.col("leader").alias("sid"), F.col("leader_n").alias("n"), F.col("leader_i").alias("i"), F.col("leader_most").alias("most"))).distinct()
        members = members.join(sized(comps), members.sid == comps.node, "left").select("token", "sid", "n", "i", "most", F.coalesce("root", "sid").alias("comp"))
        open_ = members.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")).where("m > 2 AND lo <> hi")
        open_ = own.write(open_.groupBy("m", "x", "y").agg(F.min(F.struct(F.col("token") < 0, "token")).alias("first")).select("first.token"), "open")
        members = members.join(sized(open_), "token", "left_semi").withColumn("reach", 4 * F.col("n") - 7 * F.col("i")).withColumn("size", F.floor(F.log("n") * 1e6))
        around = W.partitionBy("token").orderBy("size")
        low, both = around.rangeBetween(-RATIO, 0), around.rangeBetween(-RATIO, RATIO)
        partner = F.when(F.col("most") >= F.col("n"), F.count(F.lit(1)).over(both) > 1).otherwise((F.min("n").over(low) <= F.col("most")) | (F.max("most").over(both) >= F.col("n")))
        by_size = W.partitionBy("token").orderBy("size", "sid")
        smaller = F.max("reach").over(by_size.rowsBetween(W.unboundedPreceding, -1)) >= 3 * F.col("n")
        larger = 3 * F.lead("n").over(by_size) <= F.col("reach")
        members = members.withColumn("near", partner & (F.coalesce(smaller, F.lit(False)) | F.coalesce(larger, F.lit(False))))
        members = own.write(members.where("near").select("token", "sid", "i", "comp"), "members")
        sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "m")
        return tables.write(members.join(sized(own.write(sizes, "sizes", rows_of(members))), "token"), "open_members", rows_of(members))


def _probes(tables: Tables, members: DataFrame) -> DataFrame:
    """Rows (token, sid): the members of the lists outside the largest component of each."""
    with Tables(tables.spark) as own:
        per = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
        base = own.write(per.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("base")), "base", rows_of(members))
        return tables.write(members.join(sized(base), "token").where("comp <> base").select("token", "sid"), "probes", rows_of(members))


def _list_candidates(tables: Tables, members: DataFrame, probes: DataFrame, comps: DataFrame, profiles: DataFrame, limit: int | None) -> DataFrame:
    """Rows (tree, a, b) of `list_candidates`. Of long lists both the trees and the probes are dealt out in parts."""
    with Tables(tables.spark) as own:
        counts = own.write(probes.groupBy("token").agg((F.count(F.lit(1)) / TREE_SETS + 1).cast("int").alias("blocks")), "counts", rows_of(probes))
        roots = sized(comps.select(F.col("node").alias("sid"), "root"), rows_of(comps))
        rows = members.drop("comp").join(sized(counts), "token").join(roots, "sid", "left").withColumn("comp", F.coalesce("root", "sid"))
        rows = own.write(rows.select("token", "sid", "i", "comp", "blocks", (F.col("m") / TREE_SETS + 1).cast("int").alias("parts")), "rows", rows_of(members))
        all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        some = lambda n, salt: F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(n)).cast("int")
        inside = rows.select("token", some("parts", 0).alias("part"), all_("blocks").alias("block"), F.lit(0).alias("kind"), "sid", "i", "comp")
        outside = rows.join(sized(probes), ["token", "sid"], "left_semi").select("token", all_("parts").alias("part"), some("blocks", 1).alias("block"), F.lit(1).alias("kind"), "sid", "i", "comp")
        groups = own.write(inside.union(outside), "trees")
        trees = profiles.join(sized(groups), "sid").select(F.col("token").alias("tree"), "part", "block", "kind", "sid", "n", "comp", F.substring("prefix", F.lit(1), 8 * F.col("i")).alias("before"), "short")
        both = list_candidates(trees, limit)
        return tables.write(both.select("tree", F.when(F.col("b").isNull(), F.col("a")).otherwise(F.least("a", "b")).alias("a"), F.when(F.col("b").isNotNull(), F.greatest("a", "b")).alias("b")), "candidates")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, tables: Tables | None = None) -> DataFrame:
    """Rows (key, n_shingles, component_id) for every row of `df`.

    Words and shingles are those of `words.shingle_sets`. Null and empty texts have an
    empty set and are linked with nothing. Rows with a null key count as texts, but
    never name a component, unless it has no other (then null). Repeated rows are
    copies of each other.
    """
    tables = tables or Tables(df.sparkSession)
    with Tables(df.sparkSession) as own:
        frequent = frequent_shingles(df, text, width)
        signed = own.write(signatures(df, frequent, key, text, width), "signatures")
        stars = star_lists(own, signed)
        lists = with_limits(own, stars)
        own.drop(stars)
        pairs = _leader_pairs(own, lists)
        prefixes = _prefixes(own, signed, pairs)
        found = own.write(signed.select("key", "n", "sid"), "sets")
        own.drop(signed)
        first = own.write(pairs.groupBy("b").agg(F.max_by("a", F.struct("tokens", "a")).alias("a")).select("a", "b"), "first", rows_of(pairs))
        links = verified(own, df, found, _leader_candidates(own, first, prefixes), key, text, width)
        comps = components(own, links)
        apart = _apart(own, pairs.join(sized(first), ["a", "b"], "left_anti"), comps)
        if rows_of(apart):
            new = verified(own, df, found, _leader_candidates(own, apart, prefixes), key, text, width)
            links = own.write(links.unionByName(new), "links", rows_of(links) + rows_of(new))
            comps = components(own, links)
        own.drop(pairs, prefixes)
        members = _open_lists(own, lists, comps)
        own.drop(lists)
        if rows_of(members):
            profiles = fetch_profiles(own, df, found, members.select("sid").distinct(), frequent, key, text, width, rows_of(members))
            probes = _probes(own, members)
            for limit in (FEW, FEW * MORE, None):
                if not rows_of(probes):
                    break
                candidates = _list_candidates(own, members, probes, comps, profiles, limit)
                more = own.write(candidates.where("b IS NOT NULL").select("a", "b").distinct(), "more", rows_of(candidates))
                probes = own.write(candidates.where("b IS NULL").select(F.col("tree").alias("token"), F.col("a").alias("sid")).distinct(), "probes", rows_of(candidates))
                if rows_of(more):
                    new = verified(own, df, found, more, key, text, width)
                    links = own.write(links.unionByName(new), "links", rows_of(links) + rows_of(new))
                    own.drop(comps)
                    comps = components(own, links)
        rows = found.join(sized(comps), found.sid == comps.node, "left").select("key", "n", F.coalesce("root", "sid").alias("group"))
        rows = tables.write(rows, "rows")
    named = tables.write(rows.where("`group` IS NOT NULL").groupBy("group").agg(F.min("key").alias("component"), F.count(F.lit(1)).alias("size")).where("size > 1").select("group", "component"), "named")
    return rows.join(sized(named), "group", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
