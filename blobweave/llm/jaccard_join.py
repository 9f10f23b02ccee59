"""Exact similarity join on word shingles, and the components of its links.

Method: universe-partition pigeonhole. Sets are put in size bands so that similar sets lie in the
same or neighbouring bands; a group is a band and the next. Within a group the universe of shingles is
cut by hash into segments, whose number follows from the largest symmetric difference H that a
linked pair can have: of H + 1 segments at least one is equal in both sets; of H / 2 + 1 segments at
least one differs by one shingle at most. Each set is indexed by its segments' contents, in the second
case also by all contents less one shingle. Which of the two is used is decided for each group by the
number of keys that it costs a set. Weak segments, with one shingle or none, say little: some more segments
than needed are cut, so that a linked pair has as many more equal ones, and only sets with more weak segments than
that index them. Candidates are verified exactly.

Equal sets form a class and are one node. Buckets with the same first member, the one with the most companions, are
taken together as a hub. Where that is a large group, its members are first compared with that one alone, each set in one hub and then, where it is
still apart from the first, in its other ones; sketches, which miss no linked pair, tell which of these pairs are worth verifying, and only the sets that
such pairs name are moved. That joins most near copies at a cost in proportion to their number. Hubs that are still large and in different components hold sets that share
some contents and differ elsewhere; they are cut by the segments of another hash of the universe, which every linked pair
meets in too, so unlike sets part. Hubs of several components are then joined by the likeliest pairs, as many as they have components, in
``FORESTS`` rounds. What is left is compared pair by pair, tile
by tile within tasks, by sketches that miss no linked pair; only what passes leaves the task and is verified with
the sets themselves. So no link between components is lost. ``pairs`` gives the links themselves.

Sets are known by 128-bit hashes (64 bits find candidates only), words and shingles by 64-bit hashes: two of the shingles
of two compared sets are mistaken with a probability of about their number squared / 2**65.

Defined cases: a text without words, empty or null has an empty set and no links: its component is its
own doc_id; a null doc_id stays null and does not name a component unless its class has no other;
with fewer words than the shingle's the whole sequence is the only shingle; repeated rows are
in one class; an empty table gives no rows; other columns than doc_id and text are not read (``firsts`` returns
them as they are, whatever their names).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks, join_split
from .components import components
from .textkit import mix, shingles, words

U64 = np.uint64
#: Sets in a tile: some hundred bytes each, so one task compares a usual hub as a whole and nothing is sent twice.
TILE = 2048
#: Sets of a hub above which they are compared with its first member alone before any other pair.
LARGE = 8
#: Sets of a hub outside its largest component above which it is cut by another hash, and how often at most.
CROWD, CUTS = 16384, 2
#: Rounds in which hubs of many components are joined by a few likely pairs, before all pairs that are left are verified.
FORESTS = 2
#: Segments of a sketch for each unit of the largest difference.
FINE = 4
#: Keys of a set that are not too many in any case, as contents less one shingle select better.
FEW_KEYS = 160


def sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    w = words(col)
    return [np.unique(shingles(w.hash[a:z], n)) for a, z in zip(w.word_at[:-1], w.word_at[1:], strict=True)]


def set_id(s: np.ndarray) -> bytes:
    """The 16-byte name of a set."""
    n = U64(len(s))
    return mix(np.array([np.add.reduce(mix(s)) + n, np.add.reduce(mix(s ^ U64(0xA5A5A5A5A5A5A5A5))) ^ n], U64)).astype(">u8").tobytes()


def short_id(name: bytes) -> int:
    """The first half of a set's name as a signed number."""
    return int.from_bytes(name[:8], "big", signed=True)


class Bands:
    """Sizes, segments and keys for the threshold percent/100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.plans: dict[int, tuple[int, int, int, bool]] = {}
        # 100 * inter >= percent * union bounds the symmetric difference of sizes x, y by this share of x + y
        self.num, self.den = 100 - percent, 100 + percent
        least = 1
        while self.difference(least + least * 100 // percent) == 0:  # smaller sets are linked only if equal
            least += 1
        self.low = [least]

    def difference(self, total: int) -> int:
        return self.num * total // self.den

    def band(self, size: int) -> int:
        """-1: linked with equal sets only."""
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.low, size, "right")) - 1

    def most(self, group: int) -> int:
        """The largest symmetric difference of a linked pair in a group."""
        while len(self.low) <= group + 2:
            self.band(self.low[-1])
        x = self.low[group + 1] - 1
        return self.difference(x + min(x * 100 // self.percent, self.low[group + 2] - 1))

    def plan(self, group: int) -> tuple[int, int, int, bool]:
        """Of a group: the number of segments, how many weak ones a set may leave out, the size from which a segment
        is not weak, and whether contents less one shingle are indexed."""
        if group not in self.plans:
            h = self.most(group)
            less = h // 2 + 1
            # where leaving out segments of one shingle would take too many, only empty ones are weak
            strong = 2
            slack = self.slack(self.low[group], h + 1)
            if not slack:
                strong = 1
                slack = self.slack(self.low[group], h + 1, strong)
            whole = h + 1 + (slack or 1)
            few = self.low[group + 1] - 1 + less < max(2 * whole, FEW_KEYS)
            self.plans[group] = (less, 0, 2, True) if few else (whole, slack or 1, strong, False)
        return self.plans[group]

    def sketch(self, s: np.ndarray, group: int) -> np.ndarray:
        """A byte for the content of each of ``FINE`` (H + 1) segments; of sets with a symmetric difference of d at most d differ."""
        n = FINE * (self.most(group) + 1)
        cut = np.searchsorted(((s >> U64(32)) * U64(n)) >> U64(32), np.arange(n + 1, dtype=U64))
        total = np.append(U64(0), np.cumsum(mix(s), dtype=U64))
        return (mix(total[cut[1:]] - total[cut[:-1]]) >> U64(56)).astype(np.uint8)

    @staticmethod
    def slack(size: int, needed: int, strong: int = 2) -> int:
        """Segments cut beyond those needed, so that most sets of this size have no more with fewer shingles than ``strong``
        (1 or 2); 0 if that takes so many that the segments get too small."""
        for slack in range(1, 3 + needed * 3 // 10):
            mean = size / (needed + slack)
            weak = (needed + slack) * math.exp(-mean) * (1 + mean if strong > 1 else 1)
            if slack >= weak + 1.5 * math.sqrt(weak):
                return slack
        return 0

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The keys of one sorted set in its own group and the one below."""
        band = self.band(len(s))
        if band < 0:
            return np.zeros(0, np.int64)
        out = []
        scrambled = mix(s)
        total = np.append(U64(0), np.cumsum(scrambled, dtype=U64))
        for group in (band - 1, band):
            if group < 0:
                continue
            n, slack, strong, less = self.plan(group)
            segment = ((s >> U64(32)) * U64(n)) >> U64(32)  # ascending, as s is
            cut = np.searchsorted(segment, np.arange(n + 1, dtype=U64))
            sums = total[cut[1:]] - total[cut[:-1]]
            size = np.diff(cut)
            salt = mix(np.arange(n, dtype=U64) + U64(group) * U64(1 << 32) + U64(1 << 60))
            weak = size < strong
            enough = weak.sum() <= slack
            # with deletions a single shingle still tells, as what it is compared with has two
            out.append(mix(sums + salt)[size >= (1 if less else strong) if enough else slice(None)])
            if less:
                ok = np.repeat(size > 1 if enough else size > 0, size)
                out.append(mix(np.repeat(sums + salt, size) - scrambled)[ok])
        return np.unique(np.concatenate(out)).astype(np.int64)


def classes(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n_shingles, id, short): each document's set size and set, the latter also by half its name."""

    def run(batches):
        for b in blocks(batches):
            got = sets(b.column("text"), n)
            names = [set_id(s) for s in got]
            cols = [b.column("doc_id"), pa.array([len(s) for s in got], pa.int64()), pa.array(names, pa.binary()), pa.array([short_id(x) for x in names], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "id", "short"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, id binary, short bigint")


def keyed(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """Rows (key, short). Sets that a task has met already are left out."""

    def run(batches):
        met: set[int] = set()
        for b in blocks(batches):
            keys, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in sets(b.column("text"), n):
                i = short_id(set_id(s))
                if i not in met:
                    if len(met) > 200_000:  # bounds the memory; those met again are merged later
                        met.clear()
                    met.add(i)
                    k = bands.keys(s)
                    keys.append(k)
                    ids.append(np.full(len(k), i))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["key", "short"])

    return docs.select("text").mapInArrow(run, "key bigint, short bigint")


def shared(keys: DataFrame) -> DataFrame:
    """The rows whose key more than one set has. Sorted runs are read one after the other; only the first of a run is held."""

    def run(batches):
        last = first = None
        split = False
        for b in batches:
            key, ids = b.column("key").to_numpy(), b.column("short").to_numpy()
            if not len(key):
                continue
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1])])
            size = np.diff(np.append(start, len(key)))
            lead = np.repeat(ids[start], size)
            mixed = np.maximum.reduceat(ids != lead, start)
            out_key, out_id = [], []
            if last is not None and key[0] == last:  # the run goes on from the batch before
                mixed[0] |= split or bool((ids[: size[0]] != first).any())
                if mixed[0] and not split:
                    out_key.append(np.array([last]))
                    out_id.append(np.array([first]))
                head = first
            else:
                head = ids[0]
            keep = np.repeat(mixed, size)
            out_key.append(key[keep])
            out_id.append(ids[keep])
            split, last = bool(mixed[-1]), key[-1]
            first = head if len(start) == 1 else ids[start[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_id))], names=["key", "short"])

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, keys.schema).distinct()


def verify(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. known: id, items (sorted shingles as bytes)."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                b = batch.slice(at, 64)
                ok = []
                for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                    p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                        ok.append(False)
                        continue
                    inter = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                    ok.append(100 * inter >= percent * (len(p) + len(q) - inter))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = known.select(F.col("id").alias("a"), F.col("items").alias("x")), known.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return join_split(pairs.join(x, "a"), y, "b", pairs.groupBy("b").agg(F.count("*").alias("n"))).select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def forest(likely: list[np.ndarray], pairs: list[np.ndarray], part: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The likeliest pairs that join all parts which the pairs join, in one array each."""
    likely, pairs = np.concatenate(likely), np.concatenate(pairs)
    order = np.argsort(-likely, kind="stable")
    root, keep = list(range(int(part.max(initial=0)) + 1)), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in order.tolist():
        x, y = (top(int(part[k])) for k in pairs[at])
        if x != y:
            root[x] = y
            keep.append(at)
    return [likely[keep]], [pairs[keep]]


class Candidates:
    """The sets that share a bucket with a different one: needed (short, id), hubs (hub, id, first) and known (id and the set itself)."""

    def __init__(self, docs: DataFrame, made: DataFrame, scratch: Scratch, n: int, percent: int):
        self.bands, self.percent, self.scratch = Bands(percent), percent, scratch
        bands = self.bands
        bucket = scratch.save(shared(keyed(docs, n, bands)))
        names = made.where("n_shingles > 0").select("short", "id").distinct()
        self.needed = scratch.save(names.join(bucket.select("short").distinct(), "short"))
        self.hubs = scratch.save(self.ranked(bucket, "short").join(self.needed, "short").select("hub", "id", "first"))
        scratch.drop(bucket)
        ids = self.needed.select("id")
        one = made.join(ids, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
        rows = made.where("doc_id is not null").groupBy("doc_id").agg((F.count("*") == 1).alias("sole"))
        one = scratch.save(one.join(rows.hint("merge"), "doc_id", "left").select("doc_id", "id", "sole"))

        def items(batches):
            for b in blocks(batches):
                own = sets(b.column("text"), n)
                band = [bands.band(len(x)) for x in own]
                low = [bands.sketch(x, k - 1).tobytes() if k > 0 else None for x, k in zip(own, band, strict=True)]
                high = [bands.sketch(x, k).tobytes() if k >= 0 else None for x, k in zip(own, band, strict=True)]
                cols = [pa.array([set_id(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64()), pa.array(band, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "items", "size", "band", "low", "high"])

        # a doc_id of one row tells whose set it is; rows that share one may have different sets, so each row's own set tells there, and
        # a set may have no doc_id (merged at every size: a list that is broadcast while it is short would hide what a long one costs)
        schema = "id binary, items binary, size bigint, band int, low binary, high binary"
        named = docs.join(one.where("sole").select("doc_id").hint("merge"), "doc_id", "left_semi").select("text")
        unsure = docs.join(one.where("not sole").select("doc_id").distinct(), "doc_id", "left_semi").select("text").union(docs.where("doc_id is null").select("text"))
        unsure = unsure.mapInArrow(items, schema).join(one.where("sole is null or not sole").select("id"), "id", "left_semi").dropDuplicates(["id"])
        self.known = scratch.save(named.mapInArrow(items, schema).union(unsure))
        scratch.drop(one)

    def links(self) -> DataFrame:
        """Rows (node, component) of all needed sets by id; one without a link to a different set is its own.

        Each step has only pairs of sets that the steps before left in different components, and joins only these components.
        """
        save, drop = self.scratch.save, self.scratch.drop
        labels = save(self.needed.select(F.col("id").alias("node"), F.col("id").alias("component")))
        large = self.large()
        for step in (self.highest, self.others, *[self.likely] * FORESTS, self.left):
            tested = step(labels, large)
            if tested is None:
                continue
            tested = save(tested)
            new = self.merged(labels, self.verified(tested))
            drop(tested)
            drop(labels)
            labels = new
        return labels

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked. Only the sets that they name are joined with them."""
        named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        some = self.scratch.save(self.known.select("id", "items").join(named, "id", "left_semi"))
        links = self.scratch.save(verify(pairs, some, self.percent))
        self.scratch.drop(some)
        return links

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be linked by their sketches, which take an eighth of the room of the sets and rule out no linked pair."""
        bands = self.bands

        def run(batches):
            for batch in batches:
                ok = []
                for at in range(0, len(batch), 256):
                    b = batch.slice(at, 256)
                    c = {k: b.column(k).to_pylist() for k in ("x", "y")}
                    for x, y in zip(c["x"], c["y"], strict=True):
                        x, y = sorted((x, y), key=lambda s: s["band"])
                        if x["band"] < 0 or y["band"] > x["band"] + 1:
                            ok.append(False)
                            continue
                        p, q = np.frombuffer(x["high"], np.uint8), np.frombuffer(y["high" if x["band"] == y["band"] else "low"], np.uint8)
                        ok.append(int((p != q).sum()) <= bands.difference(x["size"] + y["size"]))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        x, y = (self.known.select(F.col("id").alias(k), F.struct("size", "band", "low", "high").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return join_split(pairs.join(x, "a"), y, "b", pairs.groupBy("b").agg(F.count("*").alias("n"))).select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")

    def merged(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """labels (node, component) with the components of links (a, b) made one."""
        a, b = (labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
        between = join_split(links.join(a, "a"), b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        further = components(between, self.scratch).select(F.col("node").alias("old"), F.col("component").alias("new"))
        own = labels.select("component").distinct()
        all_of = own.join(further, own.component == further.old, "left").select("component", F.coalesce("new", "component").alias("further"))
        return self.scratch.save(join_split(labels, all_of, "component").select("node", F.col("further").alias("component")))

    def pairs(self) -> DataFrame:
        """Rows (a, b), a < b: every two different sets that are linked."""
        alone = self.hubs.select("hub", "id", F.col("id").alias("component"))
        return self.verified(self.scratch.save(self.in_tiles(alone)))

    def ranked(self, bucket: DataFrame, member: str) -> DataFrame:
        """Rows (hub, member, first) of a table of buckets (key, member).

        Members are ordered by companions and then by a hash, in one number; hub is the bucket's largest, and first tells
        whether the row is the member that has it.
        """
        stats = self.scratch.save(bucket.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        sized = join_split(bucket, stats.withColumnRenamed("n", "size"), "key", stats)
        rank = F.least(F.sum("size"), F.lit((1 << 20) - 1)) * F.lit(1 << 42) + F.pmod(F.xxhash64(member), F.lit(1 << 42))
        own = self.scratch.save(bucket.join(sized.groupBy(member).agg(rank.alias("rank")), member))
        top = own.groupBy("key").agg(F.max("rank").alias("hub"))
        out = self.scratch.save(join_split(own, top, "key", stats).select("hub", member, (F.col("rank") == F.col("hub")).alias("first")).distinct())
        self.scratch.drop(own)
        return out

    def large(self) -> DataFrame:
        """Rows (a, b, hub): the sets of each large hub with its first in rank."""
        many = self.hubs.groupBy("hub").agg(F.count("*").alias("n"), F.min(F.when(F.col("first"), F.col("id"))).alias("b")).where(F.col("n") > LARGE)
        many = self.scratch.save(many)
        pivots = join_split(self.hubs, many.select("hub", "b"), "hub", many.select("hub", "n")).where("id <> b")
        return self.scratch.save(pivots.select(F.col("id").alias("a"), "b", "hub"))

    def highest(self, labels: DataFrame, large: DataFrame) -> DataFrame:
        """Pairs (a, b): each set with the first of one hub, the highest. Most of what the other hubs would link is linked by these."""
        return self.alike(self.scratch.save(large.groupBy("a").agg(F.max_by("b", "hub").alias("b"))))

    def others(self, labels: DataFrame, large: DataFrame) -> DataFrame:
        """Pairs (a, b): the sets with the firsts of all their large hubs, where they are still apart."""
        a, b = (labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
        return self.alike(self.scratch.save(join_split(large.select("a", "b").distinct().join(a, "a"), b, "b").where("of_a <> of_b").select("a", "b")))

    def likely(self, labels: DataFrame, large: DataFrame) -> DataFrame | None:
        """Pairs (a, b) that would join the components of hubs that have many."""
        rest = self.hubs.join(labels, self.hubs.id == labels.node)
        many = rest.groupBy("hub").agg(F.count("*").alias("n"), F.countDistinct("component").alias("different")).where(F.col("different") > LARGE)
        many = self.scratch.save(many.select("hub", "n"))
        if not many.limit(1).count():
            return None
        return self.in_tiles(self.scratch.save(join_split(rest.select("hub", "id", "component"), many.select("hub"), "hub", many)), True)

    def left(self, labels: DataFrame, large: DataFrame) -> DataFrame:
        """All pairs (a, b) that are still apart."""
        return self.in_tiles(self.scratch.save(self.hubs.join(labels, self.hubs.id == labels.node).select("hub", "id", "component")))

    def parts(self, rows: DataFrame) -> DataFrame:
        """Rows (hub, n, most, comps) of hubs with more than one component: members, those of the largest component, and the components
        that fill tiles of their own, with the number of tiles."""
        each = rows.groupBy("hub", "component").agg(F.count("*").alias("n"))
        tiles = F.when(F.col("n") >= TILE, F.struct("component", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
        small = F.coalesce(F.sum(F.when(F.col("n") < TILE, F.col("n"))), F.lit(0)).alias("small")
        got = each.groupBy("hub").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("different"), small, F.collect_list(tiles).alias("comps"))
        return self.scratch.save(got.where("different > 1").drop("different"))

    def cut(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows (hub, id, component) and their parts, with crowded hubs cut by the segments of another hash."""
        done = done_parts = None
        for step in range(CUTS + 1):
            parts = self.parts(rows)
            crowd = parts.where(F.col("n") - F.col("most") > CROWD)
            if step == CUTS or not crowd.limit(1).count():
                break
            small = parts.where(F.col("n") - F.col("most") <= CROWD)
            kept = rows.join(small.select("hub"), "hub", "left_semi")
            done, done_parts = (kept, small) if done is None else (done.union(kept), done_parts.union(small))
            large = self.scratch.save(join_split(rows, crowd.select("hub"), "hub", crowd.select("hub", "n")))
            again = self.ranked(self.scratch.save(self.anew(large, step + 1)), "id")
            rows = self.scratch.save(again.join(large.select("id", "component").distinct(), "id").select("hub", "id", "component"))
        return (rows, parts) if done is None else (self.scratch.save(done.union(rows)), self.scratch.save(done_parts.union(parts)))

    def anew(self, large: DataFrame, step: int) -> DataFrame:
        """Rows (key, id): the sets of each hub by the segments of a hash that step chooses."""
        bands, salt = self.bands, U64(0x9E3779B97F4A7C15 * step & 0xFFFFFFFFFFFFFFFF)

        def run(batches):
            for b in batches:
                for i, hub, items in zip(b.column("id"), b.column("hub").to_pylist(), b.column("items").to_pylist(), strict=True):
                    k = bands.keys(np.sort(mix(np.frombuffer(items, U64) ^ salt)))
                    key = mix(k.astype(U64) ^ mix(np.array([hub], np.int64).astype(U64))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.repeat(i, len(key))], names=["key", "id"])

        return large.select("hub", "id").join(self.known.select("id", "items"), "id").mapInArrow(run, "key bigint, id binary").distinct()

    def in_tiles(self, members: DataFrame, few: bool = False) -> DataFrame:
        """Pairs (a, b) of sets that share a hub, are in different components and may be linked.

        Hubs are cut into tiles of about ``TILE`` sets; a component that fills tiles has its own, which are not compared with each
        other. Each pair of tiles is compared within one task by sketches, which rule out no linked pair; only what is left
        leaves the task; with ``few`` only the likeliest pairs that join the components of a pair of tiles, as many as these less one.
        """
        bands = self.bands
        rows, parts = self.cut(members)
        pool = F.ceil(F.col("small") / TILE).cast("int")
        placed = join_split(rows, parts.select("hub", pool.alias("pool"), "comps"), "hub", parts.select("hub", "n"))
        mine = F.filter("comps", lambda c: c["component"] == F.col("component"))
        placed = placed.withColumn("own", F.coalesce(F.try_element_at(mine, F.lit(1))["tiles"], F.lit(0)))
        none = F.lit(None).cast("binary")

        def tiles(owner, count):
            return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)), lambda k: F.xxhash64(owner, k))

        others = F.flatten(F.transform(F.filter("comps", lambda c: c["component"] != F.col("component")), lambda c: tiles(c["component"], c["tiles"])))
        place = F.pmod(F.xxhash64("id", F.lit("tile")), F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("pool"))).cast("int")
        placed = placed.withColumn("tile", F.xxhash64(F.when(F.col("own") > 0, F.col("component")), place))
        spread = placed.withColumn("other", F.explode(F.concat(F.coalesce(tiles(none, F.col("pool")), F.array().cast("array<bigint>")), others)))
        spread = spread.select("hub", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "component")

        def compare(t: pa.Table) -> pa.Table:
            ids, names = t["id"].to_pylist(), {}
            part = np.array([names.setdefault(c, len(names)) for c in t["component"].to_pylist()])
            order = np.argsort(np.argsort(np.array(ids, object)))
            tile, size, band = (t[c].to_numpy() for c in ("tile", "size", "band"))
            low, high = t["low"].to_pylist(), t["high"].to_pylist()
            crossed = t["i"][0].as_py() != t["j"][0].as_py()
            a, b, likely, held = [], [], [], []
            for group in np.unique(band[band >= 0]):
                left, right = np.flatnonzero(band == group), np.flatnonzero((band == group) | (band == group + 1))
                own = np.stack([np.frombuffer(high[k] if band[k] == group else low[k], np.uint8) for k in right])
                for k in left:
                    equal = (own == np.frombuffer(high[k], np.uint8)).sum(1)
                    ok = (equal >= own.shape[1] - bands.num * (size[right] + size[k]) // bands.den) & (part[right] != part[k])
                    ok &= (band[right] != group) | (order[right] > order[k])
                    if crossed:
                        ok &= tile[right] != tile[k]
                    if few:
                        likely.append(equal[ok] / own.shape[1])
                        held.append(np.stack([np.full(ok.sum(), k), right[ok]], axis=1))
                        if sum(map(len, likely)) > 1 << 20:
                            likely, held = forest(likely, held, part)
                        continue
                    for x in right[ok]:
                        p, q = (k, x) if order[k] < order[x] else (x, k)
                        a.append(ids[p])
                        b.append(ids[q])
            for k, x in forest(likely, held, part)[1][0].tolist() if held else ():
                p, q = (k, x) if order[k] < order[x] else (x, k)
                a.append(ids[p])
                b.append(ids[q])
            return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        near = spread.join(self.known.select("id", "size", "band", "low", "high"), "id").groupBy("hub", "i", "j").applyInArrow(compare, "a binary, b binary")
        return near.distinct()


def members(docs: DataFrame, n: int, percent: int, scratch: Scratch | None = None) -> DataFrame:
    """Rows (doc_id, id, n_shingles, component_id, component), one for each of docs; id: its set. component names what it is in, also
    where no member has a doc_id; it is null without shingles."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    made = scratch.save(classes(docs, n))
    # a class is named by its set; its component by the smallest doc_id in it
    labels = Candidates(docs, made, scratch, n, percent).links()
    full = made.where("n_shingles > 0")
    by_class = full.groupBy("id").agg(F.min("doc_id").alias("least"))
    grouped = by_class.join(labels, by_class.id == labels.node, "left").select("id", "least", F.coalesce("component", "id").alias("component"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = grouped.join(named, "component").select("id", "component_id", "component")
    out = full.join(by_class, "id").select("doc_id", "id", "n_shingles", "component_id", "component")
    return out.union(made.where("n_shingles = 0").select("doc_id", "id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary")))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for docs (doc_id, text)."""
    return members(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def pairs(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links between different sets as rows (a, b), and the members of each set as rows (id, doc_id)."""
    scratch = Scratch(docs.sparkSession, "pairs")
    made = scratch.save(classes(docs, n))
    return Candidates(docs, made, scratch, n, percent).pairs(), made.where("n_shingles > 0").select("id", "doc_id")


def with_sets(rows: DataFrame, n: int) -> DataFrame:
    """rows (_doc, _text, _row) with each row's set and its size, _id and _size, in place of the text."""

    def run(batches):
        for b in blocks(batches, "_text"):
            own = sets(b.column("_text"), n)
            yield pa.RecordBatch.from_arrays([b.column("_doc"), b.column("_row"), pa.array([set_id(x) for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())], names=["_doc", "_row", "_id", "_size"])

    schema = T.StructType([rows.schema["_doc"], rows.schema["_row"]]).add("_id", "binary").add("_size", "long")
    return rows.select("_doc", "_row", "_text").mapInArrow(run, schema)


def firsts(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of docs without those that are linked with one of a smaller doc_id; of equal ones the least row.

    A doc_id that several rows share, or none, does not tell which row is meant: there the set decides too.
    """
    scratch, inner = Scratch(docs.sparkSession, "firsts"), Scratch(docs.sparkSession, "jaccard")
    found = scratch.save(members(docs.select("doc_id", "text"), n, percent, inner))
    inner.clear()
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    best = found.where("n_shingles > 0").groupBy("component").agg(F.min(place).alias("best")).select(F.col("best.id").alias("_id"), F.col("best.doc_id").alias("_best"))
    many = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("n_shingles") > 0) & (F.coalesce("component_id", F.lit(-1)) != F.col("doc_id"))).alias("goes")).where("doc_id is not null")
    sure = docs.join(many.where("n > 1 or goes").select("doc_id").hint("merge"), "doc_id", "left_anti").where("doc_id is not null").select(*docs.columns)
    unsure = docs.join(many.where("n > 1").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    unsure = scratch.save(with_sets(unsure.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row")), n))
    kept = unsure.where("_size > 0").join(best, "_id").where(F.col("_doc").eqNullSafe(F.col("_best")))
    kept = kept.groupBy("_doc", "_id").agg(F.min("_row").alias("_row")).select("_row.*")
    return sure.union(kept).union(unsure.where("_size = 0").select("_row.*"))


def oracle(n: int, percent: int) -> str:
    sequence = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ') ELSE {sequence} END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * i >= {percent} * (p.n + q.n - i)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)"""
