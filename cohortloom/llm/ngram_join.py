"""Exact Jaccard self-join of shingle sets by partition of the universe (op 11).

Two sets of sizes a, b that link differ in at most H = (100 - pct) (a + b) / (100 + pct) shingles. Sizes fall into
bands such that linked sets are in one band or in neighbours. In the group of a band and the next one a hash deals
all shingles into H + 1 segments (H the greatest of the group), so linked sets agree in a whole segment. Every set
publishes a signature per segment in both groups it belongs to; sets that share one are candidates.

Allocation by cost: a shared segment whose sets outside its largest class number over ``FEW`` (an empty segment, a line that
many texts hold) is not paired. A set with z such segments publishes one-deletion neighbourhoods instead: the
first R = 2 z + 2 segments as they are and without each of their shingles. Of the segments in which two linked sets
differ, at most z - 1 differ in more than one shingle, so the pair meets there if one of the two, the one with
the smaller R, has z segments among them whose signatures are all cheap. Sets for which even that fails are
compared in cells of bounded size within their dear segments, where exact bounds (sizes, shingles that no
other set there has, distance from a common pivot) leave few pairs to verify.

As every segment in which two sets differ holds a difference, a link of sizes a, b asks for more than one agreeing segment wherever
its own bound is less than the group's H: sets and pairs that agree in fewer are left out before any set is read.

Candidates are verified on their sets. Each set is first compared with the most central set that it
meets, then only sets of different components are. Equal sets are one node from the start. Most candidates are far
apart: parities of shingle hashes (2 to 4 bits per shingle), which differ in no more bits than the sets in shingles, leave these
out exactly, so that whole sets move for few pairs.

Shingles are hashes of words: 64 bits tell the shingles of one text apart, 48 of these bits compare two texts (odds of 1e-10 of
one false match in a pair of 300 shingles each). Equal sums of two mixes count as equal sets.
Null or wordless texts have an empty set and are linked with nothing: their own component. Null doc_id: a row
like another, its component has the least doc_id that is not null, null if there is none. Rows that repeat, also in doc_id
alone, each give a row. Very long texts are read whole, in tasks. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common as C
from cohortloom.llm.components import components
from cohortloom.llm.near_dedup import shingles

FEW = 16
CELL_FEW, CELL_ALL = 512, 2048
GOLD = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEPT = np.uint64((1 << 64) - (1 << 16))  # six of eight bytes of a hash
HUB = 1024  # sets compared with one copy of a set that many are compared with
MARKS = 1 << 25  # most bits that mark the nodes whose sets are kept: 4 MB
KEY = ["k1", "k2"]


class Bands:
    """Size bands and the greatest difference of linked sets in the group of each band with the next."""

    def __init__(self, pct: int):
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(edges[-1] * 100 // pct + 1)
        self.edges = np.array(edges, np.int64)
        top = self.edges[1:] - 1
        self.most = (100 - pct) * (top + top * 100 // pct) // (100 + pct)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of a chunk, in order."""
    row, item = shingles(LOWER[data], offsets, width)
    order = np.lexsort((item, row))
    row, item = row[order], item[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return row[new], item[new] & KEPT


def packed(row: np.ndarray, item: np.ndarray, rows: int):
    """The sets of rows as binaries of six bytes per shingle."""
    import pyarrow as pa

    at = np.searchsorted(row, np.arange(rows + 1)) * 6
    raw = np.ascontiguousarray(item.view(np.uint8).reshape(-1, 8)[:, 2:]).reshape(-1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def unpacked(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the shingles in a list of packed sets."""
    raw = np.frombuffer(b"".join(bags), np.uint8).reshape(-1, 6)
    item = np.zeros((len(raw), 8), np.uint8)
    item[:, 2:] = raw
    return np.repeat(np.arange(len(bags)), [len(b) // 6 for b in bags]), item.reshape(-1).view(np.uint64)


def nodes_of(row: np.ndarray, item: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the set of each row (a hash of the set) and its size."""
    n = np.bincount(row, minlength=rows)
    total = np.zeros(rows, np.uint64)
    np.add.at(total, row, C.mix(item * GOLD + np.uint64(3)))
    second = np.zeros(rows, np.uint64)
    np.bitwise_xor.at(second, row, C.mix(item + np.uint64(11)))
    return C.mix(C.mix(total + n.astype(np.uint64)) + second).view(np.int64), n


def segmented(row: np.ndarray, item: np.ndarray, group: np.ndarray, bands: Bands):
    """The segments of rows in a group each: ``at`` (first segment of each row, with an end), and per segment its value and size,
    per shingle its segment and weight. Rows in a group below 0, or without room for a difference, have none."""
    parts = np.where(group >= 0, bands.most[np.maximum(group, 0)] + 1, 0)
    parts[parts == 1] = 0
    at = np.concatenate([[0], np.cumsum(parts)])
    use = parts[row] > 0
    own, items = row[use], item[use]
    h = C.mix(items ^ C.mix(group[own].astype(np.uint64) + GOLD))
    seg = at[own] + (((h >> np.uint64(32)) * parts[own].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    weight = C.mix(h + np.uint64(5))
    value = np.zeros(at[-1], np.uint64)
    np.add.at(value, seg, weight)
    return at, value, seg, weight


def labelled(value: np.ndarray, row: np.ndarray, number: np.ndarray, group: np.ndarray, kind: int) -> np.ndarray:
    """Signatures: a hash of the kind, group, number of the segment and its value, with the group in the low seven bits."""
    place = C.mix((group[row].astype(np.uint64) << np.uint64(40)) + (number.astype(np.uint64) << np.uint64(2)) + np.uint64(kind))
    return ((C.mix(value + place * GOLD) & ~np.uint64(127)) | group[row].astype(np.uint64)).view(np.int64)


def equal_signatures(row, item, n, bands):
    """(row, number of the segment, signature, 0 or 1 for the group) of all whole segments of each row with a set."""
    out = []
    for step in (0, 1):
        group = np.where(n > 0, bands.of(np.maximum(n, 1)) - step, -1)
        at, value, _, _ = segmented(row, item, group, bands)
        own = np.repeat(np.arange(len(n)), np.diff(at))
        number = np.arange(len(value)) - at[own]
        out.append((own, number, labelled(value, own, number, group, 0), np.full(len(own), step)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sets(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, offsets in C.chunks(batch.column("text")):
                node, n = nodes_of(*sets_of(data, offsets, width), j - i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in KEY), pa.array(node), pa.array(n.astype(np.int64))], [*KEY, "node", "n"])

    return run


def _published(width: int, bands: Bands):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, offsets in C.chunks(batch.column("text")):
                row, item = sets_of(data, offsets, width)
                node, n = nodes_of(row, item, j - i)
                own, _, sig, _ = equal_signatures(row, item, n, bands)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node[own])], ["sig", "node"])

    return run


def _shared(batches, carry: tuple[str, ...] = ()):
    """Of rows sorted by (sig, node): each once, if its sig has another node. One row is held back between batches."""
    import pyarrow as pa

    names = ["sig", "node", *carry]
    held, tied = None, False
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        s, v = cols[:2]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
        cols = [x[new] for x in cols]
        s = cols[0]
        if not len(s):
            continue
        same = s[1:] == s[:-1]
        back, ahead = np.concatenate([[tied], same]), np.concatenate([same, [False]])
        keep = back | ahead
        tied, keep[-1] = bool(back[-1]), False
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], names)
        held = [x[-1:] for x in cols]
    if tied:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)


def meeting(published: DataFrame, name: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``sig, node, g`` of the signatures that several nodes publish; ``carry``: int columns that a signature fixes."""
    rows = published.select("sig", "node", *carry).repartition("sig").sortWithinPartitions("sig", "node")
    rows = rows.mapInArrow(lambda batches: _shared(batches, carry), ", ".join(["sig long, node long", *(f"{c} int" for c in carry)]))
    return C.stored(rows.withColumn("g", F.col("sig").bitwiseAND(F.lit(127)).cast("int")), name)


def sketched(row: np.ndarray, item: np.ndarray, rows: int):
    """Parity of the shingles of each row at each of a power of two of places (64, or twice the shingles, at least), as binaries."""
    import pyarrow as pa

    n = np.bincount(row, minlength=rows)
    bits = np.int64(64) << np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(bits)])
    place = at[row] + (C.mix(item + np.uint64(17)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(place, minlength=at[-1]) & 1).astype(bool), bitorder="little")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(at // 8), pa.py_buffer(raw)]).cast(pa.binary())


def folded(parity: int, bits: int, to: int) -> int:
    """The parities of fewer places; both numbers are powers of two."""
    while bits > to:
        bits //= 2
        parity = (parity >> bits) ^ (parity & ((1 << bits) - 1))
    return parity


def marks(nodes: DataFrame) -> np.ndarray:
    """Bits at the low parts of distinct nodes, in words: 16 per node, ``MARKS`` at most (then more other nodes are marked, too)."""
    bits = 64
    most = min(16 * nodes.count(), MARKS)
    while bits < most:
        bits *= 2
    at = nodes.select(F.col("node").bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("marks")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["marks"].to_numpy(np.int64).view(np.uint64)
    return out


def marked(node: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = node.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _bagged(width: int, words: np.ndarray):
    """The sets of the nodes that ``words`` mark."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, offsets in C.chunks(batch.column("text")):
                row, item = sets_of(data, offsets, width)
                node, n = nodes_of(row, item, j - i)
                has = (n > 0) & marked(node, words)
                use, rows = has[row], int(has.sum())
                row, item = (np.cumsum(has) - 1)[row[use]], item[use]
                yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(n[has].astype(np.int32)), packed(row, item, rows), sketched(row, item, rows)], ["node", "size", "bag", "sketch"])

    return run


def _likely(pct: int):
    """Pairs of a set and the hub of its group, which comes first in it, whose parities differ in as few bits as linked sets may in shingles."""

    def run(batches):
        import pyarrow as pa

        hub, own = None, None
        for batch in batches:
            a, b = [], []
            for node, h, leads, size, sketch in zip(*(batch.column(c).to_pylist() for c in ("node", "hub", "leads", "size", "sketch"))):
                bits, parity = 8 * len(sketch), int.from_bytes(sketch, "little")
                if leads:
                    hub, own = h, (size, bits, parity)
                elif h == hub:
                    to = min(bits, own[1])
                    apart = (folded(parity, bits, to) ^ folded(own[2], own[1], to)).bit_count()
                    if (100 + pct) * apart <= (100 - pct) * (size + own[0]):
                        a.append(node)
                        b.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _overlapped(batches):
    """Overlaps of sets with the hub of their group, which comes first in it; only its set is held."""
    import pyarrow as pa

    hub, own = None, None
    for batch in batches:
        a, b, sizes, both = [], [], [], []
        _, item = unpacked(batch.column("bag").to_pylist())
        at = 0
        for node, h, leads, size in zip(*(batch.column(c).to_pylist() for c in ("node", "hub", "leads", "size"))):
            mine = item[at : at + size]
            at += size
            if leads:
                hub, own = h, mine
            elif h == hub:
                a.append(node)
                b.append(h)
                sizes.append((size, len(own)))
                both.append(len(np.intersect1d(mine, own, assume_unique=True)))
        n = np.array(sizes, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(both, pa.int64())], ["a", "b", "na", "nb", "both"])


class Join:
    """The sets of one table, their nodes, and the comparisons made so far."""

    def __init__(self, docs: DataFrame, pct: int, width: int):
        self.pct, self.width, self.bands = pct, width, Bands(pct)
        self.keyed = C.text_keys(docs)
        self.sets = C.stored(self.keyed.mapInArrow(_sets(width), "k1 long, k2 long, node long, n long"), "join-sets")
        self.nodes = C.stored(self.sets.filter("n > 0").groupBy("node").agg(F.max("n").alias("n")), "join-nodes")
        self.bags = self.done = self.links = self.seen = None

    def asked(self, a: str, b: str):
        """Segments in which sets of sizes ``a`` and ``b`` in group ``g`` must agree to link: each other one differs in a shingle at least."""
        parts = F.get(F.array(*(F.lit(int(x) + 1) for x in self.bands.most)), F.col("g"))
        return parts - F.floor((100 - self.pct) * (F.expr(a) + F.expr(b)) / (100 + self.pct))

    def hopeful(self, members: DataFrame) -> DataFrame:
        """Members that share as many segments of a group as a link with a set of any fitting size asks for."""
        edge = F.get(F.array(*(F.lit(int(x)) for x in self.bands.edges[1:])), F.col("g"))
        shared = members.groupBy("node", "g").agg(F.count("*").alias("e")).join(self.nodes, "node")
        other = F.when(F.col("n") < edge, F.floor(F.col("n") * 100 / self.pct)).otherwise(edge - 1)
        shared = shared.withColumn("other", other).filter(F.col("e") >= self.asked("n", "other"))
        return C.stored(members.join(shared.select("node", "g"), ["node", "g"]), "join-hopeful")

    def hold(self, members: DataFrame) -> None:
        """Keep the sets of the nodes that meet another one; of the others, only the few that share a mark with these are dealt out."""
        met = C.stored(members.select("node").distinct(), "join-met")
        bags = self.keyed.select("text").mapInArrow(_bagged(self.width, marks(met)), "node long, size int, bag binary, sketch binary").dropDuplicates(["node"])
        self.bags = C.stored(bags.join(met, "node", "left_semi"), "join-bags")

    def facing(self, pairs: DataFrame, column: str) -> DataFrame:
        """``column`` of the sets of ``pairs`` (a, b): those who share b follow one copy of its row."""
        hubs = C.stored(pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / HUB).alias("parts")), "join-hubs")
        sides = pairs.select(F.col("a").alias("node"), F.col("b").alias("hub")).join(hubs, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.lit(False).alias("leads"))
        copies = hubs.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leads"))
        rows = self.bags.select("node", "size", column).join(sides.unionByName(copies), "node")
        return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("leads").desc())

    def compare(self, pairs: DataFrame, name: str, exact: bool = False) -> None:
        """Overlaps of the new ones of ``pairs`` (a, b) that may link, with ``exact`` of all not overlapped before; those that reach the bar become links."""
        pairs = pairs.filter("a <> b").select("a", "b", F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).dropDuplicates(["x", "y"])
        past = self.seen.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")) if exact else self.done
        if past is not None:
            pairs = pairs.join(past, ["x", "y"], "left_anti")
        pairs = C.stored(pairs.select("x", "y", "a", "b"), f"join-pairs-{name}")
        self.done = pairs.select("x", "y") if self.done is None else self.done.unionByName(pairs.select("x", "y"))
        if not exact:
            pairs = C.stored(self.facing(pairs, "sketch").mapInArrow(_likely(self.pct), "a long, b long"), f"join-likely-{name}")
            if self.seen is not None and pairs.isEmpty():
                return
        seen = C.stored(self.facing(pairs, "bag").mapInArrow(_overlapped, "a long, b long, na long, nb long, both long"), f"join-overlaps-{name}")
        found = seen.filter(100 * F.col("both") >= self.pct * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
        self.links = found if self.links is None else self.links.unionByName(found)
        self.seen = seen if self.seen is None else self.seen.unionByName(seen)

    def roots(self) -> DataFrame:
        return C.stored(components(self.links, "join-components"), "join-roots")

    def open(self, members: DataFrame, roots: DataFrame, name: str, unsure: DataFrame | None = None) -> DataFrame:
        """``sig, node, root, n, main, dear``: members of signatures that several components share. With nodes ``unsure`` (node, open)
        those of the signatures that one of them has, and ``open`` for these nodes."""
        rows = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if unsure is not None:
            rows = rows.join(unsure, "node", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        rows = C.stored(rows.join(self.nodes.select("node", "n"), "node"), f"join-rooted-{name}")
        part = rows.groupBy("sig", "root").agg(F.count("*").alias("m"), F.lit(True).alias("some") if unsure is None else F.max("open").alias("some"))
        part = part.groupBy("sig").agg(F.max_by("root", F.struct("m", "root")).alias("main"), (F.sum("m") - F.max("m")).alias("few"), F.sum("m").alias("members"), F.max("some").alias("some"))
        part = part.filter("few > 0 and some").drop("some")
        return C.stored(rows.join(part, "sig").withColumn("dear", F.col("few") > FEW), f"join-open-{name}")

    def fits(self, a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {self.pct} * greatest({a}, {b})"

    def cheap_pairs(self, rows: DataFrame, whole: bool) -> DataFrame:
        """Pairs of different components that share a cheap signature: at most ``FEW`` times its members. ``whole``: signatures of whole
        segments, of which a link asks for a number; each dear one that both sets have may be one of them."""
        dear = rows.filter("dear").groupBy("node", "g").agg(F.count("*").alias("z"))
        rows = rows.filter("not dear")
        if whole:
            rows = rows.join(dear, ["node", "g"], "left").withColumn("z", F.coalesce("z", F.lit(0)))
        else:
            rows = rows.withColumn("z", F.lit(0))
        few = rows.filter("root <> main").select("sig", "g", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("z").alias("za"))
        every = rows.select("sig", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("z").alias("zb"), "main")
        pairs = few.join(every, "sig").filter(f"ra <> rb and (rb = main or a > b) and {self.fits('na', 'nb')}")
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "g", (F.col("na") + F.col("nb")).alias("size"), F.least("za", "zb").alias("z"))
        if not whole:
            return pairs.select("a", "b")
        pairs = pairs.groupBy("a", "b", "g", "size", "z").agg(F.count("*").alias("c"))
        return pairs.filter(F.col("c") + F.col("z") >= self.asked("size", "0")).select("a", "b")


def leaders(members: DataFrame, join: Join) -> DataFrame:
    """``node, leader``: of the most central nodes (most meetings over all signatures) of a node's signatures the one that most of them
    have, if it fits in size and in as many segments as a link asks for. Only a first guess: pairs that it leaves out are met later."""
    sizes = C.stored(members.groupBy("sig").agg(F.count("*").alias("m")), "join-spread")
    central = members.join(sizes, "sig").groupBy("node").agg(F.sum("m").alias("near"))
    rows = C.stored(members.join(central, "node").join(join.nodes, "node"), "join-central")
    best = rows.groupBy("sig").agg(F.max(F.struct("near", "node", "n")).alias("best")).select("sig", "best.near", F.col("best.node").alias("leader"), F.col("best.n").alias("nl"))
    own = rows.drop("near").join(best, "sig").filter(join.fits("n", "nl")).groupBy("node", "leader", "g").agg(F.max("n").alias("n"), F.max("nl").alias("nl"), F.max("near").alias("near"), F.count("*").alias("c"))
    own = own.filter(F.col("c") >= join.asked("n", "nl")).groupBy("node").agg(F.max(F.struct("c", "near", "leader")).alias("best"))
    return C.stored(own.select("node", "best.leader"), "join-leaders")


def _deleted(bands: Bands):
    """One-deletion neighbourhoods of the first segments of nodes with dear signatures (``dear``: their list)."""

    def run(batches):
        import pyarrow as pa

        names = ["node", "g", "part", "sig", "z", "hot"]
        for whole_batch in batches:
            for first in range(0, len(whole_batch), 512):
                batch = whole_batch.slice(first, 512)
                node, dear = batch.column("node").to_numpy(zero_copy_only=False), batch.column("dear").to_pylist()
                row, item = unpacked(batch.column("bag").to_pylist())
                n = np.bincount(row, minlength=len(node))
                listed = np.array(sorted({s for d in dear for s in d}), np.int64)
                for step in (0, 1):
                    group = bands.of(n) - step
                    at, value, seg, weight = segmented(row, item, group, bands)
                    own = np.repeat(np.arange(len(node)), np.diff(at))
                    number = np.arange(len(value)) - at[own]
                    hot = np.isin(labelled(value, own, number, group, 0), listed)
                    z = np.bincount(own[hot], minlength=len(node))
                    use = (number < 2 * z[own] + 2) & (z[own] > 0)
                    whole = np.flatnonzero(use)
                    less = np.flatnonzero(use[seg]) if len(seg) else seg
                    at_seg = np.concatenate([whole, seg[less]])
                    left = np.concatenate([value[whole], value[seg[less]] - weight[less]])
                    sig = labelled(left, own[at_seg], number[at_seg], group, 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[own[at_seg]]), pa.array(group[own[at_seg]].astype(np.int32)), pa.array(number[at_seg].astype(np.int32)), pa.array(sig), pa.array(z[own[at_seg]].astype(np.int32)), pa.array(hot[at_seg])], names
                    )

    return run


def _itemised(batches):
    import pyarrow as pa

    for batch in batches:
        row, item = unpacked(batch.column("bag").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("node").to_numpy(zero_copy_only=False)[row]), pa.array(item.view(np.int64))], ["node", "item"])


def possible(few, every, pct: int) -> np.ndarray:
    """Index pairs of different components whose sets may link by sizes, own shingles and distances from one leader."""
    n, m, root, node = (every[c].to_numpy() for c in ("n", "alone", "root", "node"))
    leader, far, open_, main = (every[c].to_numpy() for c in ("leader", "far", "open", "main"))
    out = []
    for i in range(len(few)):
        a = few.iloc[i]
        need = pct * (a.n + n)  # (100 + pct) * overlap must reach this
        most = np.minimum(np.minimum(a.n, n), np.minimum(a.n - a.alone, n - m))
        apart = a.far + far - 2 * np.minimum(a.far - a.alone, far - m)
        most = np.where(leader == a.leader, np.minimum(most, (a.n + n - apart) // 2), most)
        ok = ((100 + pct) * most >= need) & (root != a.root) & (open_ | a.open) & ((root == main) | (node < a.node))
        j = np.flatnonzero(ok)
        out.append(np.column_stack([np.full(len(j), i), j]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _dear_pairs(rows: DataFrame, pct: int) -> DataFrame:
    """Pairs that the bounds leave in dear signatures, in cells of about ``CELL_FEW`` by ``CELL_ALL`` rows."""
    import pandas as pd

    rows = rows.withColumn("ci", F.ceil(F.col("few") / CELL_FEW)).withColumn("cj", F.ceil(F.col("members") / CELL_ALL))
    few = rows.filter("root <> main").withColumn("i", F.pmod(F.xxhash64("node"), "ci")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cj") - 1)))
    every = rows.withColumn("j", F.pmod(F.xxhash64("node"), "cj")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ci") - 1)))

    def cell(a, b):
        at = possible(a, b, pct)
        if len(at):
            # Each pair leaves only the cell of the first signature that both have.
            sig, mine, theirs = a.sig.iloc[0], [set(x) for x in a.sigs], [set(x) for x in b.sigs]
            at = at[[min(mine[i] & theirs[j]) == sig for i, j in at.tolist()]]
        return pd.DataFrame({"a": a.node.to_numpy()[at[:, 0]], "b": b.node.to_numpy()[at[:, 1]]})

    few, every = few.toDF(*few.columns), every.toDF(*every.columns)
    return few.groupBy("sig", "i", "j").cogroup(every.groupBy("sig", "i", "j")).applyInPandas(cell, "a long, b long")


def joined(docs: DataFrame, pct: int = 80, width: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sets`` (k1, k2, node, n per row), ``links`` (a, b: nodes found to link) and ``roots`` (node, root for nodes with links)."""
    join = Join(docs, pct, width)
    members = meeting(join.keyed.mapInArrow(_published(width, join.bands), "sig long, node long"), "join-members")
    members = join.hopeful(members)
    join.hold(members)
    lead = leaders(members, join)
    join.compare(lead.select(F.col("node").alias("a"), F.col("leader").alias("b")), "leader")
    roots = join.roots()
    rows = join.open(members, roots, "equal")
    join.compare(join.cheap_pairs(rows, True), "cheap")
    dear = rows.filter("dear")
    if not dear.isEmpty():
        roots = join.roots()
        lists = dear.groupBy("node").agg(F.collect_list("sig").alias("dear"))
        less = join.bags.select("node", "bag").join(C.stored(lists, "join-dear"), "node").mapInArrow(_deleted(join.bands), "node long, g int, part int, sig long, z int, hot boolean")
        less = C.stored(less, "join-deletions")
        near = join.open(meeting(less, "join-near", ("part",)), roots, "deleted")
        join.compare(join.cheap_pairs(near, False), "deleted")
        # All nodes of a dear signature are in ``near``, and a signature belongs to one segment.
        bad = near.filter("dear").select("node", "g", "part").distinct().withColumn("bad", F.lit(True))
        parts = less.groupBy("node", "g", "part").agg(F.max("z").alias("z"), F.max("hot").alias("hot")).join(bad, ["node", "g", "part"], "left")
        good = parts.groupBy("node", "g").agg(F.max("z").alias("z"), F.count(F.when(~F.col("hot") & F.col("bad").isNull(), 1)).alias("good"))
        unsure = C.stored(good.filter("good < z").select("node").distinct().withColumn("open", F.lit(True)), "join-unsure")
        if not unsure.isEmpty():
            roots = join.roots()
            rest = join.open(dear.select("sig", "node", "g"), roots, "rest", unsure)
            # Distances from a pivot: the node with most signatures here, of those that a node meets.
            degree = rest.groupBy("node").agg(F.count("*").alias("d"))
            pivots = rest.join(degree, "node").groupBy("sig").agg(F.max(F.struct("d", "node")).alias("p"))
            pivots = rest.join(pivots, "sig").groupBy("node").agg(F.max("p").alias("p")).select("node", F.col("p.node").alias("leader"))
            pivots = C.stored(pivots, "join-pivots")
            join.compare(pivots.select(F.col("node").alias("a"), F.col("leader").alias("b")), "pivot", exact=True)
            far = join.seen.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"), (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("far"))
            far = pivots.select("node", "leader", F.greatest("node", "leader").alias("x"), F.least("node", "leader").alias("y")).join(far, ["x", "y"], "left")
            far = C.stored(far.select("node", "leader", F.coalesce("far", F.lit(0)).alias("far")), "join-far")
            ids = far.select("node").union(far.select("leader")).distinct()
            items = C.stored(join.bags.select("node", "bag").join(ids, "node").mapInArrow(_itemised, "node long, item long"), "join-items")
            alone = items.groupBy("item").agg(F.min("node").alias("node"), F.count("*").alias("c")).filter("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
            rest = rest.join(rest.groupBy("node").agg(F.collect_list("sig").alias("sigs")), "node")  # as many as a set has segments
            rest = rest.join(far, "node").join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
            join.compare(_dear_pairs(C.stored(rest, "join-cells"), pct), "dear")
    return join.sets, join.links, join.roots()


def ngram_join(docs: DataFrame, pct: int = 80, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, links``: ``links`` counts the verified links of the row's set to other sets, those within one
    component only as far as they were needed to join it."""
    sets, links, roots = joined(docs, pct, width)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    void = F.col("k1") == -(1 << 63)
    own = sets.filter("n > 0").groupBy("node").agg(F.min(F.struct(void.alias("void"), "k1")).alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = C.stored(own, "join-own")
    least = own.groupBy("root").agg(F.min("least").alias("least"))
    own = own.select("node", "root").join(least, "root").join(degree, "node", "left").select("node", F.col("least.k1").alias("lead"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    some = sets.filter("n > 0").join(own, "node").select("k1", "n", "lead", "links")
    none = sets.filter("n = 0").select("k1", "n", F.col("k1").alias("lead"), F.lit(0).cast("long").alias("links"))
    out = some.unionByName(none)
    return out.select(C.doc_id_of(F.col("k1")).alias("doc_id"), F.col("n").alias("n_shingles"), C.doc_id_of(F.col("lead")).alias("component_id"), "links")
