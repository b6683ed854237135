"""Prefix trie of conversations by ternary search trees per range shard (op 12).

Turns (role, text) get the numbers of a dictionary of their distinct values, so sequences are arrays of
numbers. Equal sequences are one weighted item. Items are sorted and dealt by range into shards of about
``SHARD`` numbers; a shard inserts its items median first into a ternary search tree, walks it with a stack and sums
members, leaves and savings from the deepest nodes up. Of a shard's nodes only the prefixes of its first
and last item can occur in another shard. These boundary nodes are merged by a digest of their prefix; what
only they know (whether they are leaves, their savings) goes up once more along the boundary paths of one
shard per node.

A sequence is cut into blocks of ``BLOCK`` turns, so that no row holds an unbounded list: a block is an
item under the digest of all before it, and levels of blocks are solved from the last to the first, the
root of a level being a node of the level before. All but conversations of more than ``BLOCK`` turns need
one level.

Null conv_id: such rows are no conversation and take no part. Null role or text: empty. Null turns come first;
turns of a conversation that tie are ordered by the digest of (role, text). Repeated rows are turns of their own. Texts
of any length count only by digest and length. Negative conv_ids: ``c % 100`` as in SQL (sign of c). An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.llm import common as C

BLOCK = 4096
SHARD = 1 << 17
RUN = 1 << 16  # ids in one piece of a node's list
HEADS = 6  # a conversation starts with fewer turns than this of its hundred's first


def _numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, id, chars`` per turn: its place in the conversation and its number in the dictionary."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    turns = C.stored(turns.filter("conv_id is not null"), "trie-turns")
    names = turns.groupBy("digest").agg(F.first("chars").alias("chars")).withColumn("id", F.monotonically_increasing_id())
    names = C.stored(names, "trie-dictionary")
    turns = turns.drop("chars").join(names, "digest")
    # A conversation may span partitions: its places are local ranks after the counts of the partitions before.
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "id"]
    turns = turns.repartitionByRange(*order).withColumn("p", F.spark_partition_id())
    turns = C.stored(turns, "trie-ranges")
    local = F.row_number().over(W.partitionBy("p", "conv_id").orderBy(*order[1:])) - 1
    before = turns.groupBy("p", "conv_id").agg(F.count("*").alias("n"))
    upto = W.partitionBy("conv_id").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("p", "conv_id", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("skip"))
    placed = turns.withColumn("local", local).join(before, ["p", "conv_id"])
    return placed.select("conv_id", (F.col("skip") + F.col("local")).alias("pos"), "id", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, id, chars`` of the rebuilt turns, and the ``conv_id`` of conversations without any."""
    turns = C.stored(_numbered(conversations), "trie-places")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % 100
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", base)
    convs = C.stored(convs, "trie-conversations")
    lengths = convs.select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEADS)).alias("base_n"))
    heads = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "id", "chars")
    heads = convs.select("conv_id", "base", "h").join(heads, "base").filter("pos < h").select("conv_id", "pos", "id", "chars")
    own = turns.withColumn("h", h).filter("pos >= h").withColumn("base", base).join(lengths, "base", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("base_n", F.lit(0)))).alias("pos"), "id", "chars")
    none = convs.join(lengths, "base", "left").filter("n <= h and least(h, coalesce(base_n, 0)) = 0").select("conv_id")
    return heads.unionByName(own), none


def _md5(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _chained(group):
    """Digests before and after each block of one conversation."""
    import pyarrow as pa

    group = group.sort_by("block")
    before, after, at = [], [], b""
    for d in group.column("d").to_pylist():
        before.append(at)
        at = hashlib.md5(at + d).digest()
        after.append(at)
    out = group.select(["conv_id", "block"])
    return out.append_column("top", pa.array(before, pa.binary())).append_column("item", pa.array(after, pa.binary()))


def _blocks(turns: DataFrame, none: DataFrame, block: int) -> DataFrame:
    """``conv_id, block, ids, chars, top, item, last``: the blocks of every conversation with the digests around them."""
    rows = turns.groupBy("conv_id", F.floor(F.col("pos") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("t"))
    rows = rows.select("conv_id", "block", F.col("t.id").alias("ids"), F.col("t.chars").alias("chars"))
    void = F.array().cast("array<bigint>")
    rows = rows.unionByName(none.select("conv_id", F.lit(0).cast("long").alias("block"), void.alias("ids"), void.alias("chars")))
    rows = C.stored(rows.withColumn("d", _md5(F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))))), "trie-blocks")
    ends = rows.groupBy("conv_id").agg(F.max("block").alias("end"))
    long = ends.filter("end > 0").select("conv_id")
    empty = F.lit(b"")
    first = rows.join(long, "conv_id", "left_anti").select("conv_id", "block", empty.alias("top"), F.unhex(F.md5("d")).alias("item"))
    rest = rows.join(long, "conv_id").select("conv_id", "block", "d").groupBy("conv_id").applyInArrow(_chained, "conv_id long, block long, top binary, item binary")
    chain = first.unionByName(rest).join(ends, "conv_id")
    return rows.drop("d").join(chain, ["conv_id", "block"]).withColumn("last", F.col("block") == F.col("end")).drop("end")


class TernaryTree:
    """A trie whose siblings form binary search trees; ``up`` is the trie parent, nodes follow their parents."""

    def __init__(self):
        self.symbol, self.low, self.high, self.equal, self.up = [], [], [], [], []
        self.top = -1

    def _new(self, symbol, up) -> int:
        self.symbol.append(symbol)
        self.up.append(up)
        for side in (self.low, self.high, self.equal):
            side.append(-1)
        return len(self.symbol) - 1

    def insert(self, sequence) -> int:
        """The node of the whole sequence."""
        up = -1
        for s in sequence:
            node = self.top if up < 0 else self.equal[up]
            if node < 0:
                node = self._new(s, up)
                if up < 0:
                    self.top = node
                else:
                    self.equal[up] = node
            else:
                while s != self.symbol[node]:
                    side = self.low if s < self.symbol[node] else self.high
                    if side[node] < 0:
                        side[node] = self._new(s, up)
                    node = side[node]
            up = node
        return up

    def walk(self):
        """Nodes with parents before children, by a stack."""
        stack = [self.top] if self.top >= 0 else []
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in (self.low[node], self.high[node], self.equal[node]) if x >= 0]


def medians(n: int):
    """Positions 0 to n - 1, the middle of each range before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += [(m + 1, b), (a, m)]


NODE = (
    "inner boolean, shard long, slot int, up_slot int, key binary, up_key binary, top binary, up_top binary, depth long, conv long, up_conv long, n long, "
    "children long, leaves long, saved long, chars long, item binary, ended boolean, more_children long, more_leaves long, more_saved long"
)


def solve(items: list[dict], shard: int, level: int, block: int) -> list[dict]:
    """The nodes of one shard of sorted items, inner ones complete, those on its boundary with what inner nodes add up to."""
    tree, tops, first_of = TernaryTree(), [], []
    for x in items:
        if not tops or tops[-1] != x["top"]:
            tops.append(x["top"])
        first_of.append(len(tops) - 1)
    ends = [0] * len(items)
    for m in medians(len(items)):
        ends[m] = tree.insert([first_of[m], *items[m]["ids"]])
    size = len(tree.symbol)
    chars, depth, own = [0] * size, [0] * size, [None] * size
    for x, end in zip(items, ends):
        own[end] = x
        node = end
        for c in reversed(x["chars"]):
            if chars[node] == c:  # ancestors have theirs too, unless all of them are empty
                if c:
                    break
            chars[node] = c
            node = tree.up[node]
    order = list(tree.walk())
    for v in order:
        depth[v] = depth[tree.up[v]] + 1 if tree.up[v] >= 0 else 0
    slots: dict[int, int] = {}
    for end in (ends[0], ends[-1]):
        path = [end]
        while tree.up[path[-1]] >= 0:
            path.append(tree.up[path[-1]])
        for v in reversed(path):
            slots.setdefault(v, len(slots))
    n, conv = [0] * size, [None] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for v in reversed(order):
        x, up = own[v], tree.up[v]
        if x is not None:
            n[v] += x["n"]
            conv[v] = x["conv"] if conv[v] is None else min(conv[v], x["conv"])
        if v not in slots:
            more = (x["more_children"], x["more_leaves"], x["more_saved"]) if x is not None else (0, 0, 0)
            leaves[v] += more[1] + (not children[v] and not more[0])
            children[v] += more[0]
            saved[v] += more[2] + (n[v] - 1) * chars[v]
        if up >= 0:
            n[up] += n[v]
            conv[up] = conv[v] if conv[up] is None else min(conv[up], conv[v])
            children[up] += v not in slots
            leaves[up] += leaves[v]
            saved[up] += saved[v]
    keys: dict[int, bytes] = {}
    for end in (ends[0], ends[-1]):
        path = [end]
        while tree.up[path[-1]] >= 0:
            path.append(tree.up[path[-1]])
        h = hashlib.md5(tops[tree.symbol[path[-1]]])
        for v in reversed(path):
            if depth[v]:
                h.update(tree.symbol[v].to_bytes(8, "little", signed=True))
            keys[v] = h.copy().digest()
    out = []
    for v in order:
        up, x = tree.up[v], own[v]
        on_edge, up_edge = v in slots, up in slots
        root_of = tops[tree.symbol[v]] if not depth[v] else None
        over = up if depth[v] == 1 else -1
        out.append(
            {
                "inner": not on_edge, "shard": shard, "slot": slots.get(v, -1), "up_slot": slots.get(up, -1), "key": keys.get(v), "up_key": keys.get(up), "top": root_of,
                "up_top": tops[tree.symbol[over]] if over >= 0 and level else None, "depth": level * block + depth[v], "conv": conv[v],
                "up_conv": conv[up] if up >= 0 and not up_edge else None, "n": n[v], "children": children[v], "leaves": leaves[v], "saved": saved[v], "chars": chars[v],
                "item": x["item"] if x else None, "ended": bool(x and x["ended"]),
                **{k: x[k] if x else 0 for k in ("more_children", "more_leaves", "more_saved")},
            }
        )
    return out


def _solved(level: int, block: int, most: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = [f.split()[0] for f in NODE.split(", ")]
        kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        types = [kinds[f.split()[1]] for f in NODE.split(", ")]
        shard = TaskContext.get().partitionId() << 32

        def made(items):
            rows = solve(items, shard, level, block)
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in zip(names, types)], names)

        items, held = [], 0
        for batch in batches:
            for x in batch.to_pylist():
                items.append(x)
                held += len(x["ids"]) + 1
                if held >= most:
                    yield from made(items)
                    items, held, shard = [], 0, shard + 1
        if items:
            yield from made(items)

    return run


def _up_paths(group):
    """Per boundary node of one shard: the sums of ``leaves, saved`` over the boundary nodes at and below it."""
    import pyarrow as pa

    group = group.sort_by("slot")
    up, key = group.column("up_slot").to_pylist(), group.column("key").to_pylist()
    leaves, saved = group.column("leaves").to_pylist(), group.column("saved").to_pylist()
    for i in range(len(up) - 1, 0, -1):
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    return pa.table({"key": pa.array(key, pa.binary()), "add_leaves": pa.array(leaves, pa.int64()), "add_saved": pa.array(saved, pa.int64())})


RESULT = ["item", "ended", "up_top", "conv", "up_conv", "depth", "n", "children", "leaves", "saved"]


def _level(items: DataFrame, level: int, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of a level, and what its roots hold (``item, more_children, more_leaves, more_saved``)."""
    order = ["top", "ids"]
    found = items.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_solved(level, block, most), NODE)
    found = C.stored(found, "trie-shards")
    edge = found.filter("not inner")
    both = edge.groupBy("key").agg(
        *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved", "more_children", "more_leaves", "more_saved")),
        *(F.max(c).alias(c) for c in ("up_key", "top", "up_top", "depth", "chars", "item", "ended")),
        F.min("conv").alias("conv"), F.min("shard").alias("owner"),
    )
    both = C.stored(both, "trie-edge")
    kids = both.groupBy(F.col("up_key").alias("key")).agg(F.count("*").alias("kids")).filter("key is not null")
    whole = both.join(kids, "key", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)) + F.col("more_children"))
    whole = whole.withColumn("own_leaves", F.col("more_leaves") + F.when(F.col("children") == 0, 1).otherwise(0))
    whole = C.stored(whole.withColumn("own_saved", F.col("more_saved") + (F.col("n") - 1) * F.col("chars")).drop("kids"), "trie-edge")
    # Each boundary node goes up the paths of one shard that has it, and so has all its prefixes.
    mine = whole.select(F.col("owner").alias("shard"), "key", "own_leaves", "own_saved")
    paths = edge.select("shard", "slot", "up_slot", "key").join(mine, ["shard", "key"], "left")
    paths = paths.select("shard", "slot", "up_slot", "key", F.coalesce("own_leaves", F.lit(0)).cast("long").alias("leaves"), F.coalesce("own_saved", F.lit(0)).cast("long").alias("saved"))
    sums = paths.groupBy("shard").applyInArrow(_up_paths, "key binary, add_leaves long, add_saved long")
    sums = sums.groupBy("key").agg(F.sum("add_leaves").alias("add_leaves"), F.sum("add_saved").alias("add_saved"))
    whole = whole.join(sums, "key").withColumn("leaves", F.col("leaves") + F.col("add_leaves")).withColumn("saved", F.col("saved") + F.col("add_saved"))
    whole = C.stored(whole, "trie-edge")
    over = whole.select(F.col("key").alias("up_key"), F.col("conv").alias("up_conv"))
    outer = whole.join(over, "up_key", "left")
    at = edge.select("shard", F.col("slot").alias("up_slot"), "key").join(whole.select("key", F.col("conv").alias("edge_conv")), "key").drop("key")
    inner = found.filter("inner").join(at, ["shard", "up_slot"], "left").withColumn("up_conv", F.coalesce("up_conv", "edge_conv"))
    nodes = inner.select("top", *RESULT).unionByName(outer.select("top", *RESULT))
    nodes = C.stored(nodes, "trie-nodes")
    roots = nodes.filter("top is not null").select(F.col("top").alias("item"), F.col("children").alias("more_children"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    return nodes.filter("top is null" if level else "true").drop("top"), roots


def _runs(batches):
    """Joined decimal ids of sorted (item, conv_id) rows, in pieces of at most ``RUN`` ids."""
    import pyarrow as pa

    for batch in batches:
        item, conv = batch.column("item").to_pylist(), batch.column("conv_id").to_pylist()
        cut = [0, *(i for i in range(1, len(item)) if item[i] != item[i - 1] or not i % RUN), len(item)]
        cut = [(a, b) for a, b in zip(cut[:-1], cut[1:]) if a < b]
        yield pa.RecordBatch.from_arrays(
            [pa.array([item[a] for a, _ in cut], pa.binary()), pa.array([conv[a] for a, _ in cut], pa.int64()), pa.array([",".join(map(str, conv[a:b])) for a, b in cut])], ["item", "first", "piece"]
        )


def _hashed(batches):
    """SHA-256 of the pieces of each item, which come in order; only the running hash is held."""
    import pyarrow as pa

    at, h = None, None
    for batch in batches:
        keys, hashes = [], []
        for item, piece in zip(batch.column("item").to_pylist(), batch.column("piece").to_pylist()):
            if item != at:
                if h is not None:
                    keys.append(at)
                    hashes.append(h.hexdigest())
                at, h = item, hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["item", "ends_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()])], ["item", "ends_sha256"])


def prefix_nodes(conversations: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows = C.stored(_blocks(*rebuilt(conversations), block), "trie-items")
    items = rows.groupBy("block", "item").agg(
        F.first("top").alias("top"), F.first("ids").alias("ids"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.max("last").alias("ended")
    )
    items = C.stored(items, "trie-distinct")
    deepest = items.agg(F.max("block")).first()[0]
    nodes, roots = None, None
    for level in range(int(deepest) if deepest is not None else 0, -1, -1):
        at = items.filter(F.col("block") == level)
        if roots is None:
            at = at.withColumns({c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")})
        else:
            at = at.join(roots, "item", "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
        found, roots = _level(at.select("top", "ids", "chars", "item", "n", "conv", "ended", "more_children", "more_leaves", "more_saved"), level, block, shard)
        nodes = found if nodes is None else nodes.unionByName(found)
    if deepest:
        # The parent of a level's first nodes is the node of the item before it.
        late = nodes.filter("up_top is not null")
        over = nodes.filter("item is not null").select(F.col("item").alias("up_top"), F.col("conv").alias("over"))
        late = late.join(over, "up_top").withColumn("up_conv", F.col("over")).drop("over")
        nodes = nodes.filter("up_top is null").unionByName(late)
    order = ["item", "conv_id"]
    ends = rows.filter("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "item binary, first long, piece string")
    ends = ends.repartition("item").sortWithinPartitions("item", "first").mapInArrow(_hashed, "item binary, ends_sha256 string")
    some = nodes.filter("ended").join(ends, "item").drop("up_top")
    rest = nodes.filter("not ended").drop("up_top").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return some.unionByName(rest).select(
        F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
