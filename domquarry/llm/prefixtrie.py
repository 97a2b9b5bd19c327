"""Prefix trie of conversations, by union-find over the prefixes that sorted neighbours share.

Conversations are rebuilt (each takes the first turns of the first of its five), their
turns are hashed (128 bits over role and text), and the sequences of hashes are sorted
over all partitions.  What two sorted neighbours share (their LCP) is an edge:

* **Union-find.** A task walks its sorted rows in runs of ``RUN``.  The edges of a run are
  taken in descending depth; each joins the components of its two rows, and the merge
  makes the branching node at that depth.  What either component has beyond the depth
  hangs below that node as a finished subtree (counts, leaves, saved bytes).
* **Contraction.** Only the prefixes of a run's first and last row can go on outside it.
  A run is contracted to these two rows with what hangs from their prefixes, and joins the
  next run as its first rows; at a partition's end two rows are left.
* **Across boundaries.** The rows of ``FAN_IN`` neighbouring partitions are merged by the same
  routine, again and again, until one forest is left.

**Long conversations** are cut into blocks of ``BLOCK`` turns; a block's rows form a trie of
their own below the prefix before it (a running hash), so no row and no task holds a whole
long conversation.  Leaves and savings of later blocks reach the earlier ones as weights of
the rows, found by a first round over the later blocks alone.

A node's list of ended conversations may be as long as the table: its hash is taken over
pieces of ``PIECE`` ids streamed in order through one task (a SHA-256 has no parts), never held.

Nulls: a null role or text is empty, a null turn comes first, rows with a null conv_id belong to
no conversation and are left out.  Rows of one conversation and turn are ordered by the hash of role
and text, so reruns agree; repeated rows are turns of their own.  ``conv_id % 5`` keeps the sign, as in
SQL.  An empty table has no node, not even the root.  Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domquarry.llm.common import save
from domquarry.operators.rank import row_number_within

BLOCK = 64  # turns of a block
RUN = 8192  # rows that a task folds at once
FAN_IN = 64  # partitions merged at once
PIECE = 256  # ids of a piece of a node's list
HOP = 1024  # blocks of a conversation in one window

HEAD, FAMILY = 8, 5  # turns lent at most; conversations per family
NO_ENDS = hashlib.sha256(b"").hexdigest()


# Rebuilding

def rebuilt(conversations: DataFrame) -> DataFrame:
    """-> conv_id, depth (0 for every conversation, then its rebuilt turns), key, size."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.octet_length(text).cast("long").alias("size"))
    turns = turns.withColumn("at", F.struct("turn", "key")).drop("turn")
    placed = row_number_within(turns, "conv_id", "at", "pos").drop("at")
    lent_by = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    convs = save(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(
        F.when(F.col("pos") <= HEAD, F.struct(F.col("pos").alias("depth"), "key", "size")))).alias("head")), "convs")
    lender = convs.select(F.col("conv_id").alias("lender"), F.col("head").alias("lent"))
    shape = convs.withColumn("lender", F.col("conv_id") - F.col("conv_id") % FAMILY).join(lender, "lender", "left")
    shape = shape.select("conv_id", F.slice(F.coalesce("lent", F.array().cast(convs.schema["head"].dataType)),
                                            F.lit(1), lent_by.cast("int")).alias("lent"))
    own = placed.filter(F.col("pos") > lent_by).join(shape.select("conv_id", F.size("lent").alias("taken")), "conv_id")
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - lent_by).alias("depth"), "key", "size")
    lent = shape.select("conv_id", F.inline("lent"))
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("key"), F.lit(0).cast("long").alias("size"))
    return own.unionByName(lent.select("conv_id", F.col("depth").cast("long").alias("depth"), "key", "size")).unionByName(top)


def _before(rows: DataFrame, total: Callable[[str], Column], join: Callable[[Column, Column], Column], names: list[str],
            last_first: bool) -> DataFrame:
    """``rows`` (conv_id, block, names) with each name's total over the conversation's blocks before
    (after, with ``last_first``) this one; a conversation's blocks go through windows of ``HOP``."""
    rows = rows.withColumn("hop", F.floor(F.col("block") / HOP))
    way = (lambda c: F.col(c).desc()) if last_first else F.col
    hops = Window.partitionBy("conv_id").orderBy(way("hop")).rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("conv_id", "hop").orderBy(way("block")).rowsBetween(Window.unboundedPreceding, -1)
    far = rows.groupBy("conv_id", "hop").agg(*[total(c).alias(c) for c in names])
    far = far.select("conv_id", "hop", *[total(c).over(hops).alias(f"far_{c}") for c in names])
    here = rows.select("conv_id", "hop", "block", *[total(c).over(near).alias(c) for c in names])
    zero = F.lit(0).cast("long")
    return here.join(far, ["conv_id", "hop"]).select("conv_id", "block", *[
        join(F.coalesce(c, zero), F.coalesce(f"far_{c}", zero)).cast("long").alias(c) for c in names])


def blocks(turns: DataFrame) -> DataFrame:
    """``rebuilt`` turns -> conv_id, block, g1, g2 (hash of the prefix before the block), s (the hashes of its
    turns, 16 bytes each), sizes (of the turn before the block and its turns).

    A turn whose depth is a multiple of ``BLOCK`` ends a block and is the turn before the next."""
    n, d = F.lit(BLOCK), F.col("depth")
    last = F.struct(F.floor((d - 1) / n).alias("block"), (d - F.floor((d - 1) / n) * n).alias("at"))
    ahead = F.struct(F.floor(d / n).alias("block"), F.lit(0).cast("long").alias("at"))
    places = F.when(d == 0, F.array(ahead)).when(d % n == 0, F.array(last, ahead)).otherwise(F.array(last))
    placed = turns.select("conv_id", "depth", "key", "size", F.inline(places))
    inside = F.col("at") > 0
    block = placed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", F.when(inside, F.col("key")).otherwise("").alias("key"), "size"))).alias("t"),
        F.bit_xor(F.when(inside, F.xxhash64("depth", "key"))).alias("x1"),
        F.bit_xor(F.when(inside, F.xxhash64("key", "depth", F.lit(1)))).alias("x2"))
    block = save(block.select("conv_id", "block", "x1", "x2", F.col("t.size").alias("sizes"),
                              F.unhex(F.array_join("t.key", "")).alias("s")), "blocks")
    long = block.filter((F.col("block") > 0) | (F.size("sizes") > BLOCK)).select("conv_id", "block", "x1", "x2")
    prefix = _before(long, F.bit_xor, lambda a, b: a.bitwiseXOR(b), ["x1", "x2"], False)
    prefix = prefix.select("conv_id", "block", F.col("x1").alias("g1"), F.col("x2").alias("g2"))
    zero = F.lit(0).cast("long")
    return save(block.join(prefix, ["conv_id", "block"], "left").select(
        "conv_id", "block", F.coalesce("g1", zero).alias("g1"), F.coalesce("g2", zero).alias("g2"), "s", "sizes"), "prefixed")


# The forest of a run of sorted rows

# What hangs from one prefix of a row.
N, REP, KIDS, LEAVES, SAVED, WAITING, ENDS, ASKED, SPREAD = range(9)


def _hang(into: dict, depth: int, w: list) -> None:
    """Add what hangs at ``depth``."""
    own = into.get(depth)
    if own is None:
        into[depth] = w
        return
    own[N] += w[N]
    own[REP] = min(own[REP], w[REP])
    for k in (KIDS, LEAVES, SAVED, WAITING, ENDS):
        own[k] = own[k] + w[k]
    own[ASKED] |= w[ASKED]
    own[SPREAD] |= w[SPREAD]


def shared(a: tuple, b: tuple) -> int:
    """Turns that two rows share; -1 where the prefixes before their blocks differ."""
    if a[0] != b[0]:
        return -1
    x, y = a[1], b[1]
    n = min(len(x), len(y)) >> 4
    if x[:n << 4] == y[:n << 4]:
        return n
    return next(k for k in range(n) if x[k << 4:(k + 1) << 4] != y[k << 4:(k + 1) << 4])


class Forest:
    """Nodes found and lists' pieces go to ``nodes`` and ``pieces``."""

    def __init__(self) -> None:
        self.nodes: list[list] = []
        self.pieces: list[tuple] = []

    def merge(self, rows: list[tuple], label: int, last: bool) -> list[tuple]:
        """Sorted ``rows`` (group, s, sizes, hanging by depth) -> their first and last row with all that hangs
        from them; everything else is finished.  With ``last`` nothing lies outside and no row is left."""
        if not rows:
            return []
        edges = sorted((-shared(rows[i - 1], rows[i]), i) for i in range(1, len(rows)))
        up = list(range(len(rows)))
        spine = [row[3] for row in rows]  # by component: what hangs from the prefix its rows share
        end = list(range(len(rows)))  # by component: its last row
        first: dict = {}  # of the first row, beyond what its component shares
        final: dict = {}  # of the last row

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def lift(c: int, depth: int) -> None:
            if not last and (c == 0 or end[c] == len(rows) - 1):  # may go on outside
                aside = first if c == 0 else final
                for d in [d for d in spine[c] if d > depth]:
                    _hang(aside, d, spine[c].pop(d))
            else:
                self.finish(rows[c], spine[c], depth)

        for less, i in edges:
            if less > 0 or less == 0 and rows[i - 1][0] != rows[i][0]:
                break  # other tries
            a, b = find(i - 1), find(i)
            lift(a, -less)
            lift(b, -less)
            for d, w in spine[b].items():
                _hang(spine[a], d, w)
            up[b], end[a] = a, end[b]
        roots = [c for c in range(len(rows)) if up[c] == c]
        for c in roots:
            if last or (c != 0 and end[c] != len(rows) - 1):
                self.finish(rows[c], spine[c], -1)
        if last:
            return []
        left = [(rows[0], {**first, **spine[0]})]
        if len(rows) > 1:
            left.append((rows[-1], final if roots[-1] == 0 else {**final, **spine[roots[-1]]}))
        return [(*row[:3], self.aside(row, hanging, label)) for row, hanging in left]

    def aside(self, row: tuple, hanging: dict, label: int) -> dict:
        """Nodes that wait for a parent which is not finished, and pieces of its list, go out under its key."""
        for depth, w in hanging.items():
            if w[WAITING] or w[ENDS]:
                key = self.key(row, depth)
                for node in w[WAITING]:
                    node[-2:] = [key, label]
                self.nodes += w[WAITING]
                w[ASKED] |= bool(w[WAITING])
                w[SPREAD] |= bool(w[ENDS])
                self.spread(key, w[ENDS])
                w[WAITING], w[ENDS] = [], []
        return hanging

    @staticmethod
    def key(row: tuple, depth: int) -> bytes:
        return hashlib.md5(repr(row[0]).encode() + row[1][:depth << 4]).digest()

    def spread(self, key: bytes, ends: list[int]) -> None:
        for k in range(0, len(ends), PIECE):
            self.pieces.append((key, ends[k], ",".join(map(str, ends[k:k + PIECE]))))

    def finish(self, row: tuple, hanging: dict, down_to: int) -> None:
        """All nodes of a prefix path deeper than ``down_to`` are whole; what they come to hangs there."""
        deepest = max(hanging, default=down_to)
        if deepest <= down_to:
            return
        n, rep, leaves, saved, node = 0, None, 0, 0, None
        base, sizes = row[0][0] * BLOCK, row[2]
        for depth in range(deepest, down_to, -1):
            w = hanging.pop(depth, None)
            kids, waiting, ends, key = int(depth < deepest), [node] if node else [], [], None
            if w:
                n, rep = n + w[N], w[REP] if rep is None else min(rep, w[REP])
                kids, leaves, saved = kids + w[KIDS], leaves + w[LEAVES], saved + w[SAVED]
                waiting, ends = waiting + w[WAITING], w[ENDS]
                if w[ASKED] or w[SPREAD]:
                    key = self.key(row, depth)
                if w[SPREAD]:
                    self.spread(key, ends)
            for child in waiting:
                child[-3] = rep
            self.nodes += waiting
            own = 0
            if depth < BLOCK:  # deeper ones are the next block's
                own = (n - 1) * sizes[depth]
                saved += own
                leaves += not kids
            sha = None if w and w[SPREAD] else hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else NO_ENDS
            node = [rep, base + depth, n, kids, leaves, saved, own, sha, key, depth == BLOCK, None, None, None]
        if down_to < 0:
            self.nodes.append(node)
        else:
            _hang(hanging, down_to, [n, rep, 1, leaves, saved, [node], [], False, False])


NODE = ("conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, own long, "
        "ends_sha256 string, key binary, next_block boolean, parent_conv_id long, parent_key binary, label long")
FOUND = NODE + ", first long, ids string, part long, seq int, row binary"
_FOUND = pa.schema([
    *[(c, pa.int64()) for c in "conv_id depth n_convs n_children n_leaves saved_tokens own".split()],
    ("ends_sha256", pa.string()), ("key", pa.binary()), ("next_block", pa.bool_()), ("parent_conv_id", pa.int64()),
    ("parent_key", pa.binary()), ("label", pa.int64()), ("first", pa.int64()), ("ids", pa.string()),
    ("part", pa.int64()), ("seq", pa.int32()), ("row", pa.binary())])


def _out(forest: Forest, left: list[tuple] = (), part: int = 0) -> Iterator[pa.RecordBatch]:
    """What a forest has found, and the rows left of a partition; the forest holds nothing afterwards."""
    n_node = len(_FOUND) - 5
    rows = [(*node, *[None] * 5) for node in forest.nodes]
    rows += [(*[None] * 8, key, *[None] * (n_node - 9), first, ids, None, None, None) for key, first, ids in forest.pieces]
    rows += [(*[None] * (n_node + 2), part, seq, pickle.dumps(row)) for seq, row in enumerate(left)]
    forest.nodes, forest.pieces = [], []
    for k in range(0, len(rows), RUN):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + RUN]), _FOUND.types)], schema=_FOUND)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition (block, g1, g2, s, conv_id, sizes, leaves, saved), run by run."""
    part, runs, left, forest = TaskContext.get().partitionId(), 0, [], Forest()
    for batch in batches:
        for k in range(0, batch.num_rows, RUN):
            columns = [c.to_pylist() for c in batch.slice(k, RUN).columns]
            rows = left + [((b, g1, g2), s, sizes, {len(s) >> 4: [
                1, conv, 0, leaves, saved, [], [] if len(s) >> 4 == BLOCK else [conv], False, False]})
                for b, g1, g2, s, conv, sizes, leaves, saved in zip(*columns)]
            left = forest.merge(rows, (part << 32) + runs, False)
            runs += 1
            yield from _out(forest)
    yield from _out(forest, left, part)


def _merged(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Merges the rows left of ``FAN_IN`` neighbouring partitions."""

    def merged(table: pa.Table) -> pa.Table:
        part, one = table.column("part")[0].as_py() // FAN_IN, Forest()
        table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
        left = one.merge([pickle.loads(x) for x in table.column("row").to_pylist()], -(level << 32) - part - 1, last)
        return pa.Table.from_batches(list(_out(one, left, part)), _FOUND)

    return merged


def forest(rows: DataFrame, name: str) -> DataFrame:
    """``blocks`` rows with leaves and saved (of later blocks) -> the nodes of their tries, parents and hashes set."""
    order = ["block", "g1", "g2", "s", "conv_id"]
    rows = rows.select(*order, "sizes", "leaves", "saved").repartitionByRange(*order).sortWithinPartitions(*order)
    found = [save(rows.mapInArrow(_walked, FOUND), name)]
    parts, level = found[0].agg(F.max("part")).first()[0], 0
    while parts is not None:  # the number of partitions falls by FAN_IN each time
        level, last = level + 1, parts < FAN_IN
        left = found[-1].filter("row IS NOT NULL").groupBy(F.floor(F.col("part") / FAN_IN))
        found.append(save(left.applyInArrow(_merged(level, last), FOUND), name))
        parts = None if last else parts // FAN_IN
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    nodes = every.filter("conv_id IS NOT NULL").select(*_FOUND.names[:-5])
    return _hashed(_parented(nodes), every.filter("ids IS NOT NULL").select("key", "first", "ids"))


def _parented(nodes: DataFrame) -> DataFrame:
    """Nodes that went out before their parent was whole find it by its key: first once for each run, then
    inside the run, so the children of one node never meet in one task."""
    waiting = nodes.filter("parent_key IS NOT NULL")
    whole = nodes.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    asked = waiting.select("label", "parent_key").distinct().join(whole, "parent_key")
    told = waiting.join(asked, ["label", "parent_key"]).withColumn("parent_conv_id", F.col("parent"))
    return nodes.filter("parent_key IS NULL").unionByName(told.select(*nodes.columns)).drop("label", "parent_key")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and first id -> the hash of each key's joined pieces, one piece held at a time."""
    key, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "sha": pa.array([digest.hexdigest()])})

    for batch in batches:
        for k, ids in zip(batch.column(0), batch.column(1)):
            if k.as_py() != key:
                if key is not None:
                    yield told()
                key, digest = k.as_py(), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
    if key is not None:
        yield told()


def _hashed(nodes: DataFrame, pieces: DataFrame) -> DataFrame:
    """Nodes whose list came in pieces get its hash."""
    sorted_pieces = pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    sha = sorted_pieces.mapInArrow(_digests, "key binary, sha string")
    keyed = nodes.filter("key IS NOT NULL").join(sha, "key", "left")
    keyed = keyed.withColumn("ends_sha256", F.coalesce("ends_sha256", "sha"))
    return nodes.filter("key IS NULL").drop("key").unionByName(keyed.select(*[c for c in nodes.columns if c != "key"]))


def trie(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) -> a row for each node of their rebuilt sequences: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    block, zero = blocks(rebuilt(conversations)), F.lit(0).cast("long")
    # first round, over later blocks alone: whose nodes bring which leaves and savings to the blocks before
    later = forest(block.filter("block > 0").withColumns({"leaves": zero, "saved": zero}), "later").filter("NOT next_block")
    brought = later.groupBy("conv_id", F.floor(F.col("depth") / BLOCK).alias("block")).agg(
        F.sum("own").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    long = block.filter((F.col("block") > 0) | (F.size("sizes") > BLOCK)).select("conv_id", "block")
    brought = long.join(brought, ["conv_id", "block"], "left").fillna(0, ["saved", "leaves"])
    brought = _before(brought, F.sum, lambda a, b: a + b, ["saved", "leaves"], True)
    rows = block.join(brought, ["conv_id", "block"], "left").fillna(0, ["saved", "leaves"])
    nodes = save(forest(rows, "nodes"), "trie")
    # a block's last nodes are the next block's tops: the one has the parent, the other the rest
    tops = nodes.filter("next_block").select("conv_id", "depth", F.col("parent_conv_id").alias("above"))
    whole = nodes.filter("NOT next_block").join(tops, ["conv_id", "depth"], "left")
    return whole.select("conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"),
                        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
