"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn is known by the first 16 bytes of the SHA-256 of its role and text, so a conversation is a byte string
of 16 bytes a turn and its prefixes of d turns are the nodes of depth d.

* `sequences` brings the turns of a conversation into one row of ids and word counts (texts stay
  where they are). Equal sequences become one row; the ids of their conversations are joined as text in blocks
  of ``BLOCK`` consecutive ids before they meet, and only texts of several blocks pass through a running hash.
* Sequences are cut into key ranges (`RANGE_BYTES` of keys each). A range is one radix tree (`Tree`):
  inner nodes grow through layouts of 4, 16, 48 and 256 children and hold the bytes that all keys
  below share. Byte depths that end a turn become nodes, also those inside shared bytes.
* A node whose sequences lie in one range is final. The others are prefixes of the first or last key of a range;
  each range tells its part of them. The parts add up, because each range knows how many turns it
  shares with its neighbours: a node is counted by the first range that holds it, and what n_convs of a node adds
  to saved tokens is linear in the parts of n_convs.

So a first turn that a third of all conversations share is many ranges, merged from one row each.

Turns are ordered by turn (null first), then by role and text, then by their number of equal rows; a turn that is
there twice counts twice. A null role or text is empty. Rows without a conversation id take no part: no such
conversation can be named. Without conversations there is no node. A conversation is held as one row of 20 bytes a turn; the
texts of turns that carry the same number travel to their conversation for the order, others do not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tellmark.llm.common import arrow, join_checked, stored, whole_groups

WIDTH = 16
#: Bytes of keys of one tree.
RANGE_BYTES = 4_000_000
#: Ids whose text is joined before groups of equal sequences meet: 2 to this power.
BLOCK = 16
NONE = hashlib.sha256(b"").hexdigest()


class Node:
    """An inner node or a leaf: the bytes on the way to it, children by next byte, and the value of
    the key that ends here."""

    __slots__ = ("path", "layout", "index", "kids", "value")

    def __init__(self, path: bytes, value: int = -1):
        self.path, self.value = path, value
        self.layout, self.index, self.kids = 4, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.index[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Add or replace a child; a full layout grows to the next."""
        if self.layout <= 16:
            at = self.index.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) < self.layout:
                self.index.append(byte)
                self.kids.append(kid)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                places = bytearray(256)
                for i, b in enumerate(self.index):
                    places[b] = i + 1
                self.layout, self.index = 48, places
            self.put(byte, kid)
        elif self.layout == 48:
            if self.index[byte]:
                self.kids[self.index[byte] - 1] = kid
            elif len(self.kids) < 48:
                self.kids.append(kid)
                self.index[byte] = len(self.kids)
            else:
                wide = [None] * 256
                for b, at in enumerate(self.index):
                    if at:
                        wide[b] = self.kids[at - 1]
                self.layout, self.index, self.kids = 256, bytearray(), wide
                self.put(byte, kid)
        else:
            self.kids[byte] = kid

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None] if self.layout == 256 else self.kids


class Tree:
    """An adaptive radix tree with path compression; keys may be prefixes of other keys."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: int) -> None:
        node, done = self.root, 0
        while True:
            if done == len(key):
                node.value = value
                return
            kid = node.find(key[done])
            if kid is None:
                node.put(key[done], Node(key[done:], value))
                return
            path, rest = kid.path, key[done : done + len(kid.path)]
            if path == rest:
                node, done = kid, done + len(path)
                continue
            same = _shared(path, rest)
            fork = Node(path[:same])
            kid.path = path[same:]
            fork.put(path[same], kid)
            node.put(key[done], fork)
            node, done = fork, done + same

    def get(self, key: bytes) -> int:
        node, done = self.root, 0
        while done < len(key):
            kid = node.find(key[done])
            if kid is None or key[done : done + len(kid.path)] != kid.path:
                return -1
            node, done = kid, done + len(kid.path)
        return node.value

    def walk(self) -> list[tuple[Node, int, int]]:
        """Nodes before their children: node, place of its parent in this list, byte depth."""
        out, stack = [], [(self.root, -1, 0)]
        while stack:
            node, parent, depth = stack.pop()
            at = len(out)
            out.append((node, parent, depth))
            stack.extend((k, at, depth + len(k.path)) for k in node.children())
        return out


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def members(rows: DataFrame) -> DataFrame:
    """Conversations as they are: ``conv_id``, ``ids``, ``words`` (a number per turn)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # the length of the role keeps role and text apart
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.unhex(F.substring(sha, 1, 2 * WIDTH)).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    same = turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    same = stored(same, "equal-turns")
    tied = turns.join(same, (turns.conv_id == same.conv_id) & turns.turn.eqNullSafe(same.turn), "left_semi")
    alone = turns.join(same, (turns.conv_id == same.conv_id) & turns.turn.eqNullSafe(same.turn), "left_anti")
    if same.isEmpty():
        tied, alone = None, turns
    alone = alone.select("conv_id", F.struct("turn", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "id", "words").alias("t"))
    if tied is not None:
        alone = alone.unionByName(tied.select("conv_id", F.struct("turn", "role", "text", "id", "words").alias("t")))
    whole = alone.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    joined = F.unhex(F.array_join(F.transform("t.id", F.hex), ""))
    return whole.select("conv_id", joined.alias("ids"), F.col("t.words").alias("words"))


def rebuilt(own: DataFrame, bases: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation begins with the first h turns of the conversation whose id is the next multiple of
    ``bases`` towards zero, h = crc32 of the id modulo ``heads``; its own turns follow from turn h on."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    rows = own.select("*", (F.col("conv_id") - F.col("conv_id") % bases).alias("_base"), h.cast("int").alias("_h"))
    first = own.where(F.col("conv_id") % bases == 0).select(
        F.col("conv_id").alias("_base"), F.substring("ids", 1, WIDTH * (heads - 1)).alias("_ids"), F.slice("words", 1, heads - 1).alias("_words")
    )
    rows = join_checked(rows, first, "_base", "left", 120)
    head = F.coalesce(F.expr(f"substring(_ids, 1, {WIDTH} * _h)"), F.lit(b""))
    few = F.coalesce(F.expr("slice(_words, 1, _h)"), F.array().cast("array<int>"))
    return rows.select(
        "conv_id", F.concat(head, F.expr(f"substring(ids, {WIDTH} * _h + 1)")).alias("ids"),
        F.concat(few, F.expr("slice(words, _h + 1, greatest(size(words) - _h, 0))")).alias("words"),
    )


def _hash_blocks(blocks: DataFrame) -> DataFrame:
    """``ids`` and the hash of its blocks of id texts in order; a block at a time is in memory."""
    schema = "ids binary, ends string"
    out = arrow(schema)

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for ids, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids != now or state is None:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = ids, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), out)], schema=out)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], schema=out)

    ordered = blocks.repartition("ids").sortWithinPartitions("ids", "block").select("ids", "part")
    return ordered.mapInArrow(run, schema)


def sequences(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct sequences (stored): ``ids``, ``words``, ``n`` conversations, ``conv_id`` the smallest,
    ``ends`` the hash of their ids."""
    blocks = found.groupBy("ids", F.shiftright("conv_id", block).alias("block")).agg(
        F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
        F.sort_array(F.collect_list("conv_id")).alias("all"),
    )
    blocks = stored(blocks.withColumn("part", F.array_join(F.col("all").cast("array<string>"), ",")).drop("all"), "sequence-blocks")
    whole = blocks.groupBy("ids").agg(
        F.any_value("words").alias("words"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("_blocks"),
        F.sha2(F.any_value("part").cast("binary"), 256).alias("one"),
    )
    many = stored(_hash_blocks(blocks.join(whole.where("_blocks > 1").select("ids"), "ids")), "sequence-ends")
    if not many.isEmpty():
        whole = whole.join(many, "ids", "left")
    else:
        whole = whole.withColumn("ends", F.lit(None).cast("string"))
    return stored(whole.select("ids", "words", "n", "conv_id", F.coalesce("ends", "one").alias("ends")), "sequences")


_COLUMNS = "conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved long, ends string, prefix binary, parent_prefix binary, parent_conv_id long, open boolean"


def _range_nodes(keys: list[bytes], words: list, n: list, convs: list, ends: list, before: int, after: int) -> dict:
    """Columns of the nodes of one key range. ``before`` and ``after`` are the turns that its first key shares
    with the range before and its last key with the range behind; -1 where there is none."""
    tree = Tree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    first, last = keys[0], keys[-1]
    left, right = _prefixes(first, before), _prefixes(last, after)
    made = {c: [] for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends", "prefix", "parent_prefix", "parent_conv_id", "open")}
    walk = tree.walk()
    # of every tree node: members, smallest member, a key below, childless nodes, saved tokens and own children at its end
    size = len(walk)
    total, least, some = [0] * size, [None] * size, [-1] * size
    leaves, saved, kids = [0] * size, [0] * size, [0] * size
    above: list[list[int]] = [[] for _ in range(size)]  # turn nodes that still need their parent
    at_first, at_last = [False] * size, [False] * size
    low, high = 0, len(keys) - 1
    for at in range(size - 1, -1, -1):
        node, parent, depth = walk[at]
        value = node.value
        if value >= 0:
            total[at] += n[value]
            least[at] = convs[value] if least[at] is None else min(least[at], convs[value])
            some[at] = value
            at_first[at] |= value == low
            at_last[at] |= value == high
        start = depth - len(node.path)
        pending = above[at]
        turn = depth // WIDTH
        stop = -(-(start + 1) // WIDTH) if parent >= 0 else 0
        for d in range(turn, stop - 1, -1):
            ending = value >= 0 and d * WIDTH == depth
            is_left, is_right = at_first[at] and d <= before, at_last[at] and d <= after
            new = not is_left
            here = len(made["depth"])
            goes_on = ending and value == high and d <= after  # the range behind extends the last key
            if not kids[at] and not goes_on and ending:
                leaves[at] += 1
            saved[at] += (total[at] - new) * (words[some[at]][d - 1] if d else 0)
            prefix = left[d] if is_left else right[d] if is_right else None
            made["conv_id"].append(least[at])
            made["depth"].append(d)
            made["n_convs"].append(total[at])
            made["n_children"].append(kids[at])
            made["n_leaves"].append(leaves[at])
            made["saved"].append(saved[at])
            made["ends"].append(ends[value] if ending else None)
            made["prefix"].append(prefix)
            made["parent_prefix"].append(None)
            made["parent_conv_id"].append(None)
            made["open"].append(prefix is not None)
            for child in pending:
                if prefix is None:
                    made["parent_conv_id"][child] = least[at]
                else:
                    made["parent_prefix"][child] = prefix
            pending, kids[at] = [here], int(new)
        if parent >= 0:
            total[parent] += total[at]
            least[parent] = least[at] if least[parent] is None else min(least[parent], least[at])
            some[parent] = some[at]
            leaves[parent] += leaves[at]
            saved[parent] += saved[at]
            kids[parent] += kids[at]
            at_first[parent] |= at_first[at]
            at_last[parent] |= at_last[at]
            above[parent] += pending
            above[at] = []
    return made


def _prefixes(key: bytes, turns: int) -> list[bytes]:
    """Names of the prefixes of up to so many turns."""
    state, out = hashlib.sha256(), []
    for d in range(turns + 1):
        out.append(state.digest()[:16])
        state.update(key[d * WIDTH : (d + 1) * WIDTH])
    return out


def nodes(distinct: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nodes of the trie over distinct sequences (as `sequences` gives them)."""
    spark = distinct.sparkSession
    size = distinct.agg(F.sum(F.length("ids") + 64)).first()[0] or 0
    parts = max(1, -(-size // range_bytes))
    ranged = stored(distinct.repartitionByRange(parts, "ids").withColumn("p", F.spark_partition_id()), "sequence-ranges")
    ends = ranged.groupBy("p").agg(F.min("ids").alias("a"), F.max("ids").alias("b"))
    by_range = Window.orderBy("p")  # a row per range

    @F.udf("int")
    def turns_shared(x, y):
        return -1 if x is None or y is None else _shared(bytes(x), bytes(y)) // WIDTH

    lag, lead = F.lag("b").over(by_range), F.lead("a").over(by_range)
    ends = ends.select("p", turns_shared("a", lag).alias("before"), turns_shared("b", lead).alias("after"))
    rows = join_checked(ranged, stored(ends, "range-ends"), "p", "inner", 24)
    rows = rows.repartition(parts, "p").sortWithinPartitions("p", "ids")
    out = arrow(_COLUMNS)

    def run(batches):
        for group in whole_groups(batches, "p"):
            columns = [group.column(c).to_pylist() for c in ("ids", "words", "n", "conv_id", "ends")]
            made = _range_nodes(*columns, group.column("before")[0].as_py(), group.column("after")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    found = stored(rows.mapInArrow(run, _COLUMNS), "nodes")
    merged = found.where("open").groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.max("parent_prefix").alias("parent_prefix"),
    )
    merged = stored(merged, "open-nodes")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends", "parent_prefix"]
    names = merged.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("_parent"))
    closed = found.where("not open")
    inner = closed.where("parent_prefix is null").select(*columns[:-1], "parent_conv_id")
    border = closed.where("parent_prefix is not null").select(*columns).unionByName(merged.select(*columns))
    border = join_checked(border, names, "parent_prefix", "left", 64).select(*columns[:-1], F.col("_parent").alias("parent_conv_id"))
    whole = inner.unionByName(border)
    return whole.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"),
    )


def trie(rows: DataFrame, bases: int = 20, heads: int = 4, range_bytes: int = RANGE_BYTES, block: int = BLOCK) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    return nodes(sequences(rebuilt(members(rows), bases, heads), block), range_bytes)
