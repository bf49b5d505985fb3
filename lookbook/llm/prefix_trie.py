"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path of fixed-size tokens, one a turn: a digest of role and text, and the text's bytes. Paths are sorted
over range partitions by (path, conv_id). A trie node lies in several partitions only if it is a prefix of a splitter, the first
path of a partition, that the path before it shares. The trie of these splitter prefixes, the skeleton, is
broadcast; every partition then finishes all of its other nodes in one sorted pass, and leaves partial aggregates of skeleton
nodes, which are combined by reduction. A group of equal conversations, or those of a common first turn, are thus spread over as many
partitions as their rows ask for.

What grows in one task: a conversation's own path (24 bytes a turn), the digest of a node's ids, which streams, and one
pass over the skeleton (partitions x depth rows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small, stored

#: Bytes of a token: 16 of the digest, 8 of the text's length.
TOKEN = 24
#: Ids in a piece of the text that a node's digest is made of.
PIECE = 5000
_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PARTIAL = "kind string, node binary, above binary, shard int, place long, part int, bytes long, ids string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _token() -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): array of tokens, a turn each, by turn (null first; turns of equal number by their digests).

    A null role or text is an empty one. Rows without conv_id belong to no conversation. Repeated rows are turns of their own.
    Only digests are shuffled, never texts.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), _token().alias("token"))
    turns = conversations.where("conv_id is not null").select("conv_id", turn.alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["token"]).alias("path"))


def share_heads(paths: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, path) rebuilt: the first h turns of conversation c - c % ``every``, then c's own after its first h; h = crc32(c) % ``most``.

    The head is shorter where that conversation is, and empty where it is absent. At most ``every`` conversations share a head.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string")) % most).cast("int")
    heads = paths.where(c % every == 0).select(c.alias("head_id"), F.slice("path", 1, most).alias("head"))
    joined = paths.join(heads, c - c % every == F.col("head_id"), "left")
    own = F.slice("path", h + 1, F.greatest(F.size("path"), F.lit(1)))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<binary>")), own).alias("path"))


@dataclass
class _Node:
    depth: int
    bytes: int
    conv_id: int
    place: int
    skeleton: bool = False
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    sha: object = None
    ids: list = field(default_factory=list)
    part: int = 0
    waiting: list = field(default_factory=list)  # finished children, whose parent's smallest member isn't known yet


def _shared(a: bytes, b: bytes) -> int:
    """Tokens that two paths begin with together."""
    n = min(len(a), len(b)) // TOKEN
    if a[: n * TOKEN] == b[: n * TOKEN]:
        return n
    low, high = 0, n  # the first difference lies within (low, high]
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * TOKEN] == b[: mid * TOKEN] else (low, mid)
    return low


def _name(path: bytes, depth: int) -> bytes:
    return hashlib.blake2b(path[: depth * TOKEN], digest_size=16).digest()


class _Shard:
    """One sorted pass over a range partition. ``splitters``: the prefixes that a shard shares with those before and after it."""

    def __init__(self, shard: int, left: bytes | None, right: bytes | None):
        self.shard, self.left, self.right, self.stack, self.path, self.out, self.place = shard, left, right, [], b"", [], 0

    def add(self, path: bytes, conv_id: int) -> None:
        same = _shared(path, self.path) if self.stack else -1
        self.close(same)
        if not self.stack:
            self._open(path, 0, conv_id)
        for depth in range(same + 1 if same >= 0 else 1, len(path) // TOKEN + 1):
            self._open(path, depth, conv_id)
        self.path = path
        for node in self.stack:
            node.n += 1
            node.conv_id = min(node.conv_id, conv_id)
        end = self.stack[-1]
        if end.skeleton:
            end.ids.append(conv_id)
            if len(end.ids) >= PIECE:
                self._piece(end, path)
        else:
            end.sha.update(f"{conv_id}".encode() if not end.part else f",{conv_id}".encode())
            end.part = 1

    def _open(self, path: bytes, depth: int, conv_id: int) -> None:
        node = _Node(depth, int.from_bytes(path[depth * TOKEN - 8 : depth * TOKEN], "big") if depth else 0, conv_id, self.place)
        edge = path[: depth * TOKEN]
        node.skeleton = (not self.stack or self.stack[-1].skeleton) and any(s is not None and s.startswith(edge) for s in (self.left, self.right))
        node.sha = None if node.skeleton else hashlib.sha256()
        if self.stack and not node.skeleton:
            self.stack[-1].children += 1
        self.place += 1
        self.stack.append(node)

    def _piece(self, node: _Node, path: bytes) -> None:
        self.out.append({"kind": "ids", "node": _name(path, node.depth), "shard": self.shard, "part": node.part, "ids": ",".join(map(str, node.ids))})
        node.ids, node.part = [], node.part + 1

    def close(self, depth: int) -> None:
        """Finish the open nodes that are deeper than ``depth``."""
        while self.stack and self.stack[-1].depth > depth:
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            if node.skeleton:
                if node.ids:
                    self._piece(node, self.path)
                self._partial(node, above)
            else:
                self._finish(node, above)
            if above:
                above.leaves += node.leaves
                above.saved += node.saved

    def _partial(self, node: _Node, above: _Node | None) -> None:
        self.out.append({"kind": "node", "node": _name(self.path, node.depth), "above": _name(self.path, above.depth) if above else None, "shard": self.shard, "place": node.place, "bytes": node.bytes, "conv_id": node.conv_id, "depth": node.depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved})

    def _finish(self, node: _Node, above: _Node | None) -> None:
        node.leaves = node.leaves if node.children else 1
        node.saved += (node.n - 1) * node.bytes
        for row in node.waiting:
            self.out.append(row | {"parent_conv_id": node.conv_id})
        row = {"kind": "done", "conv_id": node.conv_id, "depth": node.depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.sha.hexdigest()}
        if above is None or above.skeleton:
            self.out.append(row | {"above": _name(self.path, above.depth) if above else None})
        else:
            above.waiting.append(row)

    def rows(self, least: int = 0) -> Iterator[pd.DataFrame]:
        if len(self.out) > least:
            names = [c.split()[0] for c in _PARTIAL.split(", ")]
            whole = {"shard", "place", "part", "bytes", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"}
            yield pd.DataFrame({c: pd.array([r.get(c) for r in self.out], dtype="Int64" if c in whole else object) for c in names})
            self.out.clear()


def _dealt(paths: DataFrame, most: int) -> tuple[DataFrame, dict[int, tuple[bytes | None, bytes | None]]]:
    """(shard, path, conv_id, left, right) sorted in range partitions, and what each shard shares with its neighbours, to be broadcast.

    Splitters of over ``most`` tokens aren't sent to all tasks: then each shard gets its own two as its first row, and the dictionary is empty.
    """
    spark = paths.sparkSession
    flat = paths.select("conv_id", F.unhex(F.array_join(F.transform("path", lambda t: F.hex(t)), "")).alias("path"))
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = cut(flat.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id"))
    named = shards.select(F.spark_partition_id().alias("shard"), "path", "conv_id", F.lit(None).cast("binary").alias("left"), F.lit(None).cast("binary").alias("right"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = shard = None
        for b in batches:
            if len(b):
                first, last, shard = (b["path"].iloc[0] if first is None else first), b["path"].iloc[-1], int(b["shard"].iloc[0])
        if first is not None:
            yield pd.DataFrame({"shard": [shard], "first": [first], "last": [last]})

    shared = F.udf(lambda a, b: None if a is None else bytes(b[: _shared(bytes(a), bytes(b)) * TOKEN]), "binary")
    order = Window.orderBy("shard")  # a row a partition
    ends_of = cut(named.select("shard", "path").mapInPandas(ends, "shard int, first binary, last binary"))
    both = ends_of.withColumn("left", shared(F.lag("last").over(order), "first"))
    both = cut(both.select("shard", "left", F.lead("left").over(order).alias("right")))
    size = both.agg(F.sum(F.coalesce(F.octet_length("left"), F.lit(0))) / TOKEN).head()[0] or 0
    if size <= most:
        return named, {r["shard"]: tuple(None if x is None else bytes(x) for x in (r["left"], r["right"])) for r in both.collect()}
    edges = both.select("shard", F.lit(None).cast("binary").alias("path"), F.lit(0).cast("long").alias("conv_id"), "left", "right")
    n = shards.rdd.getNumPartitions()
    return named.union(edges).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id"), {}


def _partials(paths: DataFrame, most: int) -> DataFrame:
    """Finished nodes, partial skeleton nodes and pieces of ids of all shards."""
    rows, splitters = _dealt(paths, most)
    sent = paths.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for b in batches:
            for shard, path, conv_id, left, right in zip(b["shard"], b["path"], b["conv_id"], b["left"], b["right"], strict=True):
                if at is None or at.shard != shard:
                    if at is not None:
                        at.close(-1)
                        yield from at.rows()
                    at = _Shard(int(shard), *(sent.value[shard] if sent.value else (left, right)))
                if path is not None:
                    at.add(path, int(conv_id))
            if at is not None:
                yield from at.rows(20_000)
        if at is not None:
            at.close(-1)
            yield from at.rows()

    return stored(rows.mapInPandas(run, _PARTIAL))


def _digests(pieces: DataFrame) -> DataFrame:
    """(node, ends): digest of a skeleton node's ids, whose pieces come by in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for b in batches:
            for name, ids in zip(b["node"], b["ids"], strict=True):
                if name != node:
                    if node is not None:
                        yield pd.DataFrame({"node": [node], "ends": [sha.hexdigest()]})
                    node, sha = name, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if node is not None:
            yield pd.DataFrame({"node": [node], "ends": [sha.hexdigest()]})

    return pieces.repartition("node").sortWithinPartitions("node", "shard", "part").select("node", "ids").mapInPandas(run, "node binary, ends string")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """Reduced skeleton nodes in preorder, with what skeleton nodes below them add: children, leaves and saved bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[dict] = []

        def close(depth: int) -> list[dict]:
            out = []
            while stack and stack[-1]["depth"] >= depth:
                x = stack.pop()
                x["n_leaves"] += x["n_children"] == 0
                x["saved_tokens"] += (x["n_convs"] - 1) * x["bytes"]
                x["more_leaves"], x["more_saved"] = x["more_leaves"] + (x["n_children"] == 0), x["more_saved"] + (x["n_convs"] - 1) * x["bytes"]
                if stack:
                    for k in ("leaves", "saved"):
                        stack[-1][f"more_{k}"] += x[f"more_{k}"]
                    stack[-1]["n_leaves"] += x["more_leaves"]
                    stack[-1]["saved_tokens"] += x["more_saved"]
                out.append(x)
            return out

        def frame(rows: list[dict]) -> pd.DataFrame:
            got = pd.DataFrame(rows, columns=["node", *(c.split()[0] for c in _RESULT.split(", ")[:-1])])
            return got.astype({c: "Int64" for c in got.columns[1:]})

        for b in batches:
            done = []
            for x in b.to_dict("records"):
                done += close(x["depth"])
                x |= {"parent_conv_id": stack[-1]["conv_id"] if stack else None, "more_leaves": 0, "more_saved": 0}
                if stack:
                    stack[-1]["n_children"] += 1
                stack.append(x)
            yield frame(done)
        yield frame(close(-1))

    names = ["node", "depth", "bytes", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.repartition(1).sortWithinPartitions("shard", "place").select(*names).mapInPandas(run, "node binary, " + _RESULT.rpartition(",")[0])


def prefix_trie(paths: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each distinct prefix of the ``path`` of (conv_id, path): its smallest member, depth, parent and figures of its subtree.

    conv_id, depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens (bytes of last texts that all but one
    member repeat, summed over the subtree) and ends_sha256 (of the comma-joined ids of the conversations that end there,
    ascending). Conversations of no turns end at the root. Ids are unique and not null; no conversations give no nodes.
    Splitters of over ``most`` tokens aren't broadcast.
    """
    got = _partials(paths, most)
    parts, pieces, done = (got.where(F.col("kind") == k) for k in ("node", "ids", "done"))
    first = F.min(F.struct("shard", "place")).alias("first")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = parts.groupBy("node").agg(first, F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), *sums)
    skeleton = cut(_rolled_up(nodes.select("*", "first.shard", "first.place")))
    n = skeleton.count()
    whole = skeleton.join(_digests(pieces), "node", "left").withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256)))
    parents = skeleton.select(F.col("node").alias("above"), F.col("conv_id").alias("_up"))
    below = done.drop("node").join(small(parents, n), "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return below.select(names).union(whole.select(names))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of (conv_id, turn, role, text); see ``turn_paths`` for nulls, ties and repeated rows."""
    return prefix_trie(turn_paths(conversations))
