"""Merkle manifest of a table by time-forward processing.

Nodes are labelled (level, place). Digests go forward in time: a queue ordered by label delivers those of the children to
their parent, which is hashed once all have come. The queue is external: one exchange sorts the nodes of a level by label
and deals them out in blocks of ``FANOUT`` ** ``LEVELS`` neighbours, and within a block a heap in the task serves ``LEVELS`` levels
at once. A hot source is thus many blocks, and the next exchange holds one digest a block. A reversed sweep goes back from the root:
it delivers to each block the proof of its top, to which the block adds, level by level, the siblings of the node's
own path, until every leaf has its whole proof. Blocks are hashed again on the way back, so no proofs are stored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

FANOUT = 3
#: Levels of a block: 3 ** 8 = 6,561 nodes.
LEVELS = 8


def joined_hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values: ``-`` if null, else UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (grp, ...) with place, 0..n-1 in ``order`` within grp (nulls first), and total = n.

    Rows are sorted in ranges, so that a hot group is spread out; a task counts on from what ranges before it hold of its first group.
    """
    spark = nodes.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(nodes.repartitionByRange(tasks, "grp", *order).sortWithinPartitions("grp", *order))
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})  # rises within a task
    by = cut(ranged.groupBy("_part", "grp").agg(F.count("*").alias("n"), F.min("_row").alias("_first")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by.select("_part", "grp", (before - F.col("_first")).alias("_shift"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    return ranged.join(small(starts, by.count()), ["_part", "grp"]).withColumn("place", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


class _Block:
    """Up to ``FANOUT`` ** ``levels`` neighbouring nodes of a level with ``total`` nodes, and the nodes above them within the block."""

    def __init__(self, total: int, first: int, digests: list[str], levels: int, fanout: int):
        self.fanout, self.levels = fanout, [(first, digests)]
        queue = [(0, first + i, d) for i, d in enumerate(digests)]  # (level, place) is the label; nodes come in its order
        heapq.heapify(queue)
        at, got, start = 0, [], first
        sizes = [total]
        while len(sizes) <= levels and sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // fanout))
        while queue:
            level, place, digest = heapq.heappop(queue)
            if level != at:
                self.levels.append((place, [])) if level == len(self.levels) else None
                at = level
            if level:
                self.levels[level][1].append(digest)
            if level + 1 < len(sizes):
                got.append(digest)
                if len(got) == fanout or place == sizes[level] - 1 or not queue or queue[0][0] != level or queue[0][1] // fanout != place // fanout:
                    heapq.heappush(queue, (level + 1, place // fanout, joined_hash(*got)))
                    got = []
        self.top = self.levels[-1][1][0]

    def proofs(self, above: str) -> Iterator[str]:
        """The proof of each node: a step a level, ``left<right`` siblings, joined by commas; ``above`` is that of the top."""
        now = [above]
        for (upper, _), (first, digests) in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            down = []
            for i in range(len(digests)):
                run = (first + i) // self.fanout
                s, e = max(run * self.fanout - first, 0), min((run + 1) * self.fanout - first, len(digests))
                step = "".join(digests[s:i]) + "<" + "".join(digests[i + 1 : e])
                rest = now[run - upper]
                down.append(f"{step},{rest}" if rest else step)
            now = down
        yield from now


def fold(digest: str, proof: str) -> str:
    """The root that a leaf and its proof give."""
    for step in proof.split(",") if proof else []:
        left, right = step.split("<")
        digest = joined_hash(left, digest, right)
    return digest


def proof_text(proof: str) -> str:
    """The digests of a proof, from the leaf up and left to right."""
    return proof.replace(",", "").replace("<", "")


_UP = "grp string, total long, place long, digest string"


def _blocks(nodes: DataFrame, levels: int, fanout: int, out, schema: str) -> DataFrame:
    """``out(rows)`` of each block of nodes, by place; a row of place -1, the first, carries the block's proof from above."""
    size = fanout**levels
    own = F.expr(f"place div {size}")
    at = F.when(F.col("place") < 0, F.col("block")).otherwise(own) if "block" in nodes.columns else own
    dealt = nodes.withColumn("block", at).repartition("grp", "block").sortWithinPartitions("grp", "block", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, rows = None, []
        for b in batches:
            for row in b.to_dict("records"):
                now = (row["grp"], row["block"])
                if now != label and rows:
                    yield out(rows)
                    rows = []
                label = now
                rows.append(row)
        if rows:
            yield out(rows)

    return dealt.mapInPandas(run, schema)


def tops(nodes: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> list[DataFrame]:
    """The rounds (grp, total, place, digest) from ``nodes`` up to one node a group: the forward sweep."""
    rounds = [nodes.select("grp", "total", "place", "digest")]
    size = fanout**levels

    def up(rows: list[dict]) -> pd.DataFrame:
        total = int(rows[0]["total"])
        block = _Block(total, int(rows[0]["place"]), [r["digest"] for r in rows], levels, fanout)
        return pd.DataFrame({"grp": [rows[0]["grp"]], "total": [-(-total // size)], "place": [int(rows[0]["block"])], "digest": [block.top]})

    while (rounds[-1].agg(F.max("total")).head()[0] or 0) > 1:
        rounds.append(cut(_blocks(rounds[-1], levels, fanout, up, _UP)))
    return rounds


def proofs(rounds: list[DataFrame], above: DataFrame, leaves: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """(columns of ``leaves``, proof, subroot): the backward sweep. ``above`` (grp, proof, subroot) is what each group's top gets.

    ``leaves`` are the nodes of the first round, with all columns that are to stay.
    """
    ups = above.select("grp", F.lit(0).cast("long").alias("block"), "proof", "subroot")
    for k in range(len(rounds) - 2, -1, -1):
        nodes = leaves if k == 0 else rounds[k]
        ups = _delivered(nodes, ups, levels, fanout)
        if k:
            ups = cut(ups.select("grp", F.col("place").alias("block"), "proof", "subroot"))
    return ups if len(rounds) > 1 else leaves.join(ups.drop("block"), "grp")


def _delivered(nodes: DataFrame, ups: DataFrame, levels: int, fanout: int) -> DataFrame:
    """``nodes`` with the proofs that their blocks' rows of ``ups`` lead to. Columns that only pass are text in the tasks, so that they stay as they are."""
    own, rest = ["grp", "total", "place", "digest"], [f for f in nodes.schema if f.name not in ("grp", "total", "place", "digest")]
    named = nodes.select(*own, *(F.col(f.name).cast("string") for f in rest))
    message = ups.select("grp", F.lit(-1).cast("long").alias("place"), "block", "proof", "subroot")
    names, schema = named.columns, ", ".join([_UP, *(f"{f.name} string" for f in rest), "proof string", "subroot string"])

    def down(rows: list[dict]) -> pd.DataFrame:
        top, kept = rows[0], rows[1:]
        block = _Block(int(kept[0]["total"]), int(kept[0]["place"]), [r["digest"] for r in kept], levels, fanout)
        out = pd.DataFrame(kept, columns=names).astype({"total": "int64", "place": "int64"})
        return out.assign(proof=list(block.proofs(top["proof"])), subroot=top["subroot"])

    found = _blocks(named.unionByName(message, allowMissingColumns=True), levels, fanout, down, schema)
    return found.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in rest})


def manifest(leaves: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (source, doc_id, leaf, ...) with subroot, root and proof (see ``_Block.proofs``).

    A tree a source over its leaves by doc_id (null first, equal ids by leaf), and one over the sources' subroots (null first, by
    UTF-8 bytes). Runs of ``fanout`` nodes are hashed to one, a shorter last run as well; a lone node is its own root.
    Repeated rows are leaves of their own. No leaves give no rows.
    """
    # a null source is named apart from all others, and before them
    named = leaves.withColumn("grp", F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))).withColumn("digest", F.col("leaf"))
    own = cut(numbered(named, ["doc_id", "leaf"]))
    rounds = tops(own, levels, fanout)
    last = rounds[-1]
    subroots = last.select(F.col("grp").alias("name"), F.lit("").alias("grp"), "digest")
    over = cut(numbered(subroots, ["name"]))
    upper = tops(over, levels, fanout)
    found = upper[-1].select("digest").head()  # one row
    root = found["digest"] if found else None
    start = over.sparkSession.createDataFrame([("", "", "")], "grp string, proof string, subroot string")
    above = proofs(upper, start, over, levels, fanout).select(F.col("name").alias("grp"), "proof", F.col("digest").alias("subroot"))
    return proofs(rounds, cut(above), own, levels, fanout).withColumn("root", F.lit(root).cast("string")).drop("grp", "digest", "place", "total")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, tampered): digests of documents, and those with line feeds of the text deleted where 2 divides crc32 of the id."""
    names = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    odd = leaf_digest(*names, F.regexp_replace("text", "\n", ""))
    mine = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs.select("source", "doc_id", leaf_digest(*names, F.col("text")).alias("leaf"), F.when(mine, odd).alias("tampered"))


def verified_manifest(docs: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents.

    Rows are refolded with the tampered leaf where there is one. A null doc_id is never tampered with and comes first in its source;
    null columns have a digest of their own, so a null and an empty text differ. Texts may be of any length: only digests are
    shuffled. An empty table gives no rows; other columns are not read.
    """
    whole = manifest(document_leaves(docs), levels, fanout)

    @F.pandas_udf("proof_sha256 string, folded_root string")
    def checked(leaf: pd.Series, proof: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"proof_sha256": [joined_hash(proof_text(p)) for p in proof], "folded_root": [fold(d, p) for d, p in zip(leaf, proof, strict=True)]})

    out = whole.withColumn("_c", checked(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", "_c.proof_sha256", "_c.folded_root", (F.col("_c.folded_root") == F.col("root")).alias("verified"))
