"""Near-duplicate documents by SimHash fingerprints, searched with pivot distance tables.

Fingerprint: words of the text (A-Z lower-cased), 3-word shingles with repeats, XXH64 (seed 42) of each; a bit is set
if it is set in over half of the shingles. Documents link at ``RADIUS`` or fewer differing bits; a document's component
is the smallest doc_id that it reaches over links.

Search over distinct fingerprints:

1. Pivot table: the Hamming distances of each fingerprint to ``PIVOTS`` reference fingerprints, packed a byte each.
2. Blocks: 64 bits are cut into 6 parts. Two fingerprints at 3 or fewer differing bits agree on at least 3 whole parts,
   so each of the 20 choices of 3 parts is an equi-key, and no link is lost.
3. Within a block, rows are sorted by their distance to the first pivot. Pairs whose coordinates differ by more than
   ``RADIUS`` at any pivot can't be within ``RADIUS`` of each other (triangle inequality) and are discarded; the survivors
   are verified by an exact bit count.
4. Only links that join two components of what a task has seen leave it (a spanning forest: fewer links than rows),
   so a group of m near copies costs at most m links, never all its pairs.

A block of over ``BLOCK_ROWS`` fingerprints is dealt over a grid of sub-blocks, each pair of which meets in some task. A block
of over ``SPLITS`` times that would cost more copies of a row than searching it by parts again: the 32 bits in which its rows
may differ are cut into 6 parts, of which again 3 agree. A block of the second kind has at most 2^17 distinct fingerprints,
so its grid is bounded, whatever the size of the corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, packed, small, unpacked
from .components import components

RADIUS = 3
PIVOTS = 16
BLOCK_ROWS = 1024
SPLITS = 20
CHUNK_ROWS = 40_000


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text; 0 if it has no words."""
    words = (text or b"").lower().split()  # bytes.lower() touches A-Z only, bytes.split() the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(width, len(words))
    spans = zip((ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp): fp is the fingerprint as a signed long, mark a hash of the text. Null and wordless texts get fp 0."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), _fingerprints(F.col("text").cast("binary")).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, spread by hashing their number."""
    return [xxhash.xxh64_intdigest(f"pivot {k}", 7) for k in range(n)]


def pivot_table(classes: DataFrame) -> DataFrame:
    """(fp, near0, near1): distances to 8 pivots each, a byte per pivot."""
    refs = [_signed(p) for p in pivots()]

    def packed(of: list[int]):
        bits = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i) for i, p in enumerate(of)]
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out

    return classes.select("fp", packed(refs[:8]).alias("near0"), packed(refs[8:]).alias("near1"))


def _choices(bits: list[int]) -> list[int]:
    """The masks of three parts out of six that ``bits`` (positions) are cut into: the first parts are a bit longer."""
    parts = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), 6)]
    return [sum(m) for m in combinations(parts, 3)]


_MASKS = _choices(list(range(64)))
#: For each of them the masks within the bits that it leaves free.
_FINER = [_choices([b for b in range(64) if not m >> b & 1]) for m in _MASKS]


def _longs(masks: list[int]) -> Column:
    return F.array(*(F.lit(_signed(m)) for m in masks))


def deal(table: DataFrame) -> tuple[DataFrame, int]:
    """``table`` (fp, near0, near1) dealt into blocks, (fp, near0, near1, block), and the number of rows dealt.

    Any two fingerprints at ``RADIUS`` or fewer differing bits meet in some block of at most some ``BLOCK_ROWS`` x 2 rows.
    """
    of, key = ["fp", "near0", "near1"], lambda i, m: F.struct(i.alias("choice"), F.xxhash64(i, F.col("fp").bitwiseAND(m)).alias("cell"))
    cells = table.select(*of, F.inline(F.transform(_longs(_MASKS), lambda m, i: key(i, m))))
    large = cut(cells.groupBy("choice", "cell").count().where(F.col("count") > BLOCK_ROWS))
    n, sizes = table.count() * len(_MASKS), large.agg(F.count("*"), F.sum("count"), F.max("count")).head()
    if not sizes[0]:
        return cells.select(*of, F.col("cell").alias("block")), n
    joined = cells.join(small(large.select("cell", "count"), sizes[0]), "cell", "left")
    plain, huge = joined.where("count is null"), F.col("count") > BLOCK_ROWS * SPLITS
    grid, n_grid = _grid(joined.where(~huge), large.where(~huge))
    out, n = plain.select(*of, F.col("cell").alias("block")).union(grid), n - sizes[1] + n_grid
    if sizes[2] <= BLOCK_ROWS * SPLITS:
        return out, n
    finer = F.get(F.array(*map(_longs, _FINER)), F.col("choice"))
    again = joined.where(huge).select(*of, F.explode(F.transform(finer, lambda m, j: F.xxhash64("cell", j, F.col("fp").bitwiseAND(m)))).alias("cell"))
    n_again = large.where(huge).agg(F.sum("count")).head()[0] * len(_MASKS)
    still = cut(again.groupBy("cell").count().where(F.col("count") > BLOCK_ROWS))
    sizes = still.agg(F.count("*"), F.sum("count")).head()
    again = again.join(small(still, sizes[0]), "cell", "left")
    grid, n_grid = _grid(again.where("count is not null"), still)
    return out.union(again.where("count is null").select(*of, F.col("cell").alias("block"))).union(grid), n + n_again - (sizes[1] or 0) + n_grid


def _grid(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, int]:
    """Rows of large cells over pairs of sub-blocks of about ``BLOCK_ROWS`` rows each, and their number."""
    parts = F.ceil(F.col("count") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("own", own)
    dealt = dealt.withColumn("with", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own"))))
    pair = F.xxhash64("cell", F.least("own", "with"), F.greatest("own", "with"))
    return dealt.select("fp", "near0", "near1", pair.alias("block")), large.agg(F.sum(F.col("count") * (parts - 1))).head()[0] or 0


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning links of the rows of some blocks."""
    tables = np.ascontiguousarray(rows[["near0", "near1"]].to_numpy(np.int64), "<i8").view(np.uint8).reshape(len(rows), -1).astype(np.int16)
    order = np.lexsort((tables[:, 0], rows["block"].to_numpy()))
    block, tables = rows["block"].to_numpy()[order], tables[order]
    values, ids = np.unique(rows["fp"].to_numpy()[order], return_inverse=True)
    bits, root = values.view(np.uint64), np.arange(len(values))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found, at, lag = [], np.arange(len(rows) - 1), 1
    while at.size:
        other = at + lag
        at = at[(block[at] == block[other]) & (tables[other, 0] - tables[at, 0] <= RADIUS)]  # sorted: a row that ends here has no later partner
        for part in np.array_split(at, at.size // 100_000 + 1):
            part = part[np.abs(tables[part] - tables[part + lag]).max(axis=1, initial=0) <= RADIUS]
            a, b = ids[part], ids[part + lag]
            near = (root[a] != root[b]) & (np.bitwise_count(bits[a] ^ bits[b]) <= RADIUS)
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                if (p := find(x)) != (q := find(y)):
                    root[max(p, q)] = min(p, q)
                    found.append((x, y))
        while (flat := root[root]).tolist() != root.tolist():
            root[:] = flat
        lag += 1
        at = at[at + lag < len(rows)]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": values[pairs[:, 0]], "b": values[pairs[:, 1]]})


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are ``RADIUS`` or fewer bits apart."""
    dealt, n = deal(cut(pivot_table(classes)))
    chunks = max(classes.sparkSession.sparkContext.defaultParallelism, n // CHUNK_ROWS + 1)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)))
    return dealt.groupBy("chunk").applyInPandas(lambda rows: _links(rows), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``.

    component_id is the smallest doc_id reachable over links, the document's own included. Texts that are null, empty or
    of blanks have fingerprint 0 and link like any other; fewer than three words form one shingle; whole texts are read, of
    any length. Repeated rows stay. A null doc_id takes part, but is never chosen: component_id is null only where a
    component has no other id. An empty table gives no rows; columns besides doc_id and text are not read.
    """
    prints = cut(fingerprints(docs))
    named = _components(prints)
    return prints.join(named, "fp").select("doc_id", "fp", F.col("kept.doc_id").alias("component_id"))


def _components(prints: DataFrame) -> DataFrame:
    """(fp, kept) for each fingerprint of ``prints`` (doc_id, mark, fp): the least (no_id, doc_id, mark) of its component."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    classes = cut(prints.groupBy("fp").agg(F.min(rank).alias("first")))
    roots = components(links(classes))
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("kept"))
    named = cut(joined.join(least, "root").select("fp", "kept"))
    return small(named, named.count())


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id. Of rows that repeat it one stays.

    A row is told by its doc_id and text, so rows that share a doc_id with another text are judged on their own; a row
    without doc_id stays only if its component has none with an id. Null, empty and wordless texts are one component. An
    empty table gives none; other columns, of any name, stay as they are.
    """
    prints = cut(fingerprints(docs))
    told = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    marked = prints.join(_components(prints), "fp").groupBy("doc_id", "mark").agg(F.first(told == F.col("kept")).alias("stays"), F.count("*").alias("n"))
    marked = cut(marked.where("not stays or n > 1").select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "stays"))
    rows = docs.select(packed(docs), F.col("doc_id").alias("key"), F.xxhash64("text").alias("mark"))
    found = rows.join(small(marked, marked.count()), F.col("key").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left")
    rest = found.where("stays is null").select("row")
    if not marked.where("stays").isEmpty():
        rest = rest.union(found.where("stays").dropDuplicates(["key", "mark"]).select("row"))
    return rest.select(*unpacked(docs))
