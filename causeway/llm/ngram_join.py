"""Exact n-gram Jaccard self-join as a blocked sparse product of the document by n-gram incidence.

1. Documents with equal shingle sets form one class (a map-side combined minimum), so copies cost nothing later.
2. Shingles are ordered by document frequency, rare first. Two sets with Jaccard t share one of the first
   n - ceil(t n) + 1 shingles of each. All incidences are dealt out once by ranges of shingle values, packed; back come
   only those of shingles that several classes have, and of these only the ones inside a prefix go on. Shingles that
   more than HOT_CLASSES classes may have (a bounded list, found by lossy counting while the features are made) stand
   last in that order whatever their exact frequency, so they needn't be dealt out: a task sees for itself which few of
   them a class needs in its prefix. So no range grows with a line that many documents share.
3. Classes of similar size that share a prefix shingle are joined by star edges (one for each row, never all pairs)
   into candidate clusters, and only these are read again with their texts.
4. Each cluster's rows of the incidence matrix are cut into blocks of bounded size, in bands of set sizes whose width is
   the threshold: blocks more than one band apart can't hold a link. Each pair of blocks is one task: the product of the
   two sparse incidence blocks accumulates the overlaps; pairs below the size bound t * max(n) > min(n) are discarded,
   the rest are decided exactly. A task returns a spanning forest and link counts, which are linear in its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.components import components
from causeway.llm.textbatch import blocks, buffers, shingle_sets
from causeway.runtime import discard, give_back, lean, ship, staged

#: Classes and shingles of one block; columns of one dense step of the product; pairs of rows up to which a column stays sparse.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS, SPARSE = 1024, 1 << 19, 1024, 16
#: Shingles that a task packs or counts at a time, those of one range of values, ranges that a task gets if that makes
#: no more than so many tasks.
PACK, RANGE, RANGES, TASKS = 1 << 20, 1 << 18, 4, 100_000
#: In a window of PACK shingles those of fewer classes aren't counted; a shingle is hot if the others add up to this many
#: classes, or to a share of all incidences of one in HOT_MOST, so that there are HOT_MOST hot shingles at most.
WINDOW_LEAST, HOT_CLASSES, HOT_MOST = 8, 1 << 16, 1 << 20
#: Class representatives up to which they are broadcast (16 bytes each); beyond, the join with the texts is shuffled.
BROADCAST_ROWS = 1_000_000
FEATURES = "doc_id long, n long, m long, sig binary, node long, tokens array<long>, counts array<long>"


def _digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _node(sig: bytes) -> int:
    """A class's number in the search for candidates; equal numbers of different sets only widen a cluster."""
    return int.from_bytes(sig[:8], "little", signed=True)


def _short(s: np.ndarray) -> np.ndarray:
    """The distinct upper 48 bits of sorted hashes."""
    t = (s >> np.uint64(16)).astype(np.int64)
    return t[np.diff(t, prepend=-1) != 0]


def _features(k: int):
    """For each document its doc_id, number of shingles (and of their 48-bit forms), signature and node, and text_sha256 if
    its frame has that column; besides, rows without a signature that list the frequent shingles of a window and in how
    many of its classes each is."""

    def frequent(window: dict[int, np.ndarray], names: list[str]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(list(window.values())), return_counts=True)
        often = count >= WINDOW_LEAST
        lists = {"tokens": token[often], "counts": count[often]}
        columns = [pa.array([lists[x]], pa.list_(pa.int64())) if x in lists else pa.nulls(1, {"sig": pa.binary(), "text_sha256": pa.binary()}.get(x, pa.int64())) for x in names]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, size, names = {}, 0, []
        for part, data, offsets in blocks(batches):
            sets = shingle_sets(data, offsets, k)
            sigs = [_digest(s) for s in sets]
            nodes, short = [_node(x) for x in sigs], [_short(s) for s in sets]
            more = [x for x in part.schema.names if x == "text_sha256"]
            none = pa.nulls(len(sets), pa.list_(pa.int64()))
            names = ["doc_id", "n", "m", "sig", "node", "tokens", "counts", *more]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([len(s) for s in short], pa.int64()), pa.array(sigs, pa.binary()), pa.array(nodes, pa.int64()), none, none, *[part.column(part.schema.get_field_index(x)) for x in more]], names)
            for node, s in zip(nodes, short, strict=True):
                if len(s) and node not in window:
                    window[node] = s
                    size += len(s)
            if size > PACK:
                yield frequent(window, names)
                window, size = {}, 0
        if window:
            yield frequent(window, names)

    return lean(run)


def _signed(k: int):
    """Rows (sig, text) of texts with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in blocks(batches):
            sets = shingle_sets(data, offsets, k)
            some = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(sets[i]) for i in some], pa.binary()), part.column(part.schema.get_field_index("text")).take(pa.array(some, pa.int64()))], ["sig", "text"])

    return lean(run)


def _is_hot(token: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(token), bool)
    return hot[np.minimum(np.searchsorted(hot, token), len(hot) - 1)] == token


def _packed(k: int, ranges: int, hot: np.ndarray, slots: np.ndarray):
    """Rows (slot, range, blob): the window's distinct (shingle, class) incidences of one range of shingle values, packed.

    A shingle stands as the upper 48 bits of its hash. A blob holds the classes' nodes, the sorted shingles as
    differences, and for each its class. Equal sets in a window are packed once; hot shingles are left out.
    """

    def emit(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        nodes = np.fromiter(sets, np.int64, len(sets))
        token, of = np.concatenate(list(sets.values())), np.repeat(np.arange(len(nodes)), [len(s) for s in sets.values()])
        order = np.argsort(token)
        token, of = token[order], of[order]
        which = (token >> 16) * ranges >> 32
        first = np.flatnonzero(np.diff(which, prepend=-1))
        blobs = []
        for a, b in zip(first, [*first[1:], len(token)], strict=True):
            own, local = np.unique(of[a:b], return_inverse=True)
            step = np.diff(token[a:b], prepend=token[a])
            width = 4 if int(step.max()) < 1 << 32 else 8
            head = np.array([len(own), b - a, width, int(token[a])], np.uint64)
            blobs.append(b"".join(x.tobytes() for x in (head, nodes[own], step.astype(f"<u{width}"), local.astype(_index(len(own))))))
        return pa.RecordBatch.from_arrays([pa.array(slots[which[first] % len(slots)]), pa.array(which[first]), pa.array(blobs, pa.binary())], ["slot", "range", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = {}, 0
        for _, data, offsets in blocks(batches):
            for s in shingle_sets(data, offsets, k):
                if len(s) and (node := _node(_digest(s))) not in waiting:
                    t = _short(s)
                    waiting[node] = t = t[~_is_hot(t, hot)]
                    size += len(t)
            if size > PACK:
                yield emit(waiting)
                waiting, size = {}, 0
        if size:
            yield emit(waiting)

    return lean(run)


def _hot_parts(k: int, percent: int, hot: np.ndarray):
    """Rows (node, n_hot, tokens) of classes with hot shingles: how many, and the first of them that its prefix may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in blocks(batches):
            out = {}
            for s in shingle_sets(data, offsets, k):
                t = _short(s)
                if len(own := t[_is_hot(t, hot)]):
                    wanted = len(s) - (percent * len(s) + 99) // 100 + 1 + 2 * (len(s) - len(t))
                    out[_node(_digest(s))] = len(own), own[: max(0, wanted - (len(t) - len(own)))]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([n for n, _ in out.values()], pa.int64()), pa.array([t for _, t in out.values()], pa.list_(pa.int64()))], ["node", "n_hot", "tokens"])

    return lean(run)


def _index(n: int) -> str:
    return "<u2" if n < 1 << 16 else "<u4"


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, and the node of each."""
    docs, size, width, first = (int(x) for x in np.frombuffer(blob, np.uint64, 4))
    at = 32
    out = []
    for kind, many in (("<i8", docs), (f"<u{width}", size), (_index(docs), size)):
        out.append(np.frombuffer(blob, kind, many, at))
        at += out[-1].nbytes
    nodes, step, local = out
    return np.cumsum(step, dtype=np.int64) + first, nodes[local]


def _shared(table: pa.Table) -> pa.Table:
    """Incidences of the shingles of one range that more than one class has, with the number of classes."""
    token, node = (np.concatenate(x) for x in zip(*[_unpacked(b.as_py()) for b in table["blob"]], strict=True))
    order = np.argsort(token)
    token, node = token[order], node[order]
    first = np.flatnonzero(np.diff(token, prepend=-1))
    often = np.repeat(np.diff(first, append=len(token)) > 1, np.diff(first, append=len(token)))
    token, node = token[often], node[often]
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.ones(len(token), bool)  # a class may come from several windows
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node = token[new], node[new]
    first = np.flatnonzero(np.diff(token, prepend=-1))
    df = np.repeat(np.diff(first, append=len(token)), np.diff(first, append=len(token)))
    some = df > 1
    out = pa.table({"token": token[some], "node": node[some], "df": df[some].astype(np.int64)})
    give_back()
    return out


def _slots(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of n partitions that hash partitioning puts there, so that ranges are dealt out evenly."""
    ids = spark.range(16 * n + 64).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    return np.array(sorted(r[0] for r in ids.groupBy("p").agg(F.min("id")).select("min(id)").collect()), np.int64)


def _candidates(docs: DataFrame, features: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Star edges (a, b) between classes of similar size that share a shingle of both their prefixes, staged.

    Of a set of n shingles the prefix has n - ceil(t n) + 1, rarest first by document frequency, hot ones last. Shingles
    that no other class has come before all others, so only how many there are matters.
    """
    total = int(classes.agg(F.sum("n")).first()[0] or 0)
    ranges = max(1, -(-total // RANGE))
    tasks = min(TASKS, -(-ranges // RANGES))
    counted = features.where("sig IS NULL").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("c"))
    hot = np.array(sorted(r[0] for r in counted.where(F.col("c") > max(HOT_CLASSES, total // HOT_MOST)).select("token").collect()), np.int64)
    packed = docs.mapInArrow(_packed(k, ranges, hot, _slots(docs.sparkSession, tasks)), "slot long, range long, blob binary")
    shared = packed.repartition(tasks, "slot").groupBy("slot", "range").applyInArrow(_shared, "token long, node long, df long")
    sizes = classes.groupBy("node").agg(F.max("n").alias("n"), F.max("m").alias("m"))
    if len(hot):
        parts = docs.mapInArrow(_hot_parts(k, percent, hot), "node long, n_hot long, tokens array<long>").groupBy("node").agg(F.max("n_hot").alias("n_hot"), F.first("tokens").alias("tokens"))
        sizes = sizes.join(parts.select("node", "n_hot"), "node", "left").select("node", "n", "m", (F.col("m") - F.coalesce("n_hot", F.lit(0))).alias("rest"))
        shared = shared.unionByName(parts.select(F.explode("tokens").alias("token"), "node", F.lit(1 << 62).alias("df")))
    else:
        sizes = sizes.withColumn("rest", F.col("m"))
    own = Window.partitionBy("node")
    known = shared.join(sizes.hint("shuffle_hash"), "node")
    placed = known.withColumn("at", F.row_number().over(own.orderBy("df", "token"))).withColumn("many", F.count(F.when(F.col("df") < 1 << 62, 1)).over(own))
    wanted = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1 + 2 * (F.col("n") - F.col("m"))
    prefix = placed.where(F.col("at") <= wanted - (F.col("rest") - F.col("many")))
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent)) + 1e-9).cast("int")
    keyed = staged(prefix.select("token", "node", F.explode(F.array(band, band + 1)).alias("band")), "prefixes")
    centre = keyed.groupBy("token", "band").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").drop("b")
    stars = staged(keyed.join(centre, ["token", "band"]).where("node <> a").select("a", F.col("node").alias("b")), "stars")
    discard(keyed)
    return stars


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of left with right sets: the product of two sparse 0/1 incidence blocks.

    A column that few pairs of rows share adds to just those pairs. Of the others, columns with the same rows count as
    one with a weight, and go through a dense product, COLUMNS at a time, in floats that hold every possible sum exactly.
    """
    m, total = len(right), len(left) + len(right)
    h = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(total), [len(s) for s in (*left, *right)])
    order = np.argsort(h)
    row, h = row[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(h))
    above = np.add.reduceat(row < len(left), first, dtype=np.int64) if len(h) else size
    pairs = above * (size - above)
    out = np.zeros((len(left), m), np.int64)
    light = (pairs > 0) & (pairs <= SPARSE)
    for few in np.unique(size[light]).tolist():
        rows = row[first[light & (size == few)][:, None] + np.arange(few)]
        a, b = np.repeat(rows, few, 1).ravel(), np.tile(rows, few).ravel()
        both = (a < len(left)) & (b >= len(left))
        code, n = np.unique(a[both] * m + b[both] - len(left), return_counts=True)
        out.ravel()[code] += n
    dense = np.flatnonzero(pairs > SPARSE)
    if not len(dense):
        return out
    # a column's rows by a sum of fixed random numbers, so that equal ones are found without building them
    mark = np.random.default_rng(1).integers(0, 1 << 63, total).astype(np.uint64)
    sums = np.add.reduceat(mark[row], first)[dense]
    _, kind, weight = np.unique(sums, return_index=True, return_counts=True)
    kind = dense[kind]
    for a in range(0, len(kind), COLUMNS):
        some = kind[a : a + COLUMNS]
        n = size[some]
        column = np.repeat(np.arange(len(some)), n)
        rows = row[np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        wide = np.zeros((total, len(some)))
        wide[rows, column] = 1
        out += ((wide[: len(left)] * weight[a : a + COLUMNS]) @ wide[len(left) :].T).round().astype(np.int64)
    return out


def links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union; empty sets link with nothing."""
    n, m = (np.array([len(s) for s in x], np.int64)[:, None] for x in (left, right))
    near = (100 * np.minimum(n, m.T) >= percent * np.maximum(n, m.T)) & (np.minimum(n, m.T) > 0)
    if not near.any():
        return near
    both = overlaps(left, right)
    return near & (100 * both >= percent * (n + m.T - both))


def _roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the smallest member of each row's component."""
    label = np.arange(len(linked))
    while True:
        best = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _solve(k: int, percent: int):
    """For one pack of clusters or one pair of blocks: (a, b, links, whole), a class, the root it reaches there, and its links."""

    def linked_in(own: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of a symmetric matrix of links, and the matrix."""
        if not side[own].any():
            out = links(s := [sets[i] for i in own], s, percent)
            np.fill_diagonal(out, False)
            return own, out
        a, b = own[side[own] == 1], own[side[own] == 2]
        out = np.zeros((len(a) + len(b),) * 2, bool)
        if len(a) and len(b):
            out[: len(a), len(a) :] = links([sets[i] for i in a], [sets[i] for i in b], percent)
            out[len(a) :, : len(a)] = out[: len(a), len(a) :].T
        return np.concatenate([a, b]), out

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data, offsets = buffers(table["text"])
        sigs, cluster, side = table["sig"].to_pylist(), table["cluster"].to_numpy(), table["side"].to_numpy()
        weight, whole = table["size"].to_numpy(), table["whole"].to_pylist()
        sets, seen, mine = [], set(), []
        for first in range(0, len(sigs), 64):
            at = offsets[first : first + 65]
            sets += shingle_sets(data[at[0] : at[-1]], at - at[0], k)
        for i, s in enumerate(sets):  # rows of another text of the same doc_id, and repeated rows, are none of the class
            if (sigs[i], side[i]) not in seen and _digest(s) == sigs[i]:
                seen.add((sigs[i], side[i]))
                mine.append(i)
        mine = np.array(sorted(mine, key=lambda i: (cluster[i], sigs[i])), np.int64)
        out: list[tuple] = []
        for own in np.split(mine, np.flatnonzero(np.diff(cluster[mine])) + 1):
            if len(own) < 2:
                continue
            rows, linked = linked_in(own, side, sets)
            n, root = linked @ weight[rows], _roots(linked)
            out += [(sigs[rows[i]], sigs[rows[root[i]]], int(n[i]), whole[rows[i]]) for i in np.flatnonzero(linked.any(1))]
        columns = list(zip(*out, strict=True)) or [()] * 4
        made = pa.table({c: pa.array(v, t) for c, v, t in zip(("a", "b", "links", "whole"), columns, (pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)})
        give_back()
        return made

    return run


def _placed(members: DataFrame, percent: int) -> DataFrame:
    """Members of clusters with the block pairs they take part in: (group key, cluster, sig, rep, size, side, whole)."""
    stats = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    big = (F.col("m") > BLOCK_ROWS) | (F.col("total") > BLOCK_SHINGLES)
    known = members.join(stats, "cluster")
    packs = F.greatest(F.lit(1), F.ceil(stats_total(members) / F.lit(BLOCK_SHINGLES // 4)))
    small = known.where(~big).select(F.pmod(F.xxhash64("cluster"), packs).alias("pack"), F.lit(0).alias("ba"), F.lit(0).alias("bb"), F.lit(0).alias("sa"), F.lit(0).alias("sb"), "cluster", "sig", "rep", "size", F.lit(0).alias("side"), F.lit(True).alias("whole"))
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")
    large = known.where(big).select("cluster", "sig", "rep", "size", "n", band.alias("band"))
    bands = large.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("subs"))
    around = large.join(bands, ["cluster", "band"], "left")
    for name, step in (("below", 1), ("above", -1)):
        around = around.join(bands.select("cluster", (F.col("band") + step).alias("band"), F.col("subs").alias(name)), ["cluster", "band"], "left")
    sub = F.pmod(F.xxhash64("sig"), F.col("subs")).cast("int")
    upto = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda ba, bb, sa, sb, side: F.struct(ba.alias("ba"), bb.alias("bb"), sa.alias("sa"), sb.alias("sb"), side.alias("side"))
    at = F.col("band")
    around = around.withColumn("sub", sub)
    mine = F.col("sub")
    cells = F.concat(
        F.transform(upto("subs"), lambda s: cell(at, at, F.least(mine, s), F.greatest(mine, s), F.when(s == mine, 0).when(mine < s, 1).otherwise(2))),
        F.transform(upto("above"), lambda s: cell(at, at + 1, mine, s, F.lit(1))),
        F.transform(upto("below"), lambda s: cell(at - 1, at, s, mine, F.lit(2))),
    )
    spread = around.select("cluster", "sig", "rep", "size", F.explode(cells).alias("c")).select(F.col("cluster").alias("pack"), "c.ba", "c.bb", "c.sa", "c.sb", "cluster", "sig", "rep", "size", "c.side", F.lit(False).alias("whole"))
    return small.unionByName(spread)


def stats_total(members: DataFrame):
    """All shingles of clustered classes, as a literal."""
    return F.lit(int(members.agg(F.sum("n")).first()[0] or 0))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, n_links.

    Words are maximal runs of anything but space, tab, LF, VT, FF and CR, with A-Z lower-cased; a document's set is its
    distinct k-word shingles, or its whole sequence if it has fewer words. Two documents link when
    100 * intersection >= percent * union. component_id is the smallest doc_id reachable; n_links counts the documents
    linked directly, equal ones included. Null and blank texts have no shingles, no links and their own doc_id as
    component. Repeated rows count as documents of their own; a null doc_id never names a component unless all its
    members have none. Other columns are ignored. An empty table gives no rows.
    """
    features, full = _solved(docs.select("doc_id", "text"), k, percent)
    least = full.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = full.join(least, "root").select("sig", "component_id", (F.coalesce("near", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = features.where("sig IS NOT NULL").join(known, "sig", "left")
    out = staged(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "components")
    discard(features, full)
    return out


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, text_sha256) of docs(doc_id, text) to drop so that one text of each component stays.

    Of a component the row with the smallest doc_id stays, one without a doc_id only if no member has one; of equal or
    missing ids the text with the smallest SHA-256. Documents are told apart by doc_id and text together, so texts that
    share a doc_id, or have none, are judged each for itself. Rows equal in both are one. Texts without shingles stay.
    """
    features, full = _solved(docs.select("doc_id", "text", text_digest("text").alias("text_sha256")), k, percent)
    least = full.groupBy("root").agg(F.min("first").alias("stays"))
    known = full.join(least, "root").select("sig", "stays")
    out = staged(features.join(known, "sig").where(_row() != F.col("stays")).select("doc_id", "text_sha256"), "near")
    discard(features, full)
    return out


def text_digest(text: str):
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _row():
    """Orders rows by doc_id, missing ones last, and then by the text's digest; null in no part, so that rows compare by value."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("text_sha256").alias("text_sha256"))


def _solved(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Features of each row, and of each class its root (a signature of its component) and links; with text_sha256, also its first row."""
    ship(docs.sparkSession)
    digests = "text_sha256" in docs.columns
    features = staged(docs.mapInArrow(_features(k), FEATURES + ", text_sha256 binary" * digests), "features")
    docs = docs.select("doc_id", "text")
    first = [F.min(_row()).alias("first")] if digests else []
    classes = features.where("n > 0").groupBy("sig", "node", "n", "m").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), *first)
    stars = _candidates(docs, features, classes, k, percent)
    clusters = components(stars)
    members = staged(classes.join(clusters.withColumnRenamed("component", "cluster"), "node").select("cluster", "sig", "rep", "n", "size"), "members")
    discard(stars, clusters)
    placed = _placed(members, percent)
    reps = members.where("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct()
    few = reps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.join(reps.hint("broadcast" if few else "shuffle_hash"), "doc_id")
    rows = texts.join(placed.withColumnRenamed("rep", "doc_id"), "doc_id").drop("doc_id")
    if members.where("rep IS NULL").first() is not None:
        # classes without any doc_id: their texts are found by signature, one for each class
        nameless = docs.where("doc_id IS NULL").mapInArrow(_signed(k), "sig binary, text string")
        wanted = members.where("rep IS NULL").select("sig")
        one = nameless.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("text").alias("text"))
        rows = rows.unionByName(one.join(placed.where("rep IS NULL").drop("rep"), "sig"))
    key = ["pack", "ba", "bb", "sa", "sb"]
    found = staged(rows.groupBy(*key).applyInArrow(_solve(k, percent), "a binary, b binary, links long, whole boolean"), "links")
    across = components(found.where("not whole"))
    of = found.where("whole").select(F.col("a").alias("sig"), F.col("b").alias("root")).unionByName(across.select(F.col("node").alias("sig"), F.col("component").alias("root")))
    counts = found.groupBy(F.col("a").alias("sig")).agg(F.sum("links").alias("near"))
    full = staged(classes.join(of, "sig", "left").join(counts, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "classes")
    discard(members, found, across)
    return features, full
