"""N-gram Jaccard join: count vectors in R-trees.

A document is the set of its word n-grams. Tokens are hashed into groups, and the counts of a document's tokens by
group are a point. min(x_g, y_g) summed over groups bounds the overlap of two documents from above; over nodes of an
R-tree, whose boxes hold the largest counts, the same sum bounds all pairs below. Pairs that survive are verified on the
sets, so the join is exact.

In many dimensions the boxes of a tree over a whole corpus overlap, and its search would be quadratic. So trees are
built over regions that the groups themselves give. Two sets that differ in at most d tokens differ in at most d
groups: of d + 1 groups that are not empty, one has the same tokens in both. A region is a group's number, count and
checksum; documents meet only there. Linked sets share more than one region, so a set leaves out as many of its commonest
ones as it may: what is common to many long texts does not bring all of them together. Per region the documents are first held against the region's smallest id (a hub):
a number of pairs in proportion to the documents, which joins copies and near copies of a group however large it is. Only
where a region of three or more still holds several components are its documents put into R-trees and joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, by_bytes, checkpointed, column, fresh_names, gram_hashes, mix, slices, trimmed, word_hashes, written
from .components import connected_components

#: Sizes of one class differ by this factor at most.
CLASS_RATIO = 1.5
#: Coordinates of a point; twice as many as often as a set has more than PER_DIMENSION tokens for each, as large counts are all alike.
DIMENSIONS = 128
PER_DIMENSION = 8
#: Documents of one tile, over which a tree is built in memory.
TILE = 1024
#: Documents of a region that are gathered into one row, to find regions that hold the same ones.
GATHERED = 8192
#: The bits of a set's mark that say how many of its regions may be left out.
SPARE = (1 << 24) - 1
#: Ids that are sent to all executors at most; beyond it, tables are joined by shuffle.
FEW_IDS = 200_000


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of each text; with fewer words, of the whole text as one; none without words."""
    words, at = word_hashes(texts)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b| for sorted distinct hashes; empty sets are linked with nothing."""
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def size_classes(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(class, most differing tokens, groups) for a set of n: its own class, and the one below if a member may be linked to it."""
    out = []
    c = int(math.floor(math.log(n) / math.log(CLASS_RATIO) + 1e-9))
    for k in (c, c - 1, c - 2):
        if k < 0:
            continue
        upper = int(math.ceil(CLASS_RATIO ** (k + 1))) - 1  # largest size of the class
        lower = math.ceil(CLASS_RATIO**k)
        if k < c and (n * num > upper * den or upper < lower):
            continue
        differ = (den - num) * (upper + upper * den // num) // (den + num)
        out.append((k, differ, differ + 1 + (0 if differ == 0 else 2 + math.ceil(0.06 * differ))))
    return out


def region_sets(tokens: np.ndarray, num: int, den: int) -> list[tuple[int, np.ndarray]]:
    """The regions of a set by size class: how many a linked set of that class shares with it besides one, and their keys.

    So many may be left out, if all sets leave out the last ones of the same order: linked sets still share their first one.
    """
    n, out = len(tokens), []
    spread = mix(tokens + np.uint64(0x51ED270B))
    classes = size_classes(n, num, den)
    with np.errstate(over="ignore"):
        for c, _, groups in classes:
            group = (spread % np.uint64(groups)).astype(np.int64)
            low = np.bincount(group, (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64), groups)
            high = np.bincount(group, (tokens >> np.uint64(32)).astype(np.float64), groups)
            count = np.bincount(group, minlength=groups)
            some = np.flatnonzero(count)
            key = mix(low[some].astype(np.uint64) + mix(high[some].astype(np.uint64) + mix((some * 4096 + c).astype(np.uint64) + (count[some].astype(np.uint64) << np.uint64(40)))))
            # in a class below its own, the set meets only the sets of that class
            most = n * den // num if c == classes[0][0] else min(n * den // num, math.ceil(CLASS_RATIO ** (c + 1)) - 1)
            differ = (den - num) * (n + most) // (den + num)
            out.append((max(len(some) - differ - 1, 0), key))
            if len(some) <= differ:
                # so many empty groups that two such sets may share no other: they share most of their tokens
                out.append((-(-n * num // den) - 1, mix(tokens ^ np.uint64(0xA5A5 + c))))
    return out


def regions(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the regions of a set, such that linked sets share one."""
    return np.concatenate([keys for _, keys in region_sets(tokens, num, den)])


def marked(spare: int, keys: np.ndarray) -> int:
    """A number that tells the sets of one id apart; its last 24 bits are `spare`."""
    return (int(np.bitwise_xor.reduce(keys).view(np.int64)) & ~SPARE) | min(spare, SPARE)


def dimensions(n: int) -> int:
    return DIMENSIONS << max(0, math.ceil(math.log2(max(n, 1) / (DIMENSIONS * PER_DIMENSION))))


def count_vector(tokens: np.ndarray, size: int = DIMENSIONS) -> np.ndarray:
    return np.bincount((mix(tokens) % np.uint64(size)).astype(np.int64), minlength=size).astype(np.int32)


def folded(points: list[bytes]) -> np.ndarray:
    """Points as rows of as many coordinates as the shortest has; a coordinate kept as 65535 may be larger, and is a million or more."""
    size = min(map(len, points)) // 2
    if max(map(len, points)) == 2 * size:
        out = np.frombuffer(b"".join(points), "<u2").reshape(-1, size).astype(np.int32)
        out[out == 65535] = 1 << 20
        return out
    out = np.empty((len(points), size), np.int32)
    for row, p in zip(out, points, strict=True):
        point = np.frombuffer(p, "<u2").reshape(-1, size).astype(np.int32)
        point[point == 65535] = 1 << 20
        point.sum(axis=0, out=row)
    return out


class CountTree:
    """An R-tree over count vectors, packed level by level after sorting; a node's box is kept by its upper corner and its smallest size."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = self._tiled(np.arange(len(points)), 0)
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            corner, size = self.levels[-1]
            starts = np.arange(0, len(corner), self.FAN)
            self.levels.append((np.maximum.reduceat(corner, starts, axis=0), np.minimum.reduceat(size, starts)))

    def _tiled(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """Sort-tile order: by size first, then by the coordinate that varies most."""
        if len(rows) <= self.FAN or depth > 12:
            return rows
        key = self.sizes[rows] if depth == 0 else self.points[rows][:, self.points[rows].var(axis=0).argmax()]
        rows = rows[np.argsort(key, kind="stable")]
        half = -(-len(rows) // (2 * self.FAN)) * self.FAN
        return np.concatenate((self._tiled(rows[:half], depth + 1), self._tiled(rows[half:], depth + 1)))

    def pairs(self, num: int, den: int):
        """Arrays of point pairs whose bound allows a link, a chunk of 2048 pairs (fewer of longer points) at a time.

        A chunk makes FAN x FAN pairs each of the level below, which wait on the stack: half a million, some 8 MB a level.
        """
        chunk = max(16, (1 << 18) // self.points.shape[1])
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            if len(i) > chunk:
                todo += [(level, i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]
                continue
            corner, size = self.levels[level]
            bound = np.minimum(corner[i], corner[j]).sum(axis=1)
            keep = (den + num) * bound >= num * (size[i] + size[j])
            i, j = i[keep], j[keep]
            if level == 0:
                apart = i != j
                if apart.any():
                    yield self.order[i[apart]], self.order[j[apart]]
                continue
            if len(i):
                n = len(self.levels[level - 1][0])
                steps = np.arange(self.FAN)
                a = np.repeat((i[:, None] * self.FAN + steps)[:, :, None], self.FAN, axis=2).reshape(len(i), -1)
                b = np.repeat((j[:, None] * self.FAN + steps)[:, None, :], self.FAN, axis=1).reshape(len(j), -1)
                fine = (a < n) & (b < n) & (a <= b)
                todo.append((level - 1, a[fine], b[fine]))


def tree_links(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join differently labelled documents: enough of them to make the labels' components those of all links."""
    size = dimensions(max(map(len, sets)))
    tree = CountTree(np.stack([count_vector(s, size) for s in sets]), np.array([len(s) for s in sets]))
    labels, out = labels.copy(), []
    for i, j in tree.pairs(num, den):
        apart = labels[i] != labels[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            if labels[a] != labels[b] and linked(sets[a], sets[b], num, den):
                out.append((a, b))
                labels[labels == labels[b]] = labels[a]
    return out


def undecided(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each document the first of those that possible links between different labels connect it with; -1 for none.

    With documents in order of their ids, those of one group have few firsts over all its regions.
    """
    root = np.arange(len(sizes))
    some = np.zeros(len(sizes), bool)
    for i, j in CountTree(points, sizes).pairs(num, den):
        apart = labels[i] != labels[j]
        i, j = i[apart], j[apart]
        some[i] = some[j] = True
        while len(i):
            least = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            root = root[root]
            if (root == before).all():
                break
    return np.where(some, root, -1)


def _texts(df: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    return df.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _per_text(words: int, of):
    """A mapInArrow function from (doc_id, text): of(set) gives the values of the other columns."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [of(s) for a, b in by_bytes(texts) for s in shingle_sets(texts[a:b], words)]
            yield batch.column(0), rows
        trimmed()

    return run


def _verified(pairs: DataFrame, known: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose texts are linked."""
    involved = checkpointed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = _texts(known, involved, involved.count() <= FEW_IDS)
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "text", "a_text")

    def verify(batches):
        last, last_set = None, None
        for batch in batches:
            others, texts = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            good: list[bool] = []
            for a, b in by_bytes(texts):
                for s, h in zip(shingle_sets(texts[a:b], words), others[a:b], strict=True):
                    if h != last:
                        last, last_set = h, shingle_sets([h], words)[0]
                    good.append(linked(s, last_set, num, den))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
        trimmed()

    return both.mapInArrow(verify, "a long, b long")


def jaccard_components(df: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for each row of df.

    Two documents are linked when their sets of word n-grams have a Jaccard similarity of at least similarity[0] /
    similarity[1]; component_id is the smallest id that links lead to. Words are runs without ASCII white space, A-Z as
    a-z. A text of fewer words is one n-gram; null, empty and blank texts have none and are linked with nothing. Ids are
    integers; rows of one id are one document with several sets. A null id keeps its row, with a null component.
    """
    num, den = similarity
    docs = df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def keys(batches):
        for ids, found in _per_text(words, lambda s: (len(s), region_sets(s, num, den) if len(s) else []))(batches):
            sets = [one for _, own in found for one in own]
            ends = [np.cumsum([0, *(len(k) for k in some)]).astype(np.int32) for some in ((own for _, own in found), (keys for _, keys in sets))]
            flat = np.concatenate([np.zeros(0, np.int64), *(k.view(np.int64) for _, k in sets)])
            each = pa.StructArray.from_arrays([pa.array([marked(*one) for one in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends[1]), pa.array(flat))], ["mark", "regions"])
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends[0]), each)], ["doc_id", "n_shingles", "sets"])

    def points(batches):
        for ids, found in _per_text(words, lambda s: (len(s), np.minimum(count_vector(s, dimensions(len(s))), 65535).astype("<u2").tobytes()))(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], ["doc_id", "n", "point"])

    # every text is hashed once for its size and its regions, which both passes over the regions read again
    hashed = written(docs.mapInArrow(keys, "doc_id long, n_shingles long, sets array<struct<mark: long, regions: array<long>>>"))
    every = hashed.filter("doc_id IS NOT NULL").select("doc_id", F.explode("sets").alias("s")).select("doc_id", "s.mark", F.explode("s.regions").alias("region"))
    shared = checkpointed(every.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # of the regions that linked sets share, the rarest is enough: a set leaves out as many of its commonest as it may
    place = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(F.desc("n"), "region"))
    in_region = checkpointed(every.join(shared, "region").withColumn("place", place).filter(F.col("place") > F.col("mark").bitwiseAND(F.lit(SPARE))).select("doc_id", "region"))
    shared = checkpointed(in_region.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # regions with the same documents are one; a very large region keeps its own rows
    usual, large = shared.filter(F.col("n") <= GATHERED).select("region"), shared.filter(F.col("n") > GATHERED)
    met = in_region.join(usual, "region", "left_semi")
    places = met.groupBy("region").agg(F.sort_array(F.collect_set("doc_id")).alias("ids")).filter(F.size("ids") > 1).select("ids").distinct()
    places = places.select("ids", F.lit(None).cast("long").alias("region"), F.size("ids").cast("long").alias("n"))
    if not large.isEmpty():
        rows = in_region.join(large, "region")
        places = places.unionByName(rows.join(rows.groupBy("region").agg(F.min("doc_id").alias("hub")), "region").select(F.array("hub", "doc_id").alias("ids"), "region", "n"))
    places = checkpointed(places)

    # every document against the hub of each of its regions
    spokes = places.select(F.element_at("ids", 1).alias("a"), F.explode(F.slice("ids", F.lit(2), F.size("ids"))).alias("b")).filter("a <> b").distinct()
    spokes = checkpointed(spokes)
    involved = checkpointed(spokes.select(F.col("a").alias("doc_id")).union(spokes.select("b")).distinct())
    vectors = checkpointed(_texts(known, involved, involved.count() <= FEW_IDS).mapInArrow(points, "doc_id long, n long, point binary"))
    # first against the smallest of its hubs alone: a link a document, where a large group has one a region
    nearest = spokes.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = lambda pairs: _verified(checkpointed(_bounded(pairs, vectors, num, den)), known, words, num, den)
    near = checkpointed(connected_components(links(nearest)))
    fine = _merged(near, links(_apart(spokes, near)))
    labels = _joined(known, places, vectors, fine, words, num, den)
    own = labels.select(F.col("id").alias("doc_id"), F.col("label").alias("component_id"))
    return hashed.select("doc_id", "n_shingles").join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels; what has none is its own."""
    a, b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b"))
    both = pairs.join(b, "b", "left").join(a, "a", "left")
    return both.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, label) after further links (a, b): between labels, so that each pair of labels is one link."""
    a, b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b"))
    between = links.join(b, "b", "left").join(a, "a", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    return _renamed(labels, connected_components(between))


def _renamed(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after components (id, label) of labels were found."""
    found = checkpointed(found).select(F.col("id").alias("own"), F.col("label").alias("merged"))
    everyone = labels.select("id", F.col("label").alias("own")).union(found.select("own", "own")).distinct()
    return checkpointed(everyone.join(found, "own", "left").select("id", F.coalesce("merged", "own").alias("label")))


def _bounded(pairs: DataFrame, vectors: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that the summed minima of their count vectors leave."""
    both = pairs.join(vectors.select(F.col("doc_id").alias("b"), F.col("n").alias("b_n"), F.col("point").alias("b_point")), "b").join(vectors.select(F.col("doc_id").alias("a"), F.col("n").alias("a_n"), F.col("point").alias("a_point")), "a")

    def bound(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(k).to_pylist() for k in ("a_point", "b_point"))
                sizes = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)])
                most = np.zeros(len(a), np.int64)
                for size in np.unique(sizes):
                    for _, at in slices(np.flatnonzero(sizes == size), max(16, (1 << 20) // int(size))):
                        # points as long as the shorter of each pair
                        both = folded([*(a[i] for i in at), *(b[i] for i in at)])
                        most[at] = np.minimum(both[: len(at)], both[len(at) :]).sum(axis=1)
                n = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
                keep = pa.array((den + num) * most >= num * n)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.mapInArrow(bound, "a long, b long").distinct()


def _tiles(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (region, n, id, label) as (call, tile, id, label): a region of more than TILE documents is cut into leaves by
    the ids' hashes, and each pair of leaves is a tile of its own; the tiles of many small regions go to one call."""
    rows = checkpointed(rows)
    count = rows.count()
    calls = blocks_for(count, 16 * TILE, 12)
    leaves = F.ceil(F.col("n") / TILE).cast("int")
    cut = rows.withColumn("leaf", F.pmod(F.xxhash64("id"), leaves).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), leaves - 1)))
    tile = F.xxhash64("region", F.least("leaf", "other"), F.greatest("leaf", "other"))
    return cut.select(F.when(F.col("n") <= TILE, F.pmod("region", F.lit(calls))).otherwise(tile).alias("call"), tile.alias("tile"), "id", "label"), count


def _parts(table: pa.Table):
    """The rows of each tile of a call, in order of their ids."""
    tile = table.column("tile").to_numpy()
    order = np.lexsort((table.column("id").to_numpy(), tile))
    for part in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        if len(part) > 1:
            yield part


def _joined(known: DataFrame, places: DataFrame, vectors: DataFrame, fine: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Labels after the R-tree joins of the regions that hold several components.

    A first pass over the points alone finds which documents may have links to other components. What such links
    connect is one group; the texts of a group are read once, and its trees are joined with verification.
    """
    small = places.filter("region IS NULL AND n > 2").select(F.xxhash64("ids").alias("region"), "n", F.explode("ids").alias("id"))
    large = places.filter("region IS NOT NULL").select("region", "n", F.element_at("ids", 2).alias("id"))
    rows = small.union(large).join(fine, "id", "left").select("region", "n", "id", F.coalesce("label", "id").alias("label"))
    mixed = rows.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("region")
    tiles, count = _tiles(rows.join(mixed, "region", "left_semi"))
    if not count:
        return fine

    def open_(table: pa.Table) -> pa.Table:
        ids, label, size = (table.column(c).to_numpy() for c in ("id", "label", "n"))
        point = table.column("point").to_pylist()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in _parts(table):
            root = undecided(folded([point[i] for i in part]), size[part], label[part], num, den)
            a.append(ids[part[root >= 0]])
            b.append(ids[part[root[root >= 0]]])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    placed = tiles.join(vectors.withColumnRenamed("doc_id", "id"), "id").select("call", "tile", "id", "label", "n", "point")
    ties = checkpointed(placed.groupBy("call").applyInArrow(open_, "a long, b long").distinct())
    if ties.isEmpty():
        return fine
    # a document connects all its firsts, so the firsts alone are a graph: of a large group there are few
    firsts = checkpointed(ties.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("firsts")).select(F.col("a").alias("id"), "firsts"))
    least = F.element_at("firsts", 1)
    group = connected_components(firsts.select(least.alias("a"), F.explode(F.slice("firsts", F.lit(2), F.size("firsts"))).alias("b")))
    rows = firsts.select("id", least.alias("first")).join(group.select(F.col("id").alias("first"), F.col("label").alias("region")), "first", "left").select("id", F.coalesce("region", "first").alias("region")).join(fine, "id", "left")
    rows = checkpointed(rows.select("region", "id", F.coalesce("label", "id").alias("label")))
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    tiles, count = _tiles(rows.join(sizes, "region").select("region", "n", "id", "label"))
    texts = _texts(known, rows.select(F.col("id").alias("doc_id")), count <= FEW_IDS).withColumnRenamed("doc_id", "id")

    def join(table: pa.Table) -> pa.Table:
        label, texts = table.column("label").to_numpy(), table.column("text").to_pylist()
        found_a, found_b = [], []
        for part in _parts(table):
            own = [texts[i] for i in part]
            sets = [s for a, b in by_bytes(own) for s in shingle_sets(own[a:b], words)]
            for i, j in tree_links(sets, label[part], num, den):
                found_a.append(int(label[part[i]]))
                found_b.append(int(label[part[j]]))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    more = checkpointed(tiles.join(texts, "id").select("call", "tile", "id", "label", "text").groupBy("call").applyInArrow(join, "a long, b long"))
    return _renamed(fine, connected_components(more))


def survivors(df: DataFrame, *, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the documents that are not the smallest of their component. Rows of a null id stay."""
    found = jaccard_components(df, words=words, similarity=similarity, id_col=id_col, text_col=text_col)
    (other,) = fresh_names(df, "gone")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(other)).distinct()
    return df.join(gone, column(id_col).cast("long") == F.col(other), "left_anti")

