"""N-gram Jaccard join: MinHash LSH forest over five-word shingles, then exact verification.

Equal texts form a class, and one of each goes on. Each tree of the forest
labels a text with a string of minima, a byte of each; in the order of labels,
the texts below one node of the tree's prefix trie, those with a common prefix,
stand side by side. Prefixes of length d find links of similarity s with a recall
of 1 - (1 - s^d)^trees. They are shortened until that meets the target for links
at the threshold itself, so it is met for all links; what shares a longer prefix
shares this one too, and is verified with the rest.

Only texts that share a node are verified, and of those only texts whose sizes
allow the similarity: a node is divided into overlapping bands of numbers of
shingles, each text standing in two. Each text has a home, the least text
within two nodes' distance; the texts of a home are dealt into blocks of
bounded size, and two blocks make a cell if some node has texts in both. A cell compares its texts
exactly on whole shingle sets, so a chain of ever other near texts costs in
proportion to its length, and a group of texts that are all near each other is
spread over many tasks. Cells return each text's number of links and a spanning
set of links; no list of all pairs is made. Components of the verified links are
the near-duplicate groups.

Defined cases: null counts as the empty text; texts without words link to none;
texts of under five words are one shingle of all their words; rows of one id
and text count once; an id used for several texts has a row for each, with that
text's links; a text that only rows without an id have gets a class id from its
hash, and leads a group only where no text of it has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvidex.llm._session import Scratch, cut
from corvidex.llm._text import mix, shingles, slices, word_hashes

_U = np.uint64


@dataclass(frozen=True)
class JaccardParams:
    similarity: tuple[int, int] = (4, 5)  # least intersection / union
    trees: int = 48
    longest_prefix: int = 12
    recall: float = 0.999999  # of links at the threshold itself
    block: int = 512  # texts of a block; a cell holds two
    block_shingles: int = 1 << 21  # shingles that a block holds on average at most

    def depth(self, similarity: float) -> int:
        """The longest prefix that finds links of ``similarity`` with the target recall."""
        d = self.longest_prefix
        while d > 1 and 1 - (1 - similarity**d) ** self.trees < self.recall:
            d -= 1
        return d

    @property
    def prefix(self) -> int:
        """The prefix that meets the recall for links at the threshold itself."""
        return self.depth(self.similarity[0] / self.similarity[1])


def _labels(params: JaccardParams):
    """mapInArrow: each text's number of different shingles and, for each tree, its node at the prefix that meets the recall."""
    depth = params.prefix
    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**32, params.trees * depth, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, params.trees * depth, dtype=np.uint64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [np.zeros(0, np.int64)], []
            for _, texts in slices(batch, "text"):
                value, row = shingles(*word_hashes(texts))
                some, first = np.unique(row, return_index=True)
                # Bands go by sizes of sets: a text that repeats its shingles is as large as one that has each once.
                order = np.lexsort((value, row))
                new = np.ones(len(order), bool)
                new[1:] = (value[order[1:]] != value[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
                size = np.bincount(row[order[new]], minlength=len(texts))
                node = np.zeros((len(texts), params.trees), _U)
                if len(some):
                    low = (value >> _U(32)).astype(np.uint32)
                    for t in range(params.trees):
                        at = np.full(len(some), t, _U)
                        for k in range(t * depth, (t + 1) * depth):
                            x = mix(np.minimum.reduceat(low * a[k] + b[k], first).astype(_U)) >> _U(56)
                            at = mix(at * _U(0x9DDFEA08EB382D69) + x)
                        node[some, t] = at
                sizes.append(size)
                has = size > 0
                nodes += [node[i].view(np.int64) if has[i] else node[i, :0].view(np.int64) for i in range(len(texts))]
            columns = [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(np.concatenate(sizes)), pa.array(nodes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "size", "nodes"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): root is the smallest node of its component.

    Large-star and small-star rounds until the edges no longer change; each
    round's edges are written to the checkpoint folder.
    """
    edges = edges.where("u <> v")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written, so that the edges of a node with very many can be split over tasks in the join.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
        small = large.join(down, F.col("u") == F.col("at")).select("v", "m", "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _verify(params: JaccardParams):
    """mapInArrow over rows sorted by cell: (c, n_links, linked) of each text in each cell: how many link with it, and the least text that links connect it with."""
    num, den = params.similarity

    def cell(ids: list[int], blocks: list[int], texts: list[str], inner: bool) -> list[tuple[int, int, int]]:
        n = len(ids)
        if n < 2:
            return []
        value, row = shingles(*word_hashes(texts))
        order = np.lexsort((row, value))
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
        size = np.bincount(row, minlength=n)
        start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(value)))
        of = np.repeat(np.arange(len(start)), count)  # each entry's posting list
        shared = count[of] > 1
        by_row = np.argsort(row[shared], kind="stable")
        lists = of[shared][by_row]
        bounds = np.searchsorted(row[shared][by_row], np.arange(n + 1))
        side = np.asarray(blocks)
        links, label, pairs = np.zeros(n, np.int64), np.arange(n), []
        for i in range(n):
            mine = lists[bounds[i] : bounds[i + 1]]
            if not len(mine):
                continue
            c = count[mine]
            at = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            both = np.bincount(row[at], minlength=n)
            near = (both > 0) & (den * both >= num * (size + size[i] - both))
            near[i] = False
            if not inner:
                near &= side != side[i]
            js = np.flatnonzero(near)
            links[i] = len(js)
            if len(js):
                pairs.append((i, js))
        changed = True
        while changed:
            changed = False
            for i, js in pairs:
                m = min(label[i], label[js].min())
                if label[i] != m or (label[js] != m).any():
                    label[i], label[js], changed = m, m, True
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, label, np.asarray(ids, np.int64))
        return [(ids[i], int(links[i]), int(least[label[i]])) for i in range(n) if links[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, blocks, texts = None, [], [], []

        def out(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["c", "n_links", "linked"])

        rows: list[tuple[int, int, int]] = []
        for b in batches:
            for lo, hi, i, block, text in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "c", "block", "text")), strict=True):
                if (lo, hi) != here:
                    if here is not None:
                        rows += cell(ids, blocks, texts, here[0] == here[1])
                    here, ids, blocks, texts = (lo, hi), [], [], []
                ids.append(i), blocks.append(block), texts.append(text or "")
            yield out(rows)
            rows = []
        if here is not None:
            yield out(cell(ids, blocks, texts, here[0] == here[1]))

    return run


def _cells(sharing: DataFrame, sizes: DataFrame, scratch: Scratch, params: JaccardParams) -> DataFrame:
    """(lo, hi, block, c) from ``sharing`` (node, c): each text once in its own block's cell and once in each other cell of that block."""
    # Sizes of a link differ by the similarity at most, so its texts stand in the same or in neighbouring bands.
    num, den = params.similarity
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(den / num)) + 1e-9)
    sharing = sharing.join(sizes, "c").select(F.explode(F.array(F.xxhash64("node", band), F.xxhash64("node", band + 1))).alias("node"), "c")
    # Minima of nodes are written, so that a node of very many texts can be split over tasks in the join.
    least = scratch.keep(sharing.groupBy("node").agg(F.min("c").alias("home"), F.count("*").alias("n")).where("n > 1").drop("n"))
    members = scratch.keep(sharing.join(least, "node"))
    homes = members.groupBy("c").agg(F.min("home").alias("home"))
    least = scratch.keep(members.select("node", "c").join(homes, "c").groupBy("node").agg(F.min("home").alias("home")))
    homes = members.select("node", "c").join(least, "node").groupBy("c").agg(F.min("home").alias("home"))
    homes = scratch.keep(homes.join(sizes, "c"))
    wanted = F.ceil(F.greatest(F.count("*") / params.block, F.sum("size") / params.block_shingles)).cast("int")
    large = scratch.keep(homes.groupBy("home").agg(wanted.alias("blocks")).where("blocks > 1"))
    part = F.pmod(F.xxhash64("c"), F.coalesce("blocks", F.lit(1)))
    blocks = scratch.keep(homes.join(large, "home", "left").select("c", F.xxhash64("home", part).alias("block")))
    # Of a node, only the blocks that it reaches are gathered, and of nodes that reach the same ones, one.
    reach = members.select("node", "c").join(blocks, "c").groupBy("node").agg(F.sort_array(F.collect_set("block")).alias("reach"))
    reach = reach.where(F.size("reach") > 1).select("reach").distinct().select(F.posexplode("reach").alias("at", "lo"), "reach")
    pairs = reach.select("lo", F.explode(F.slice("reach", F.col("at") + 2, F.size("reach"))).alias("hi")).distinct()
    own = blocks.select("block").distinct().select(F.col("block").alias("lo"), F.col("block").alias("hi"))
    pairs = scratch.keep(pairs.unionByName(own))
    of = pairs.select(F.col("lo").alias("block"), "lo", "hi").unionByName(pairs.where("lo <> hi").select(F.col("hi").alias("block"), "lo", "hi"))
    return blocks.join(of, "block").select("lo", "hi", "block", "c")


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", "text", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def _classes(documents: DataFrame, params: JaccardParams) -> DataFrame:
    """(k1, k2, class_id, has_id, n_links, group_id, is_head) of each distinct text; one text of each group is its head."""
    keyed = _keyed(documents)
    with Scratch(documents.sparkSession) as scratch:
        labelled = keyed.mapInArrow(_labels(params), "doc_id long, k1 long, k2 long, size long, nodes array<long>")
        classes = labelled.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first(F.struct("size", "nodes")).alias("x"))
        classes = classes.select("k1", "k2", F.coalesce("id", "k1").alias("class_id"), F.col("id").isNotNull().alias("has_id"), "x.*", F.monotonically_increasing_id().alias("c"))
        classes = scratch.keep(classes)

        entries = classes.select("c", F.explode("nodes").alias("node"))
        meeting = scratch.keep(entries.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
        shared = scratch.keep(entries.join(meeting, "node", "left_semi"))
        sizes = shared.select("c").distinct().join(classes.select("c", "k1", "k2", "class_id", "has_id", "size"), "c")
        sizes = scratch.keep(sizes)
        named = sizes.select("c", F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.when(F.col("has_id"), F.col("class_id")).alias("id"))
        # The least id finds a row of the text, without bringing together all copies of it. Both sides grow with the corpus,
        # so they are dealt by key at every size: a small run then shows what a large one costs.
        own = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
        texts = scratch.keep(keyed.join(named.hint("merge"), own).select("c", "text").dropDuplicates(["c"]))

        cells = _cells(shared, sizes.select("c", "size"), scratch, params).join(texts, "c")
        cells = cells.repartition("lo", "hi").sortWithinPartitions("lo", "hi")
        found = scratch.keep(cells.mapInArrow(_verify(params), "c long, n_links long, linked long"))
        links = found.groupBy("c").agg(F.sum("n_links").alias("n_links"))
        edges = scratch.keep(found.select(F.col("c").alias("u"), F.col("linked").alias("v")).where("u <> v").distinct())
        near = components(edges).withColumnRenamed("node", "c")
        near = scratch.keep(near.join(sizes.select("c", "class_id", "has_id", "k1"), "c"))
        heads = scratch.keep(near.groupBy("root").agg(F.min(F.struct(~F.col("has_id"), "class_id", "k1", "c")).alias("head")))
        near = near.join(heads, "root").select("c", F.col("head.class_id").alias("group_id"), (F.col("head.c") == F.col("c")).alias("is_head"))
        known = classes.select("c", "k1", "k2", "class_id", "has_id").join(links, "c", "left").join(near, "c", "left")
        n_links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
        columns = ["k1", "k2", "class_id", "has_id", n_links, F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("is_head", F.lit(True)).alias("is_head")]
        return cut(known.select(*columns))


def jaccard_join(documents: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """(doc_id, class_id, n_links, group_id) of each row of ``documents``.

    class_id is the least doc_id of an equal text, n_links the number of other
    texts at the similarity or above, group_id the least doc_id of those that
    links connect.
    """
    known = _classes(documents, params).drop("is_head", "has_id")
    return _keyed(documents).select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).select("doc_id", "class_id", "n_links", "group_id")


def keep_one(documents: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """``documents`` with one row of each near-duplicate group.

    The row is one of the least id's text; rows without an id are texts like all
    others, and give the row only where no row of the group has an id. An id that
    stands for texts of several groups stays once for each.
    """
    id_ = F.when(F.col("has_id"), F.col("class_id")).alias("__id")
    heads = _classes(documents, params).where("is_head").select(id_, F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    text = F.coalesce("text", F.lit(""))
    keys = [F.xxhash64(text), F.xxhash64(F.lit(7), text)]
    # Joined by the text's hashes, for which alone there is a row each; an id that is null is compared as one.
    kept = documents.join(heads, (keys[0] == F.col("__k1")) & (keys[1] == F.col("__k2")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return kept.dropDuplicates(["__k1", "__k2"]).select(documents.columns)
