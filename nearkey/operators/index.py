"""The derived index: hub postings, trie nodes with preorder intervals, and hub-node positions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkey.folders import tasks_for, written
from nearkey.functions.intervals import interval_cells, number_cells
from nearkey.functions.text import prefixes


#: First letters within which trie nodes are numbered.
HEAD = 3
#: Neighbouring numbers that one window counts through: a slice of vertex ids, of positions.
SLICE_BITS = 16
#: Rows of a key that one window numbers; the rows of larger keys are numbered in slices.
HOT_ROWS = 1 << 18


def _numbered(rows: DataFrame, n: int, keys: list[str], order: list[str], last: str, name: str) -> DataFrame:
    """``rows``, a stored table, numbered from 0 within ``keys`` by ``order`` and then ``last``, an integer; in ``n`` tasks."""
    few, many = _numbered_parts(rows, n, keys, order, last, name)
    return few.unionByName(many)


def _numbered_parts(rows: DataFrame, n: int, keys: list[str], order: list[str], last: str, name: str) -> tuple[DataFrame, DataFrame]:
    """:func:`_numbered` of the keys that hold few rows, dealt by ``keys``, and of those that hold many.

    Two-level for keys that hold many rows (so there are few of these keys): rows are counted through inside slices of ``last``,
    after the counts of the slices before.
    """
    hot = F.broadcast(rows.groupBy(*keys).count().where(F.col("count") > HOT_ROWS).select(*keys))
    few = rows.join(hot, keys, "left_anti").repartition(n, *keys)
    few = few.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order, last)) - 1).cast("int"))
    cell = [*keys, *order, "_slice"]
    sliced = rows.join(hot, keys, "left_semi").withColumn("_slice", F.shiftright(F.col(last).cast("long"), SLICE_BITS)).repartition(n, *cell)
    smaller = Window.partitionBy(*keys).orderBy(*order, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy(*cell).count().select(*[F.col(c).alias(f"_{c}") for c in cell], F.coalesce(F.sum("count").over(smaller), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(*cell).orderBy(last)) - 1
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell])
    many = sliced.withColumn("_n", number).join(before, same).withColumn(name, (F.col("_n") + F.col("_before")).cast("int"))
    return few, many.select(*few.columns)


def hub_postings(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, vertex, dist, pos)``: labels of keyword vertices by hub, numbered by (dist, vertex).

    The labels are written once, since their number says in how many tasks they are numbered.
    """
    return numbered_postings(held_labels(labels, keywords))


def held_labels(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, vertex, dist)`` of keyword vertices, written."""
    kept = labels.join(keywords.select("vertex").distinct().hint("merge"), "vertex", "left_semi").select("hub", "vertex", "dist")
    return written(kept, "held")


def numbered_postings(held: DataFrame) -> DataFrame:
    """:func:`hub_postings` of the stored labels ``held(hub, vertex, dist)``, all of vertices with keywords."""
    n = tasks_for(held.sparkSession, held.count())
    return _numbered(held, n, ["hub"], ["dist"], "vertex", "pos").select("hub", "vertex", "dist", "pos")


def trie_nodes(keywords: DataFrame) -> DataFrame:
    """``(node, depth, words)``: every prefix of the dictionary, the root as the empty string."""
    words = keywords.select("word").distinct()
    return words.select(F.explode(prefixes(F.col("word"))).alias("node")).groupBy("node").agg(F.count("*").alias("words")).select("node", F.length("node").alias("depth"), "words")


def trie_intervals(keywords: DataFrame) -> DataFrame:
    """``(node, id, last)``: preorder numbers from 1 and the last number of each subtree.

    Numbering is two-level: within the first ``HEAD`` letters, after the counts of the heads before; the only unpartitioned
    window runs over the different heads.
    """
    nodes = trie_nodes(keywords).select("node", F.substring("node", 1, HEAD).alias("head"))
    counts = nodes.groupBy("head").count()
    before = counts.select("head", F.coalesce(F.sum("count").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    below = nodes.select(F.explode(prefixes(F.col("node"))).alias("node")).groupBy("node").agg((F.count("*") - 1).alias("below"))
    number = F.row_number().over(Window.partitionBy("head").orderBy("node"))
    numbered = nodes.withColumn("n", number).join(before, "head").select("node", (F.col("n") + F.col("before")).alias("id"))
    # merged: the size of exploded prefixes is guessed from the words, so they would be broadcast through the driver
    return numbered.join(below.hint("merge"), "node").select("node", "id", (F.col("id") + F.col("below")).alias("last"))


def trie_level_index(keywords: DataFrame) -> DataFrame:
    """``(letter, depth, nodes, first_id, last_id)``: nodes by last letter and depth."""
    nodes = trie_intervals(keywords).where("node <> ''")
    return nodes.groupBy(F.substring("node", -1, 1).alias("letter"), F.length("node").alias("depth")).agg(
        F.count("*").alias("nodes"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def level_index_probe(keywords: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows of ``probes(letter, depth, low, high, ..)`` with ``(node, id)``: the nodes of that last letter and depth in the interval.

    Intervals and nodes meet by cells (:mod:`nearkey.functions.intervals`), so a (letter, depth) with many nodes is not
    filtered probe by node.
    """
    return nodes_in(trie_intervals(keywords), probes)


def nodes_in(intervals: DataFrame, probes: DataFrame) -> DataFrame:
    """:func:`level_index_probe` over ``intervals(node, id, ..)`` that are there already.

    Nodes and probes are cut into cells only where the other side has their letter and depth, and they meet by a merge: cells are
    several rows to a row, and a broadcast of them would go through the driver by the size of what is uncut.
    """
    keys = ["letter", "depth"]
    nodes = intervals.where("node <> ''").select(F.substring("node", -1, 1).alias("letter"), F.length("node").alias("depth"), "node", "id")
    there, asked = nodes.select(*keys).distinct(), probes.select(*keys).distinct()
    cut_nodes = nodes.join(asked, keys, "left_semi").select("*", F.inline(number_cells(F.col("id"))))
    cut = probes.join(there, keys, "left_semi").select("*", F.inline(interval_cells(F.col("low"), F.col("high"))))
    return cut.join(cut_nodes.hint("merge"), [*keys, "level", "cell"]).select(*probes.columns, "node", "id")


def hub_node(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, node, pos)``: which postings of a hub have a word below a trie node."""
    under = keywords.select("vertex", F.explode(prefixes(F.col("word"), with_root=False)).alias("node")).distinct()
    # merged: prefixes are many more rows than the planner takes them for, too many to be broadcast
    return hub_postings(labels, keywords).join(under.hint("merge"), "vertex").select("hub", "node", "pos")


#: Positions of a chunk of a set, the bits of one integer.
CHUNK_BITS = 5
#: Tasks of chunks for each task of postings, where hubs hold many.
WIDER = 2


def trie_branches(keywords: DataFrame) -> DataFrame:
    """``(node, branch)`` of all nodes but the root: the longest prefix that all words below a node share.

    Between a node and its branch the trie does not fork, so both have the same words below, and the same positions.
    """
    below = keywords.select("word").distinct().select("word", F.explode(prefixes(F.col("word"), with_root=False)).alias("node"))
    ends = below.groupBy("node").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.length("low")), lambda i: F.substring("low", F.lit(1), i) == F.substring("high", F.lit(1), i)))
    return ends.select("node", F.substring("low", F.lit(1), shared).alias("branch"))


def _numbered_branches(keywords: DataFrame, branches: DataFrame) -> DataFrame:
    """``(branch, id, up, inner)``: branches by preorder number, the number of the branch above (0: the root), and whether nodes lie between."""
    ids = trie_intervals(keywords).select(F.col("node").alias("branch"), "id").join(branches.select("branch").distinct(), "branch", "left_semi")
    above = ids.select("branch", F.explode(prefixes(F.col("branch"), with_root=False)).alias("node")).where("node <> branch").join(ids.select(F.col("branch").alias("node"), F.col("id").alias("above")), "node")
    nearest = above.groupBy("branch").agg(F.max(F.struct(F.length("node").alias("depth"), "above")).alias("up"))
    found = ids.join(nearest, "branch", "left").withColumn("depth", F.coalesce("up.depth", F.lit(0)))
    return found.select("branch", "id", F.coalesce("up.above", F.lit(0)).alias("up"), (F.length("branch") - F.col("depth") > 1).alias("inner"))


@dataclass(frozen=True)
class BranchSets:
    """``branches(node, branch, parent)``, ``postings`` and chunks ``(hub, branch, up, inner, chunk, bits, first_pos, last_pos)``.

    Branches are numbers, ``parent`` that of the branch of a node's parent (0: the root). The chunks of hubs with few postings, ``few``, are dealt by hub, so what groups
    them by hub and more needs no shuffle; those of hubs with ``many`` are dealt among ``tasks``.
    """

    branches: DataFrame
    few: DataFrame
    many: DataFrame
    postings: DataFrame
    tasks: int

    def dealt(self, step: Callable[[DataFrame, Callable[..., DataFrame]], DataFrame]) -> DataFrame:
        """``step`` of both: it is given chunks, and what deals rows by columns where that is not done."""
        return step(self.few, lambda rows, *keys: rows).unionByName(step(self.many, lambda rows, *keys: rows.repartition(self.tasks, *keys)))

    @property
    def chunks(self) -> DataFrame:
        return self.few.unionByName(self.many).drop("up", "inner")


def branch_sets(labels: DataFrame, keywords: DataFrame) -> BranchSets:
    """The position sets of all branches. Labels take the branches of their vertex along to where their hub is numbered: no other shuffle is of their size."""
    branches = written(trie_branches(keywords), "branches")
    ids = written(_numbered_branches(keywords, branches), "ids")
    packed = (F.shiftleft("up", 32) + F.shiftleft("id", 1) + F.col("inner").cast("long")).alias("packed")
    words = keywords.select("word").distinct().select("word", F.explode(prefixes(F.col("word"), with_root=False)).alias("branch"))
    above = words.join(ids.select("branch", packed), "branch").groupBy("word").agg(F.collect_list("packed").alias("above"))
    own = keywords.join(above, "word").groupBy("vertex").agg(F.array_distinct(F.flatten(F.collect_list("above"))).alias("branches"))
    held = written(labels.join(own.hint("merge"), "vertex").select("hub", "vertex", "dist", "branches"), "held")
    n = tasks_for(held.sparkSession, 2 * held.count())  # a posting is in the chunks of several branches
    few, many = _numbered_parts(held, n, ["hub"], ["dist"], "vertex", "pos")
    chunk = F.shiftright("pos", CHUNK_BITS)
    of = ids.select("branch", "id", "up")
    nodes = branches.join(of, "branch").select("node", "id", "up", (F.expr("substring(node, 1, length(node) - 1)")).alias("parent"))
    ends = ids.select(F.col("branch").alias("parent"), F.col("id").alias("above"))
    # below a branch begins another; between the two a node's parent has the node's own branch
    nodes = nodes.join(ends, "parent", "left").select("node", F.col("id").alias("branch"), F.when((F.col("parent") == "") | F.col("above").isNotNull(), F.col("up")).otherwise(F.col("id")).alias("parent"))
    return BranchSets(written(nodes, "nodes"), _chunks(few), _chunks(many.repartition(WIDER * n, "hub", chunk)), held, WIDER * n)


def _chunks(postings: DataFrame) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND((1 << CHUNK_BITS) - 1))
    sets = postings.select("hub", F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", bit.alias("bit"), F.explode("branches").alias("packed"))
    of_branches = sets.groupBy("hub", "chunk", "packed").agg(F.bit_or("bit").alias("bits"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    number = F.shiftright(F.col("packed").bitwiseAND((1 << 32) - 1), 1)
    return of_branches.select("hub", number.alias("branch"), F.shiftright("packed", 32).alias("up"), (F.col("packed").bitwiseAND(1) == 1).alias("inner"), "chunk", "bits", "first_pos", "last_pos")


def branch_chunks(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, branch, chunk, bits, first_pos, last_pos)``: a branch's positions, 32 to a row: ``bits`` has bit i for ``32 * chunk + i``.

    Branches are preorder numbers. Postings are dealt by hub once, a row each with the branches of its vertex, and become sets there. So no prefix of a
    posting is shuffled, no row grows with a hub, and a large hub is spread.
    """
    return branch_sets(labels, keywords).chunks


def hub_node_chunks(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, node, chunk, bits)`` of all nodes: those of their branches."""
    sets = branch_sets(labels, keywords)
    return sets.chunks.join(sets.branches, "branch").select("hub", "node", "chunk", "bits")


def _ones(bits: Column) -> Column:
    """The bits that are set, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << CHUNK_BITS) - 1)), lambda i: F.getbit(bits, i) == 1)


def hub_node_positions(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, node, depth, positions)``, positions ascending: those of a branch gathered once, from its chunks, for all nodes above it."""
    sets = branch_sets(labels, keywords)
    gathered = sets.dealt(lambda chunks, deal: deal(chunks, "hub", "branch").groupBy("hub", "branch").agg(F.sort_array(F.collect_list(F.struct("chunk", "bits"))).alias("chunks")))
    positions = F.flatten(F.transform("chunks", lambda c: F.transform(_ones(c["bits"]), lambda i: (c["chunk"] * (1 << CHUNK_BITS) + i).cast("int"))))
    rows = gathered.select("hub", "branch", positions.alias("positions")).join(sets.branches, "branch")
    return rows.select("hub", "node", F.length("node").alias("depth"), "positions")


def _counted(sets: BranchSets) -> DataFrame:
    ones = F.sum(F.bit_count("bits")).alias("ones")
    first, last = F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos")
    counted = sets.dealt(lambda chunks, deal: deal(chunks, "hub", "branch").groupBy("hub", "branch").agg(ones, first, last))
    return counted.join(sets.branches, "branch").select("hub", "node", "ones", "first_pos", "last_pos")


def hub_node_popcount(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, node, ones, first_pos, last_pos)``, counted on the chunks of the branches."""
    return _counted(branch_sets(labels, keywords))


def _chunks_in_parent(chunks: DataFrame, deal: Callable[..., DataFrame]) -> DataFrame:
    """``(hub, branch, parent, chunk, bits, among, before)``: chunks with the bits that the parent's set has there and its ones in the chunks before.

    A chunk is one row for itself, as a parent, and one below the branch above, where a window gives it what the parent's row says.
    Nodes between two branches have parents of their own branch.
    """
    ordered = Window.partitionBy("hub", "branch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.bit_count("bits")).over(ordered), F.lit(0)).cast("int")
    own = deal(chunks, "hub", "branch").select("hub", "branch", "up", "inner", "chunk", "bits", before.alias("before"))
    itself = F.struct(F.col("branch").alias("parent"), F.col("bits").alias("among"), F.col("before").alias("before"))
    below = F.struct(F.col("up").alias("parent"), F.lit(None).cast("long").alias("among"), F.lit(None).cast("int").alias("before"))
    both = deal(own.select("hub", "branch", "inner", "chunk", "bits", F.inline(F.array(itself, below))), "hub", "parent", "chunk")
    same = Window.partitionBy("hub", "parent", "chunk")
    met = both.withColumns({"among": F.max("among").over(same), "before": F.max("before").over(same)})
    return met.where("inner or branch <> parent").drop("inner")


def _unfolded(chunks: DataFrame) -> DataFrame:
    """A row per position, ``pos`` and ``rank``: the ones of the parent before the chunk and below the bit. The root has all positions."""
    below = F.bit_count(F.col("among").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i")) - 1))
    pos = (F.col("chunk") * (1 << CHUNK_BITS) + F.col("i")).cast("int")
    unfolded = chunks.select("*", F.explode(_ones(F.col("bits"))).alias("i"))
    return unfolded.withColumns({"pos": pos, "rank": F.coalesce(F.col("before") + below, pos).cast("int")})


def rank_in_parent(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, node, pos, rank)``: positions of a node as ranks among its parent's, from 0."""
    sets = branch_sets(labels, keywords)
    nodes = sets.branches.groupBy("branch", "parent").agg(F.collect_list("node").alias("nodes"))
    rows = sets.dealt(_chunks_in_parent).join(nodes, ["branch", "parent"])
    return _unfolded(rows).select("hub", F.explode("nodes").alias("node"), "pos", "rank")


def rank_sums_in_parent(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, node, ones, first_rank, last_rank, ranks, digest)``: :func:`rank_in_parent` summed, every rank once for all nodes that share it, where its hub is."""
    sets = branch_sets(labels, keywords)
    pos, rank = F.col("pos").cast("long"), F.col("rank").cast("long")
    sums = F.count("*").alias("ones"), F.min(rank).alias("first_rank"), F.max(rank).alias("last_rank"), F.sum(rank).alias("ranks"), F.sum((pos + 1) * (rank + 1)).alias("digest")
    rows = sets.dealt(lambda chunks, deal: _unfolded(_chunks_in_parent(chunks, deal)).groupBy("hub", "branch", "parent").agg(*sums))
    return rows.join(sets.branches, ["branch", "parent"]).drop("branch", "parent").select("hub", "node", "ones", "first_rank", "last_rank", "ranks", "digest")


def covering_nodes(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(hub, node)``: a hub's nodes without those whose subtree holds the hub's next node.

    Labels carry the words of their vertex to where their hub is, so only different words of a hub are cut into nodes.
    """
    held = held_labels(labels, keywords)
    n = tasks_for(held.sparkSession, held.count())
    words = keywords.groupBy("vertex").agg(F.collect_set("word").alias("words"))
    met = held.repartition(n, "vertex").join(words.repartition(n, "vertex").hint("merge"), "vertex")
    dealt = met.repartition(n, "hub", F.shiftright("vertex", SLICE_BITS)).select("hub", F.explode("words").alias("word")).distinct()
    nodes = dealt.repartition(n, "hub").select("hub", F.explode(prefixes(F.col("word"), with_root=False)).alias("node")).distinct()
    own = nodes.join(written(trie_intervals(keywords), "intervals"), "node").repartition(n, "hub")
    following = F.lead("id").over(Window.partitionBy("hub").orderBy("id"))
    return own.withColumn("following", following).where("following is null or following > last").select("hub", "node")


def index_size(labels: DataFrame, keywords: DataFrame) -> DataFrame:
    """Bytes a hub's index takes: 8 a posting, 4 a node, and bitmaps of 4-byte words, raw and relative to the parent."""
    sets = branch_sets(labels, keywords)
    postings = sets.postings.groupBy("hub").agg(F.count("*").alias("postings")).repartition(sets.tasks, "hub")
    ones = written(_counted(sets), "ones")
    parents = ones.select("hub", F.col("node").alias("parent"), F.col("ones").alias("bits"))
    parents = parents.unionByName(postings.select("hub", F.lit("").alias("parent"), F.col("postings").alias("bits")))
    # a join wants both sides dealt by all its keys
    own = ones.withColumn("parent", F.expr("substring(node, 1, length(node) - 1)")).repartition(sets.tasks, "hub", "parent")
    joined = own.join(parents.repartition(sets.tasks, "hub", "parent").hint("merge"), ["hub", "parent"]).join(postings, "hub")
    words = lambda bits: F.ceil(bits / 32).cast("long") * 4
    relative = F.when(F.col("ones") < F.col("bits"), words(F.col("bits"))).otherwise(F.lit(0))
    return joined.groupBy("hub", "postings").agg(F.count("*").alias("nodes"), F.sum(words(F.col("postings"))).alias("raw_bytes"), F.sum(relative).alias("packed_bytes")).select(
        "hub", (F.col("postings") * 8 + F.col("nodes") * 4 + F.col("raw_bytes")).alias("raw_bytes"), (F.col("postings") * 8 + F.col("nodes") * 4 + F.col("packed_bytes")).alias("packed_bytes")
    )
