"""Near-duplicate components by fast similarity sketching, banding and exact verification.

Sketch: round i < t throws each element of a set into one of t bins by a hash and keeps per bin the least of i + value;
bins that stay empty after that are filled in rounds t to 2t - 1, where round t + j throws every element into bin j.
So each coordinate fills, and the share of equal coordinates of two sketches is concentrated about their similarity.

Documents with one and the same set are one class, of which the least id stands for all. The sketches of classes are
banded; two classes are candidates if a band agrees. Candidate pairs are never written out for a whole bucket. In a
round each bucket has one leader, and each class is verified on full sets against one leader only, the one that meets
most others; so a round has no more pairs than classes. Rounds go on with the buckets that hold several components.
What they leave is chained into clusters, and a cluster's sets are verified against each other in blocks of bounded
size, by counting elements that they share; a block returns only links that join its sets, fewer than it has sets. So
every candidate pair between components is verified.
With 72 bands of 8 rows a pair of similarity 0.8 is missed by the banding with a chance of 2 in a million, one of 0.85 of
4 in a thousand million, while pairs that share a passage (0.3 and less) seldom meet; sizes that rule a link out are
sorted out before any set is fetched.

Sets are sets of 64-bit hashes of shingles. Rows of a hot bucket or leader are salted, so that no task meets them all;
rows of a hot class meet through joins that Spark can split; counts are aggregates with partial sums.

Defined cases: a null or empty text, or one without words, has an empty set, is its own component and is kept; a row
whose id is null is its own component with a null id and is kept; rows that repeat an id are one document for links;
equal texts are one component; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, _at, discard, free_name, grams, in_batches, let_go, mix, runs, stored, utf8, without, words

#: Sets and shingles of a unit of verification, about; elements of at most so many sets are counted by their pairs.
UNIT_SETS, UNIT_SHINGLES, FEW = 1_024, 2 << 20, 16
#: Rows of a key that one task may meet, about. Rounds of leaders: at most so many, and no more after one that leaves over
#: this share of the nodes in buckets of several components; what is left is verified in blocks, so no link depends on them.
HOT, ROUNDS, FRUITFUL = 1_024, 4, 0.7
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, ascending, and where each row's begin (and the end)."""
    h, first = words(*utf8(texts), SPACES)
    g, begin = grams(h, first, size)
    counts, n = np.diff(begin), np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    rows = np.repeat(np.arange(len(counts)), counts)
    if len(short):  # the whole sequence is the one shingle
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            whole[has] = mix(whole[has] * _GOLD + h[first[:-1][short[has]] + k] + np.uint64(1))
        g, rows = np.concatenate((g, mix(whole + n[short].astype(np.uint64)))), np.concatenate((rows, short))
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    g, rows = g[new], rows[new]
    return g, np.searchsorted(rows, np.arange(len(counts) + 1))


def sketches(g: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``bins`` 64-bit values for each set; empty sets have zeros."""
    counts = np.diff(begin)
    out = np.full(len(counts) * bins, np.iinfo(np.uint64).max, np.uint64)
    live, rows = g, np.repeat(np.arange(len(counts)), counts)
    value_bits = np.uint64(55)  # a value holds the round above and 55 bits of hash below
    seeds = np.arange(1, 2 * bins + 1, dtype=np.uint64) * _GOLD
    for r in range(bins):
        h = mix(live + seeds[r])
        at = rows * bins + (h % np.uint64(bins)).astype(np.int64)
        np.minimum.at(out, at, (np.uint64(r) << value_bits) | (mix(h) >> np.uint64(9)))
        table = out.reshape(-1, bins)
        open_rows = (table == np.iinfo(np.uint64).max).any(1) & (counts > 0)
        keep = open_rows[rows]
        live, rows = live[keep], rows[keep]
        if not len(live):
            break
    if len(live):
        table = out.reshape(-1, bins)
        for j in np.flatnonzero((table[rows] == np.iinfo(np.uint64).max).any(0)):
            need = table[rows, j] == np.iinfo(np.uint64).max
            h = mix(mix(live[need] + seeds[bins + j])) >> np.uint64(9)
            np.minimum.at(out, rows[need] * bins + j, (np.uint64(bins + j) << value_bits) | h)
    table = out.reshape(-1, bins)
    table[counts == 0] = 0
    return table


def sketch_documents(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Per document: set size, a 128-bit signature of the set, a key for each band."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for a, b in runs(batch.column(1)):
                g, begin = shingle_sets(batch.column(1).slice(a, b - a), size)
                counts = np.diff(begin)
                table = sketches(g, begin, bands * rows).reshape(-1, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), table.shape[:2]).copy()
                for k in range(rows):
                    key = mix(key * _GOLD + table[:, :, k])
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g ^ salt), dtype=np.uint64))) for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDEF))]
                signs = [mix(s[begin[1:]] - s[begin[:-1]] + counts.astype(np.uint64)).view(np.int64) for s in sums]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * bands, pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(signs[0]), pa.array(signs[1]), flat], schema=_SKETCH)

    return in_batches(docs).mapInArrow(work, "doc_id BIGINT, n_shingles BIGINT, sig_a BIGINT, sig_b BIGINT, bands ARRAY<BIGINT>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for a, b in runs(batch.column(1)):
                g, begin = shingle_sets(batch.column(1).slice(a, b - a), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(g.view(np.int64)))], schema=_SETS)

    return in_batches(docs).mapInArrow(work, "doc_id BIGINT, shingles ARRAY<BIGINT>")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of undirected ``edges`` (a, b): comp is the least node that can be reached. Labels
    sink along edges and then jump to their label's label, so that the number of rounds grows with the logarithm. All
    nodes of a component share their label, so what a jump joins is written first: only labels that have a lower label
    themselves are sent, whole if Spark knows them to be small, or else to a join whose large labels it splits."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")))
    while True:
        low = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("low"))
        sunk = stored(labels.join(low.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp")))
        jump = sunk.where("comp < node").select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        moved = stored(sunk.join(jump, "comp", "left").select("node", "was", F.coalesce("far", "comp").alias("comp")))
        discard(labels, sunk)
        labels = _at(moved.select("node", "comp"), moved.stored_at)
        if not moved.where("comp <> was").limit(1).count():
            discard(both)
            return labels


def salted(rows: DataFrame, counts: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``salt`` and ``salts`` (the number of salts of the row's ``key``), and ``counts`` (key, n) with a row for
    each salt: a join on key and salt then meets at most about ``HOT`` rows of a key in one task. Keys of more rows are so
    few that their table is written first; Spark sends it to the rows if its size allows that."""
    hot = stored(counts.where(F.col("n") > HOT).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("salts")))
    dealt = rows.join(hot, key, "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64(by), F.col("salts")).cast("int"))
    return dealt, counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / HOT).cast("int") - 1)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least ``percent`` of a hundred of their union in common; ``a`` may be in any
    number of pairs."""
    counts = stored(pairs.groupBy("a").agg(F.count("*").alias("n")))
    dealt, of_salts = salted(pairs, counts, "a", "b")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")).join(of_salts, "a").select("a", "salt", "of_a")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    n_a, n_b = F.size("of_a"), F.size("of_b")
    joined = dealt.join(right, "b").join(left, ["a", "salt"]).where((n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent))
    common = joined.select("a", "b", n_a.alias("n_a"), n_b.alias("n_b"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    return common.where(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")


def linked_rows(keys: np.ndarray, rows: np.ndarray, n: int, percent: int) -> np.ndarray:
    """For each of ``n`` sets the least set that links reach among them. Intersections of all pairs are counted by
    element: elements of few sets by their pairs, the others by products of incidence matrices."""
    _, column, count = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    begin = np.cumsum(count) - count
    common = np.zeros(n * n, np.int32)
    for d in range(2, FEW + 1):
        own = begin[count == d]
        if len(own):
            members = rows[own[:, None] + np.arange(d)]
            a, b = np.triu_indices(d, 1)
            for at in range(0, len(own), 1 + (1 << 20) // len(a)):
                part = members[at : at + 1 + (1 << 20) // len(a)]
                common += np.bincount((np.minimum(part[:, a], part[:, b]) * n + np.maximum(part[:, a], part[:, b])).ravel(), minlength=n * n).astype(np.int32)
    common = common.reshape(n, n)
    common += common.T
    many = np.flatnonzero(count > FEW)
    for at in range(0, len(many), 1024):
        part = many[at : at + 1024]
        own = np.concatenate([rows[begin[c] : begin[c] + count[c]] for c in part])
        table = np.zeros((n, len(part)), np.float32)
        table[own, np.repeat(np.arange(len(part)), count[part])] = 1
        common += (table @ table.T).astype(np.int32)
    size = np.bincount(rows, minlength=n)
    linked = common.astype(np.int64) * (100 + percent) >= (size[:, None] + size) * percent
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        low = np.where(linked, label, n).min(1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verified_clusters(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the linked nodes of each cluster; ``placed`` has node and cluster. A cluster of many or
    large sets is cut into blocks and each pair of blocks is a unit; small clusters share a unit. Clusters of several
    blocks are few (at most one for each ``UNIT_SETS`` sets or ``UNIT_SHINGLES`` shingles), so their table is written
    first and Spark sends it to the sets if its size allows that, instead of dealing whole sets by cluster."""
    rows = stored(sets.join(placed.withColumnRenamed("node", "doc_id"), "doc_id"))
    mass = F.sum(F.size("shingles").cast("bigint"))
    total = rows.agg(mass).first()[0] or 0
    units = max(8, -(-total // UNIT_SHINGLES))
    blocks = rows.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / UNIT_SETS), F.ceil(mass / UNIT_SHINGLES)).cast("int").alias("blocks"))
    blocks = stored(blocks.where("blocks > 1"))
    cut = rows.join(blocks, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k != F.col("own")) | (F.col("blocks") == 1))
    unit = F.when(F.col("blocks") == 1, F.struct(F.pmod(F.xxhash64("cluster"), F.lit(units)).alias("u"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(F.struct(F.col("cluster").alias("u"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    dealt = cut.withColumn("other", F.explode(others)).withColumn("unit", unit).select("unit.u", "unit.i", "unit.j", "cluster", "doc_id", "shingles")

    def verify(table: pa.Table) -> pa.Table:
        ids, cluster = table.column("doc_id").to_numpy(), table.column("cluster").to_numpy()
        lists = table.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        keys, ends = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
        order = np.lexsort((ids, cluster))
        cuts = np.flatnonzero(np.diff(cluster[order])) + 1
        a, b = [], []
        for members in np.split(order, cuts):
            own = np.concatenate([keys[ends[k] : ends[k + 1]] for k in members])
            label = linked_rows(own, np.repeat(np.arange(len(members)), sizes[members]), len(members), percent)
            joined = np.flatnonzero(label != np.arange(len(members)))
            a.append(ids[members[label[joined]]])
            b.append(ids[members[joined]])
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    found = stored(dealt.groupBy("u", "i", "j").applyInArrow(verify, "a BIGINT, b BIGINT"))
    discard(rows, blocks)
    return found


def in_shared_buckets(reps: DataFrame) -> DataFrame:
    """(node, size, degree, buckets) of representatives that share a bucket; ``buckets`` are those, as (key, salt, salts);
    ``degree`` is the sum of their sizes."""
    entries = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    shared = stored(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    dealt, of_salts = salted(entries, shared, "key", "node")
    met = dealt.join(of_salts, ["key", "salt"])
    return stored(met.groupBy("node", "size").agg(F.sum("n").alias("degree"), F.collect_list(F.struct("key", "salt", "salts")).alias("buckets")))


def members_of(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.explode("buckets")).drop("buckets").select("*", "bucket.*").drop("bucket")


def to_members(members: DataFrame, of_keys: DataFrame) -> DataFrame:
    """``members`` joined to a table of their keys, salt by salt."""
    return members.join(of_keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["key", "salt"])


def leader_pairs(nodes: DataFrame, percent: int, nth: int) -> DataFrame:
    """For each node at most one pair (a, b): b is the node, a a leader of another component in one of its buckets. The
    first round's leader of a bucket is the member that meets most others; later ones go by a hash."""
    members = members_of(nodes)
    order = F.struct(F.col("degree") if nth == 0 else F.xxhash64("node", F.lit(nth)), -F.col("node"))
    leaders = members.groupBy("key").agg(F.first("salts").alias("salts"), F.max_by(F.struct(F.col("node").alias("a"), F.col("size").alias("lead_size"), F.col("comp").alias("lead_comp"), order.alias("order")), order).alias("lead")).select("key", "salts", "lead.*")
    fits = F.least("size", "lead_size") * 100 >= F.greatest("size", "lead_size") * percent
    met = to_members(members.select("key", "salt", "node", "size", "comp"), leaders).where((F.col("comp") != F.col("lead_comp")) & fits)
    return met.groupBy("node").agg(F.max_by(F.struct("a", "comp", "lead_comp"), "order").alias("best")).select("best.a", F.col("node").alias("b"), "best.comp", "best.lead_comp")


def in_mixed_buckets(nodes: DataFrame) -> DataFrame:
    """``nodes`` with only those buckets that still hold several components; nodes without such a bucket go."""
    members = members_of(nodes)
    mixed = members.groupBy("key").agg(F.first("salts").alias("salts"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key", "salts")
    left = to_members(members, mixed)
    return stored(left.groupBy("node", "size", "degree", "comp").agg(F.collect_list(F.struct("key", "salt", "salts")).alias("buckets")))


def chained(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that chain all nodes that buckets hold together, without one for each bucket of a node: a node has one
    edge, to the least node of all its buckets; of the nodes that a bucket's members have taken so, which are few, the least
    has one to each other."""
    members = members_of(nodes.select("node", "buckets"))
    low = members.groupBy("key").agg(F.first("salts").alias("salts"), F.min("node").alias("low"))
    least = stored(to_members(members.select("key", "salt", "node"), low).groupBy("node").agg(F.min("low").alias("least")))
    taken = stored(members_of(nodes.select("node", "buckets").join(least, "node")).select("key", "least").distinct())
    first = taken.groupBy("key").agg(F.min("least").alias("a"), F.max("least").alias("most")).where("a < most").select("key", "a")
    among = taken.withColumnRenamed("least", "b").join(first, "key").select("a", "b")
    edges = stored(among.union(least.select(F.col("least").alias("a"), F.col("node").alias("b"))).where("a <> b").distinct())
    discard(least, taken)
    return edges


def renamed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with the components that ``found`` (node, comp), over components, gives."""
    moved = found.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    return nodes.join(moved, "comp", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")


def linked_classes(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, comp) over the representatives that share buckets; ``reps`` has doc_id, n_shingles and bands."""
    nodes = in_shared_buckets(reps)
    sets = stored(full_sets(docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), size))
    labels = stored(nodes.select("node", F.col("node").alias("comp")))
    active, left = nodes.withColumn("comp", F.col("node")), nodes.count()

    def join_components(edges: DataFrame) -> None:
        """Takes links between components (a, b) over into ``labels``."""
        nonlocal labels
        found = components(edges)
        older, labels = labels, stored(renamed(labels, found))
        discard(older, found)

    nth = 0
    while left:
        pairs = stored(leader_pairs(active, percent, nth))
        linked = verified(pairs.select("a", "b"), sets, percent)
        join_components(pairs.join(linked, ["a", "b"]).select(F.col("comp").alias("a"), F.col("lead_comp").alias("b")).distinct())
        now = in_mixed_buckets(active.drop("comp").join(labels, "node"))
        discard(pairs, active)
        before, left, active, nth = left, now.count(), now, nth + 1
        if left > before * FRUITFUL or nth == ROUNDS:
            break
    if left:
        edges = chained(active)
        clusters = components(edges)
        discard(edges)
        found = verified_clusters(sets, clusters.withColumnRenamed("comp", "cluster"), percent)
        named = labels.withColumnRenamed("comp", "name")
        ends = found.join(named.withColumnsRenamed({"node": "a", "name": "name_a"}), "a").join(named.withColumnsRenamed({"node": "b", "name": "name_b"}), "b")
        join_components(ends.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).where("a <> b").distinct())
        discard(clusters, found)
    discard(nodes, sets, active)
    return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 72, rows: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, n_shingles, component_id (the least id that links reach) and kept (it is that document)."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = stored(sketch_documents(docs, size, bands, rows))
    known = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(known.groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = known.join(classes.select("sig_a", "sig_b", "n_shingles", F.col("rep").alias("doc_id")), ["sig_a", "sig_b", "n_shingles", "doc_id"], "left_semi").select("doc_id", "n_shingles", "bands").distinct()
    labels = linked_classes(docs, reps, size, percent)
    named = classes.where("copies > 1").select("sig_a", "sig_b", "n_shingles", "rep")
    placed = table.select("doc_id", "n_shingles", "sig_a", "sig_b").join(named, ["sig_a", "sig_b", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("node"))
    placed = placed.join(labels, "node", "left").withColumn("node", F.coalesce("comp", "node"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("node"))
    out = stored(placed.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    discard(table, classes, labels)
    return out


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the least id. Rows that repeat an id are documents of
    their own here, so that a text goes only if a row of its component stays; rows without words (null, empty) are one for
    each id; rows with a null id stay; an empty table gives an empty one; columns of any name pass unchanged."""
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if again.isEmpty():
        found = near_duplicates(docs, size, percent, id_col=id_col, text_col=text_col)
        return without(docs, found.where(~F.col("kept")).select(id_col), id_col)
    row = free_name(docs, "row")
    rows = stored(docs.where(F.col(id_col).isNotNull()).withColumn(row, F.monotonically_increasing_id()))
    texts = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = texts.select("row", "id", F.xxhash64("text").alias("hash")).join(near_duplicates(texts, size, percent, id_col="row", text_col="text"), "row")
    filled = F.col("n_shingles") > 0
    least = place.groupBy(F.when(filled, F.col("component_id")).alias("component"), F.when(~filled, F.col("id")).alias("empty")).agg(F.min(F.struct("id", "hash", "row")).alias("least"))
    kept = rows.join(stored(least.select(F.col("least.row").alias(row))), row, "left_semi").select(docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
