"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A document is its set of 5-word shingles (lower case, words split at ASCII
white space; fewer words: one shingle of all of them), as 64-bit hashes.
Documents with equal sets form one class of copies, represented once.

Every representative has a signature of TREES x DEPTH min-hashes. Each tree's
signatures are sorted (a prefix trie in sorted order), and the members of a run of
neighbours whose common prefix is long enough are linked to the run's smallest
member, so trees that find the same group give the same links. The prefix is shortened
from DEPTH until a pair at the threshold meets in some tree with the target
recall. Links give candidate groups (connected components); the sort spreads
any group over tasks, since ties continue in the identifier.

All pairs inside a candidate group, a superset of the forest's pairs, are then
verified exactly on the shingle sets: groups above ``BLOCK`` members are cut into
slices and verified per pair of slices, in tasks of at most 2 x ``BLOCK`` sets.
Tasks return link counts and a spanning forest of the links, never the pairs.

Defined cases: NULL and blank texts have no shingles and are copies of each
other; very long texts are whole; ties and repeated rows are copies, each with
its own result row; an empty table gives no rows. Only (identifier, text) enter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounds, gather_ranges, materialise, one_per_key, strings, text_slices
from tessera.llm.graph import components

WORDS = 5
THRESHOLD = (4, 5)
TREES, DEPTH = 32, 8
RECALL = 0.9999
BLOCK = 512
GROUP_SETS = 2000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def match_depth(trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
                similarity: float = THRESHOLD[0] / THRESHOLD[1]) -> int:
    """Shorten the prefix until a pair at the threshold shares it in some tree with ``recall``."""
    while depth > 1 and 1 - (1 - similarity ** depth) ** trees < recall:
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, bounds per text)."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = split.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    at = bounds(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(filled)))[at].astype(np.int64)
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashed = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, dtype=np.uint64)
    h = hashed[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, dtype=np.uint64)
    n = np.diff(at)
    size = np.minimum(n, words)
    n_grams = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    start = gather_ranges(np.arange(len(h)), at[:-1], n_grams)
    width = np.repeat(size, n_grams)
    value = np.zeros(len(start), dtype=np.uint64)
    for k in range(words):
        use = width > k
        value[use] = (value[use] * _MIX) ^ h[start[use] + k]
        value[use] = _mixed(value[use])
    doc = np.repeat(np.arange(len(n)), n_grams)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    first = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, dtype=bool)
    value, doc = value[first], doc[first]
    return value, bounds(np.bincount(doc, minlength=len(n)))


def signatures(value: np.ndarray, at: np.ndarray, n: int = TREES * DEPTH) -> np.ndarray:
    """n min-hashes (16 bits each, big-endian) per set; empty sets get zeros."""
    rows = np.diff(at) > 0
    out = np.zeros((len(at) - 1, n), dtype=">u2")
    if not rows.any():
        return out
    low = (_mixed(value) >> np.uint64(32)).astype(np.uint32)
    odd = np.random.default_rng(7).integers(0, 2 ** 31, (n, 2), dtype=np.int64)
    start = at[:-1][rows]
    got = np.empty((n, int(rows.sum())), dtype=np.uint32)
    for i in range(n):
        got[i] = np.minimum.reduceat(low * np.uint32(odd[i, 0] * 2 + 1) + np.uint32(odd[i, 1]), start)
    got = (got * np.uint32(0x9E3779B1)) >> np.uint32(16)
    out[rows] = got.T
    return out


def _row_key(df: DataFrame, id_col: str, text_col: str):
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.sha2(text, 256))


def _sketches(docs: DataFrame) -> DataFrame:
    """(key, doc_id, rid, n, fp, sig) for every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                value, at = shingle_sets(strings(part, "text"))
                sig = signatures(value, at)
                sums = np.zeros((part.num_rows, 2), dtype=np.uint64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(at))
                np.add.at(sums[:, 0], doc, _mixed(value))
                np.add.at(sums[:, 1], doc, _mixed(value ^ _MIX))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"), pa.array(np.diff(at), pa.int64()),
                     pa.array([s.tobytes() for s in sums], pa.binary()),
                     pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["key", "doc_id", "n", "fp", "sig"])

    return docs.mapInArrow(run, f"key string, doc_id {id_type}, n long, fp binary, sig binary") \
        .withColumn("rid", F.monotonically_increasing_id())


def _trie_links(reps: DataFrame, depth: int) -> DataFrame:
    """(u, v): runs of neighbours in some tree's sorted order whose common prefix has ``depth`` hashes, as stars."""
    trees = reps.where("n > 0").select("rep", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.cast("short").alias("tree"),
                           F.substring("sig", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("prefix")))).alias("x")) \
        .select(F.col("x.tree").alias("tree"), F.col("x.prefix").alias("prefix"), "rep")
    ordered = trees.repartitionByRange("tree", "prefix", "rep").sortWithinPartitions("tree", "prefix", "rep")
    width = 2 * depth

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            tree = batch.column("tree").to_numpy(zero_copy_only=False)
            prefix = pc.binary_slice(batch.column("prefix"), 0, width)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            same = (tree[1:] == tree[:-1]) & pc.equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
            run_of = np.concatenate(([0], np.cumsum(~same)))
            anchor = np.minimum.reduceat(rep, np.flatnonzero(np.concatenate(([True], ~same))))
            head = (int(tree[0]), prefix[0].as_py(), int(anchor[0]))
            if last is None:
                yield _link_rows([part], [head[0]], [head[1]], [head[2]], [None], [0])
            elif last[:2] == head[:2]:
                rep, run_of = np.append(rep, last[2]), np.append(run_of, 0)
            last = (int(tree[-1]), prefix[len(prefix) - 1].as_py(), int(anchor[-1]))
            u, v = rep, anchor[run_of]
            linked = u != v
            u, v = np.unique(np.stack([u[linked], v[linked]], axis=1), axis=0).T
            if len(u):
                yield _link_rows([part] * len(u), [0] * len(u), [None] * len(u), u.tolist(), v.tolist(), [1] * len(u))
        if last is not None:
            yield _link_rows([part], [last[0]], [last[1]], [last[2]], [None], [2])

    found = materialise(ordered.mapInArrow(
        run, "part int, tree int, prefix binary, u long, v long, kind int"), "forest-links")
    # first and last rows of each partition: two rows per partition, joined in partition order
    edge = found.where("kind <> 1")
    over = Window.orderBy("part", "kind")
    seams = edge.select("kind", "u", *[F.lag(c).over(over).alias(f"b_{c}") for c in ("u", "tree", "prefix", "kind")],
                        "tree", "prefix").where(
        "kind = 0 AND b_kind = 2 AND tree = b_tree AND prefix = b_prefix").select("u", F.col("b_u").alias("v"))
    return found.where("kind = 1").select("u", "v").union(seams).distinct()


def _link_rows(part, tree, prefix, u, v, kind):
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(tree, pa.int32()), pa.array(prefix, pa.binary()),
         pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(kind, pa.int32())],
        names=["part", "tree", "prefix", "u", "v", "kind"])


def verified(rep: np.ndarray, size: np.ndarray, sets: list[np.ndarray], side: np.ndarray,
             threshold=THRESHOLD) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(documents linked to each set, spanning links) over all pairs of the block.

    ``side`` is the slice of each set: with two slices only pairs across them are
    taken, with one slice all pairs. ``size`` is the number of copies of each set.
    """
    up, down = threshold
    order = np.lexsort((rep, [len(s) for s in sets]))
    n = np.array([len(sets[i]) for i in order], dtype=np.int64)
    two = len(np.unique(side)) > 1
    flat = np.concatenate([sets[i] for i in order])
    _, feature, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    width = max(1, -(-int(shared.sum()) // 64))
    bits = np.zeros((len(order), width), dtype=np.uint64)
    row = np.repeat(np.arange(len(order)), n)
    use = shared[feature]
    c = column[feature[use]]
    np.bitwise_or.at(bits, (row[use], c // 64), np.uint64(1) << (c % 64).astype(np.uint64))
    links = np.zeros(len(rep), dtype=np.int64)
    root = np.arange(len(order))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, (1 << 21) // width)
    for i in range(len(order) - 1):
        hi = int(np.searchsorted(n, n[i] * down // up, side="right"))  # larger sets cannot reach the threshold
        for lo in range(i + 1, hi, step):
            end = min(hi, lo + step)
            inter = np.bitwise_count(bits[lo:end] & bits[i]).sum(axis=1, dtype=np.int64)
            ok = inter * (up + down) >= up * (n[lo:end] + n[i])
            if two:
                ok &= side[order[lo:end]] != side[order[i]]
            near = np.flatnonzero(ok) + lo
            if not len(near):
                continue
            links[order[i]] += size[order[near]].sum()
            links[order[near]] += size[order[i]]
            for j in near.tolist():
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    top = np.array([find(i) for i in range(len(order))])
    least = np.full(len(order), np.iinfo(np.int64).max)  # smallest member of each tree
    np.minimum.at(least, top, rep[order])
    own, to = rep[order], least[top]
    return links, [(int(own[i]), int(to[i])) for i in np.flatnonzero(own != to)]


def _verify(members: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """(u, v, links): spanning links (v set) and link counts (v NULL) of all candidate groups.

    ``members``: root, rep, size (copies), shingles.
    """
    of_root = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    total = members.count()
    n_groups = max(1, -(-total // GROUP_SETS))
    slices = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
    cut = members.join(of_root, "root").withColumn("slices", slices).withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))) \
        .withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    task = F.when(F.col("slices") == 1, F.pmod(F.xxhash64("root"), F.lit(n_groups)).cast("string")) \
        .otherwise(F.concat_ws("-", "root", "a", "b"))

    def run(pdf):
        out = []
        for _, g in pdf.groupby(["root", "a", "b"], sort=False):
            g = g.drop_duplicates("rep")
            if len(g) < 2:
                continue
            sets = [np.frombuffer(s, dtype="<u8") for s in g["shingles"]]
            rep, size = g["rep"].to_numpy(), g["size"].to_numpy()
            links, forest = verified(rep, size, sets, g["own"].to_numpy(), threshold)
            hit = np.flatnonzero(links)
            out.append(pd.DataFrame({"u": rep[hit], "v": None, "links": links[hit]}))
            out.append(pd.DataFrame(forest, columns=["u", "v"]).assign(links=0))
        if not out:
            return pd.DataFrame({"u": [], "v": [], "links": []}).astype({"u": "int64", "v": "Int64", "links": "int64"})
        return pd.concat(out).astype({"u": "int64", "v": "Int64", "links": "int64"})

    return cut.withColumn("task", task).select("task", "root", "a", "b", "own", "rep", "size", "shingles") \
        .groupBy("task").applyInPandas(run, "u long, v long, links long")


def _shingles(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                value, at = shingle_sets(strings(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("root"), part.column("size"),
                     pa.array([value[at[i]:at[i + 1]].astype("<u8").tobytes() for i in range(part.num_rows)],
                              pa.binary())], names=["rep", "root", "size", "shingles"])

    return docs.mapInArrow(run, "rep long, root long, size long, shingles binary")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 recall: float = RECALL) -> DataFrame:
    """One row per input row: key, doc_id, class_id (largest doc_id of its class), class_size,
    n_links (documents at the threshold or above, copies included), kept (one row per class)."""
    docs = df.select(_row_key(df, id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"),
                     F.col(text_col).cast("string").alias("text"))
    sketch = materialise(_sketches(docs), "forest-sketches")
    reps = materialise(
        sketch.groupBy("fp", "n").agg(F.min(F.struct("rid", "key", "sig")).alias("x"),
                                      F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "rid")).alias("top"),
                                      F.count(F.lit(1)).alias("size"))
        .select("fp", "n", F.col("x.rid").alias("rep"), F.col("x.key").alias("key"), F.col("x.sig").alias("sig"),
                "top", "size"), "forest-reps")
    groups = components(_trie_links(reps, match_depth(recall=recall)))
    candidates = groups.join(reps.select(F.col("rep").alias("node"), "key", "size"), "node") \
        .select("key", F.col("node").alias("rep"), "root", "size")
    members = materialise(_shingles(docs.join(candidates, "key").select("rep", "root", "size", "text")),
                          "forest-members")
    links = materialise(_verify(members), "forest-verified")
    linked = links.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    classes = components(links.where("v IS NOT NULL").select("u", "v")).select(F.col("node").alias("rep"), "root")
    of_rep = (reps.select("fp", "n", "rep", "top", "size").join(classes, "rep", "left").join(linked, "rep", "left")
              .withColumn("root", F.coalesce("root", "rep")).withColumn("links", F.coalesce("links", F.lit(0))))
    of_class = of_rep.groupBy("root").agg(F.max("top").alias("stay"), F.sum("size").alias("class_size"))
    full = materialise(of_rep.join(of_class, "root").select(
        "fp", "n", "size", "links", "class_size", F.col("stay")["doc_id"].alias("class_id"),
        F.col("stay")["rid"].alias("stay")), "forest-classes")
    return sketch.select("key", "doc_id", "rid", "fp", "n").join(full, ["fp", "n"]).select(
        "key", "doc_id", "class_id", "class_size", (F.col("links") + F.col("size") - 1).alias("n_links"),
        (F.col("rid") == F.col("stay")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every class (the largest identifier), with the input's columns. Of rows equal
    in identifier and text one stays: the first by its other columns as JSON text."""
    key = "_row_key"
    while key in df.columns:
        key += "_"
    stay = near_classes(df, id_col, text_col).where("kept").select(F.col("key").alias(key))
    keyed = df.withColumn(key, _row_key(df, id_col, text_col)).join(stay, key, "left_semi")
    return one_per_key(keyed, key, [id_col, text_col]).drop(key)
