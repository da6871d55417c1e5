"""Ranked lexical search by no-random-access reading of impact-sorted lists.

Index: every document keeps its length and its counts of the query terms (one
scan; written as a table). From document counts each posting has an impact, an
exact 64-bit integer (``impacts``). Slices of documents of at most
``SLICE_POSTINGS`` postings (or one document) get one list per term, sorted by
impact. An item is answered per slice (``read_lists``): its lists are read in
step from the top, in growing segments. A document's lower score is the sum of
the impacts seen, its upper score adds the last impact read of every list it has
not been seen in. Reading goes on until the k best have equal lower and upper
scores, no other document, seen or not, can reach them, and every tie is decided
by the identifier. Spark merges the k best of all slices.

Items are taken in blocks of at most ``ITEM_BLOCK`` items and ``ITEM_BLOCK_TERMS`` terms
(or one item), so vocabulary, weights and term counts on the driver and in tasks are
bounded by a block, whatever the number of items; each block is one pass over the texts.
A slice answers with k rows per item, and Spark ranks inside each task before the
shuffle.

Scoring follows a BM25 form in integers: weight w = floor(1000 ln((2N+2)/(2df+1))),
m = 100 - B + (B n N) div L with B = 90, impact w * ((10^9 tf) div (1000 tf + 8 m)).

Defined cases: NULL or term-free texts are no documents (they do not count in N);
a NULL identifier loses ties; rows repeated whole are documents of their own; items
without terms or matches get no rows; items that share an identifier are ranked each
for itself; empty tables give no rows. Only identifiers and texts enter, so other
columns cannot clash. Very long texts are read in pieces cut between terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounds, materialise

#: maximal runs of digits, letters and anything beyond ASCII, after A-Z are lowered
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
K = 10
LENGTH_SHARE = 90
PIECE = 4 << 20
SLICE_POSTINGS = 1 << 21
FIRST_READ = 64
ITEM_BLOCK = 2048
ITEM_BLOCK_TERMS = 1 << 18


def term_pieces(data: bytes):
    """Lists of the terms of one text, at most about ``PIECE`` bytes each."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield TERM.findall(data[at:end].lower())
        at = end


def item_blocks(items: DataFrame, item_col: str, text_col: str):
    """Lists of (item, terms), streamed from Spark in a fixed order."""
    rows = iter(items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
                .where(F.col("text").isNotNull()).orderBy("item", "text").toLocalIterator())
    block, size = [], 0
    for item, text in rows:
        terms = sorted({t for piece in term_pieces(text.encode()) for t in piece})
        if terms and block and (len(block) >= ITEM_BLOCK or size + len(terms) > ITEM_BLOCK_TERMS):
            yield block
            block, size = [], 0
        if terms:
            block.append((item, terms))
            size += len(terms)
    if block:
        yield block


def count_terms(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every text with a term; terms are numbers in ``vocabulary``."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches):
        for batch in batches:
            ids, n, flat, tfs, lens = [], [], [], [], []
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                total, found = 0, Counter()
                for terms in term_pieces(text.as_py() or b""):
                    total += len(terms)
                    found.update(map(number.get, terms))
                found.pop(None, None)
                if total:
                    ids.append(i.as_py())
                    n.append(total)
                    flat.extend(found)
                    tfs.extend(found.values())
                    lens.append(len(found))
            cut = pa.array(bounds(np.array(lens, dtype=np.int64)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(cut, pa.array(flat, pa.int32())),
                 pa.ListArray.from_arrays(cut, pa.array(tfs, pa.int64()))], names=["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.where(F.col("text").isNotNull()).mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Exact impact of postings; ``n`` is the length of each posting's document."""
    if int(n.max(initial=0)) * docs > (1 << 62) // LENGTH_SHARE:
        ratio = np.array([(LENGTH_SHARE * int(x) * docs) // total for x in n], dtype=np.int64)
    else:
        ratio = (LENGTH_SHARE * n * docs) // total
    m = 100 - LENGTH_SHARE + ratio
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def read_lists(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, tie: np.ndarray, k: int = K,
               first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents of (documents, impacts) lists sorted by falling impact.

    ``tie`` orders documents of equal score. Returns documents, exact scores (both best
    first) and the number of postings read.
    """
    lower = np.zeros(n_docs, dtype=np.int64)
    seen = np.zeros((len(lists), n_docs), dtype=bool)
    depth, step, read = 0, first_read, 0
    dead = np.zeros(n_docs, dtype=bool)
    while True:
        frontier = np.zeros(len(lists), dtype=np.int64)
        for j, (doc, impact) in enumerate(lists):
            part = doc[depth:depth + step]
            if len(part):
                lower[part] += impact[depth:depth + step]
                seen[j, part] = True
                read += len(part)
            if depth + step < len(doc):
                frontier[j] = impact[depth + step - 1]
        depth += step
        step *= 2
        alive = np.flatnonzero((lower > 0) & ~dead)
        best = alive[_best(lower[alive], tie[alive], k)]
        ahead = int(frontier.sum())
        if ahead == 0:
            return best, lower[best], read
        upper = np.full(len(alive), ahead, dtype=np.int64) + lower[alive]
        for j in np.flatnonzero(frontier):
            upper -= frontier[j] * seen[j, alive]
        if len(best) < k:
            continue
        last, last_tie = lower[best[-1]], tie[best[-1]]
        can = (upper > last) | ((upper == last) & (tie[alive] <= last_tie))
        dead[alive[~can]] = True
        rest = alive[can]
        settled = (upper[can] == lower[rest]).all() and len(rest) == k
        if settled and ahead < last:
            return best, lower[best], read


def _best(score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= floor)
        return some[np.lexsort((tie[some], -score[some]))[:k]]
    return np.lexsort((tie, -score))[:k]


def _slices(batches):
    """Runs of Arrow batches with at most ``SLICE_POSTINGS`` postings (or one batch row)."""
    held, size = [], 0
    for batch in batches:
        at, ends = 0, np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + SLICE_POSTINGS - size, side="right"))
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
            if at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def answer_slice(part: pa.Table, weight: np.ndarray, items: list[np.ndarray], docs: int, total: int, k: int):
    """(item number, document row, score) of the k best documents of every item in one slice."""
    column = part.column("terms").combine_chunks()
    term = column.flatten().to_numpy(zero_copy_only=False)
    tf = part.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    lens = np.diff(column.offsets.to_numpy())
    doc = np.repeat(np.arange(part.num_rows), lens)
    score = impacts(weight[term], tf, part.column("n").to_numpy()[doc], docs, total)
    some = score > 0
    term, doc, score = term[some], doc[some], score[some]
    order = np.lexsort((-score, term))
    term, doc, score = term[order], doc[order], score[order]
    ids = part.column("id")
    null = ids.is_null().to_numpy()
    tie = np.empty(part.num_rows, dtype=np.int64)
    tie[np.lexsort((ids.fill_null(0).to_numpy(), null))] = np.arange(part.num_rows)
    cut = np.searchsorted(term, np.arange(len(weight) + 1))
    for i, terms in enumerate(items):
        lists = [(doc[cut[t]:cut[t + 1]], score[cut[t]:cut[t + 1]]) for t in terms if cut[t] < cut[t + 1]]
        if lists:
            best, exact, _ = read_lists(lists, part.num_rows, tie, k)
            yield i, best, exact


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, best first."""
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for block in item_blocks(items, item_col, item_text_col):
        out = out.unionByName(_search_block(docs, block, item_type, id_col, text_col, k))
    return out


def _search_block(docs, block, item_type, id_col, text_col, k):
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in block for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    counted = materialise(count_terms(docs, vocabulary, id_col, text_col), "search-counts")
    n_docs, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for t, n in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the block's terms
        df[t] = n
    weight = np.array([term_weight(n_docs, int(x)) for x in df], dtype=np.int64)
    asked = [np.array([number[t] for t in terms]) for _, terms in block]

    def run(batches):
        for part in _slices(batches):
            rows = list(answer_slice(part, weight, asked, n_docs, total, k))
            if rows:
                best = np.concatenate([b for _, b, _ in rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([i for i, _, _ in rows], [len(b) for _, b, _ in rows]), pa.int32()),
                     part.column("id").combine_chunks().take(pa.array(best)),
                     pa.array(np.concatenate([s for _, _, s in rows]), pa.int64())], names=["number", "doc_id", "score"])

    found = counted.mapInArrow(run, "number int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"number int, item_id {item_type}")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(F.broadcast(names), "number")  # at most ITEM_BLOCK rows
            .select("item_id", "rank", "doc_id", "score"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(ts)::BIGINT AS n, (count(*) OVER ())::BIGINT AS nn, (sum(len(ts)) OVER ())::BIGINT AS ll
    FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT q.item_id, tf.doc_id, sum(floor(1000 * ln((2 * n.nn + 2) / (2 * df.df + 1)))::BIGINT
      * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n.n * n.nn) // n.ll))))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN df USING (term) JOIN n USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER w)::INT AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= {K}
"""
