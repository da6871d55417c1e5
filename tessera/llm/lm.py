"""Bigram language model in Elias-Fano tries, and scores of every text.

Texts are read once into pages (runs of documents, about ``PAGE_BYTES`` of
text) with the page's distinct words and token numbers. Words, then bigrams,
go from each page to shards by hash, as one blob per page and shard with the
page's distinct keys and their training counts; a shard sums the counts over all pages
and answers each page's keys. What a page sends is pre-aggregated, so a word or
a copy that holds a third of all tokens is one key per page; contexts with many
occurrences are cut over several shards.

A bigram shard is a trie of compact levels (``elias_fano.BigramTrie``): contexts,
monotone pointers, children relative to their context, and the quantised
smoothed share log10(c(h,w) / (c(h) + KAPPA)). It is memory-mapped and queried by
successor search within the context. The probability is
p(w|h) = c(h,w)/(c(h)+k) + k/(c(h)+k) * p(w), p(w) = (c(w)+0.1)/(N+0.1*(V+1)).

Training documents are those whose crc32 of the identifier as text is not 0
modulo ``FOLDS``. Defined cases: NULL texts are empty (one end token); a NULL
identifier counts as the empty string, hence held out; words are whole at any
length; repeated rows are scored each; without training text every token has
the base probability. Only (identifier, text) enter.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounds, materialise, strings, text_slices
from tessera.llm.elias_fano import BigramTrie

FOLDS = 10
PAGE_BYTES = 8 << 20
WORDS_PER_SHARD = 500_000
BIGRAMS_PER_SHARD = 1_000_000
KAPPA = 200.0
STEP = 2.0 ** -12     # of log10, per code
HOT_CONTEXT = 500_000  # occurrences per shard of one context


def _planes(values: np.ndarray, dtype: str) -> bytes:
    """Little-endian bytes by plane, compressed."""
    raw = np.ascontiguousarray(values, dtype=dtype)
    return zstandard.ZstdCompressor(1).compress(
        np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T).tobytes())


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _hash(words) -> np.ndarray:
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False)


def _shard_order(shard: np.ndarray, n: int) -> list[np.ndarray]:
    """Positions of each shard's keys, in their own order."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n + 1))
    return [order[cut[s]:cut[s + 1]] for s in range(n)]


def read_pages(docs: DataFrame) -> DataFrame:
    """Pages: doc_ids, held, lens, distinct words with their training counts, token numbers."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", PAGE_BYTES):
                split = pc.ascii_split_whitespace(pc.ascii_lower(strings(part, "text")))
                flat = split.flatten()
                filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
                at = bounds(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
                at = np.concatenate(([0], np.cumsum(filled)))[at].astype(np.int64)
                coded = flat.filter(pa.array(filled)).dictionary_encode()
                token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                held = part.column("held").to_numpy(zero_copy_only=False)
                train = np.repeat(~held, np.diff(at))
                n = len(coded.dictionary)
                total = np.bincount(token, minlength=n)
                rank = np.argsort(-total, kind="stable")  # small numbers for frequent words
                number = np.empty(n, dtype=np.int64)
                number[rank] = np.arange(n)
                counts = np.bincount(token[train], minlength=n)[rank]
                words = coded.dictionary.take(pa.array(rank))
                yield pa.RecordBatch.from_arrays([
                    _one(part.column("doc_id")), pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([np.diff(at)], pa.list_(pa.int64())), pa.array([n], pa.int64()),
                    pa.array([len(token)], pa.int64()),
                    pa.array([zstandard.ZstdCompressor(1).compress("\n".join(words.to_pylist()).encode())], pa.binary()),
                    pa.array([_planes(counts, "<u4")], pa.binary()),
                    pa.array([_planes(number[token], "<u4")], pa.binary())],
                    names=["doc_ids", "held", "lens", "n_words", "n_tokens", "words", "counts", "tokens"])

    return docs.mapInArrow(run, f"doc_ids array<{id_type}>, held array<boolean>, lens array<long>, n_words long, "
                                "n_tokens long, words binary, counts binary, tokens binary") \
        .withColumn("page", F.monotonically_increasing_id())


def _one(col: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col)


def _words(data: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(data).decode()
    return text.split("\n") if text else []


def count_words(pages: DataFrame, shards: int) -> DataFrame:
    """(page, shard, ids, counts) of each page's words, and per shard one row (page NULL) with n, v."""

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.array(_words(batch.column("words")[i].as_py()), dtype=object)
                counts = _unplanes(batch.column("counts")[i].as_py(), "<u4")
                rows = [(s, own) for s, own in enumerate(_shard_order((_hash(words) % np.uint64(shards)).astype(np.int64), shards))
                        if len(own)]
                page = batch.column("page")[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([page] * len(rows), pa.int64()), pa.array([s for s, _ in rows], pa.int32()),
                    pa.array(["\n".join(words[own]).encode() for _, own in rows], pa.binary()),
                    pa.array([_planes(counts[own], "<u4") for _, own in rows], pa.binary())],
                    names=["page", "shard", "words", "counts"])

    def total(pdf):
        words = [w.decode().split("\n") for w in pdf["words"]]
        counts = [_unplanes(c, "<u4").astype(np.int64) for c in pdf["counts"]]
        lens = np.array([len(w) for w in words])
        code, names = pd.factorize(np.array([x for w in words for x in w], dtype=object))
        sums = np.bincount(code, weights=np.concatenate(counts), minlength=len(names)).astype(np.int64)
        order = np.argsort(_hash(names), kind="stable")  # numbering by hash, training words only
        known = order[sums[order] > 0]
        ids = np.zeros(len(names), dtype=np.int64)       # 0: not in the training text
        shard = int(pdf["shard"].iloc[0])
        ids[known] = np.arange(len(known)) * shards + shard + 1
        cut = bounds(lens)
        out = pd.DataFrame({
            "page": pd.array(pdf["page"], dtype="Int64"), "shard": shard,
            "ids": [_planes(ids[code[cut[i]:cut[i + 1]]], "<u4") for i in range(len(pdf))],
            "counts": [_planes(sums[code[cut[i]:cut[i + 1]]], "<u8") for i in range(len(pdf))], "n": 0, "v": 0})
        stat = pd.DataFrame({"page": pd.array([None], dtype="Int64"), "shard": shard, "ids": None, "counts": None,
                             "n": int(sums.sum()), "v": len(known)})
        return pd.concat([out, stat])

    sent = pages.select("page", "words", "counts").mapInArrow(
        send, "page long, shard int, words binary, counts binary")
    return sent.groupBy("shard").applyInPandas(
        total, "page long, shard int, ids binary, counts binary, n long, v long")


class Page:
    """Tokens of a page with their identifiers, training counts and contexts."""

    def __init__(self, row: dict, answers: list[dict], shards: int, train_docs: int, end_count: int):
        words = np.array(_words(row["words"]), dtype=object)
        ids, counts = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        own = _shard_order((_hash(words) % np.uint64(shards)).astype(np.int64), shards)
        for a in answers:
            ids[own[a["shard"]]] = _unplanes(a["ids"], "<u4")
            counts[own[a["shard"]]] = _unplanes(a["counts"], "<u8")
        token = _unplanes(row["tokens"], "<u4").astype(np.int64)
        lens = np.asarray(row["lens"], dtype=np.int64)
        at = bounds(lens)
        self.n_tokens = lens + 1
        ends = bounds(self.n_tokens)
        self.first = ends[:-1]
        # identifier 0 is the end of a text, and the start of one as a context; unknown words are -1
        seq = np.insert(np.where(ids > 0, ids, -1)[token], at[1:], 0)
        count = np.insert(counts[token], at[1:], end_count)
        self.word, self.count = seq, count
        self.context = np.r_[0, seq[:-1]] if len(seq) else seq
        self.context_count = np.r_[train_docs, count[:-1]] if len(seq) else count
        self.context[self.first], self.context_count[self.first] = 0, train_docs
        self.held = np.asarray(row["held"], dtype=bool)
        self.train = np.repeat(~self.held, self.n_tokens)

    def bigrams(self, shards: int):
        """(positions of tokens with a key, key number of each, contexts, words, training counts, shard) of the page."""
        use = np.flatnonzero((self.word >= 0) & (self.context >= 0))
        key = (self.context[use].astype(np.uint64) << np.uint64(32)) | self.word[use].astype(np.uint64)
        keys, first, number = np.unique(key, return_index=True, return_inverse=True)
        counts = np.bincount(number, weights=self.train[use], minlength=len(keys)).astype(np.int64)
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        occurs = self.context_count[use][first]
        salt = word % (1 + occurs // HOT_CONTEXT)  # a hot context is cut over several shards
        mixed = (context * 64 + salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        shard = ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        return use, number, context, word, counts, occurs, shard


def quantised(share: np.ndarray) -> np.ndarray:
    """Codes 1..65535 of shares in (0, 1]; 0 is kept for absent."""
    return np.clip(1 + np.rint(-np.log10(share) / STEP), 1, 65535).astype(np.uint16)


def shares(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) * STEP), 0.0)


def _page_rows(batch: pa.RecordBatch):
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def count_bigrams(coded: DataFrame, word_shards: int, shards: int, train_docs: int, kappa: float) -> DataFrame:
    """(shard, page, codes) answering each page's bigrams, and (shard, NULL, trie) of each shard."""

    def send(batches):
        for batch in batches:
            for row in _page_rows(batch):
                page = Page(row, row["answers"], word_shards, train_docs, train_docs)
                _, _, context, word, counts, occurs, shard = page.bigrams(shards)
                rows = [(s, own) for s, own in enumerate(_shard_order(shard, shards)) if len(own)]
                own_first = [np.r_[True, np.diff(context[o]) != 0] for _, o in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["page"]] * len(rows), pa.int64()), pa.array([s for s, _ in rows], pa.int32()),
                    pa.array([_planes(np.diff(context[o], prepend=0), "<u4") for _, o in rows], pa.binary()),
                    pa.array([_planes(word[o], "<u4") for _, o in rows], pa.binary()),
                    pa.array([_planes(counts[o], "<u4") for _, o in rows], pa.binary()),
                    pa.array([_planes(occurs[o][f], "<u8") for (_, o), f in zip(rows, own_first)], pa.binary())],
                    names=["page", "shard", "contexts", "words", "counts", "occurs"])

    def answer(pdf):
        context = [np.cumsum(_unplanes(x, "<u4").astype(np.int64)) for x in pdf["contexts"]]
        word = [_unplanes(x, "<u4").astype(np.int64) for x in pdf["words"]]
        cut = bounds(np.array([len(x) for x in word]))
        occurs = [np.repeat(_unplanes(x, "<u8").astype(np.int64), np.diff(np.append(np.flatnonzero(np.r_[True, np.diff(c) != 0]), len(c))))
                  for x, c in zip(pdf["occurs"], context)]
        key = (np.concatenate(context).astype(np.uint64) << np.uint64(32)) | np.concatenate(word).astype(np.uint64)
        keys, first, number = np.unique(key, return_index=True, return_inverse=True)
        counts = np.bincount(number, weights=np.concatenate([_unplanes(x, "<u4") for x in pdf["counts"]]),
                             minlength=len(keys))
        total = np.concatenate(occurs)[first]
        h, w = (keys >> np.uint64(32)), (keys & np.uint64(0xFFFFFFFF))
        seen = counts > 0
        trie = BigramTrie.build(h[seen], w[seen], quantised(counts[seen] / (total[seen] + kappa)))
        with tempfile.TemporaryFile() as f:
            f.write(trie)
            f.flush()
            with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
                model = BigramTrie(mapped)
                codes = model.find(h, w)[number]
                del model
        shard = int(pdf["shard"].iloc[0])
        out = pd.DataFrame({"shard": shard, "page": pd.array(pdf["page"], dtype="Int64"),
                            "codes": [_planes(codes[cut[i]:cut[i + 1]], "<u2") for i in range(len(pdf))], "trie": None})
        return pd.concat([out, pd.DataFrame({"shard": shard, "page": pd.array([None], dtype="Int64"),
                                             "codes": None, "trie": [trie]})])

    sent = coded.mapInArrow(send, "page long, shard int, contexts binary, words binary, counts binary, occurs binary")
    return sent.groupBy("shard").applyInPandas(answer, "shard int, page long, codes binary, trie binary")


def _score(coded: DataFrame, word_shards: int, shards: int, n: int, v: int, train_docs: int, kappa: float,
           id_type: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in _page_rows(batch):
                page = Page(row, row["answers"], word_shards, train_docs, train_docs)
                use, number, _, _, counts, _, shard = page.bigrams(shards)
                own = _shard_order(shard, shards)
                codes = np.zeros(len(counts), dtype=np.uint16)
                for a in row["bigrams"] or ():
                    codes[own[a["shard"]]] = _unplanes(a["codes"], "<u2")
                single = (page.count + 0.1) / (n + 0.1 * (v + 1))
                share = np.zeros(len(single))
                share[use] = shares(codes)[number]
                seen = np.maximum(page.context_count, 0)
                both = share + kappa / (seen + kappa) * single
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array(page.held), pa.array(page.n_tokens),
                    pa.array(np.add.reduceat((page.count > 0).astype(np.int64), page.first)),
                    pa.array(np.full(len(page.held), n)),
                    pa.array(np.add.reduceat(np.log10(single), page.first)),
                    pa.array(np.add.reduceat(np.log10(both), page.first))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, "
                                 "train_tokens long, base_score double, score double")


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
                kappa: float = KAPPA) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     (F.crc32(key.cast("binary")) % folds == 0).alias("held"))
    pages = materialise(read_pages(docs), "lm-pages")
    sizes = pages.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)),
                      F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()
    word_shards = max(8, -(-sizes[0] // WORDS_PER_SHARD))
    shards = max(8, -(-sizes[1] // BIGRAMS_PER_SHARD))
    train_docs = sizes[2]
    counted = materialise(count_words(pages, word_shards), "lm-words")
    stat = counted.where("page IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = stat[0] + train_docs, stat[1] + (1 if train_docs else 0)
    answers = counted.where("page IS NOT NULL").groupBy("page").agg(
        F.collect_list(F.struct("shard", "ids", "counts")).alias("answers"))
    coded = pages.join(answers, "page", "left")
    coded = coded.withColumn("answers", F.coalesce("answers", F.array().cast(coded.schema["answers"].dataType)))
    bigrams = materialise(count_bigrams(coded, word_shards, shards, train_docs, kappa), "lm-trie")
    per_page = bigrams.where("page IS NOT NULL").groupBy("page").agg(
        F.collect_list(F.struct("shard", "codes")).alias("bigrams"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _score(coded.join(per_page, "page", "left"), word_shards, shards, n, v, train_docs, kappa, id_type)
