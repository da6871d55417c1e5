"""BPE encoding by tree concatenation, and decoding.

Pieces of ordinary length go to the library. A long unsplit piece is cut into
leaves, which are encoded in parallel (one library call for all leaves of a
batch), and neighbouring halves are joined pairwise up a tree. At each join a
window of tokens around it is re-encoded and grown until its first and last
token are again those of the two sides; everything outside the window then
stands unchanged, since a sequence of merges is valid exactly when each
neighbouring pair is. Long runs that never agree are re-encoded whole.

Decoding gathers the bytes of all ids at once and decodes UTF-8 with
replacement, as the library's byte-level decoder does.

Defined cases: NULL and empty texts have no ids and decode to ''; very long
texts and single very long words are handled whole; special strings inside
texts are the library's special ids; rows are independent, so repeats are
equal; the input's columns are kept and clashing output names are refused.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder
from tessera.llm.common import bounds, gather_ranges, strings, text_slices

LONG_PIECE = 512     # characters; longer unsplit pieces are encoded by tree
LEAF = 256           # symbols per leaf
FIRST_WINDOW = 4     # tokens re-encoded on each side of a join at first


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class TreeEncoder:
    """Ids of long pieces through joins of halves."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.batch = encoder(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec.update(added_tokens=[], pre_tokenizer=None, normalizer=None, post_processor=None, decoder=None)
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.text = {i: t for t, i in spec["model"]["vocab"].items()}
        self.special = self.batch.special

    def merges(self, pieces: list[str]) -> list[list[int]]:
        """Model ids of symbol strings, without splitting."""
        return [e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation, from the encodings of both sides."""
        if not left or not right:
            return left + right
        n = FIRST_WINDOW
        while True:
            a, b = max(0, len(left) - n), min(len(right), n)
            ids = self.merges(["".join(self.text[i] for i in left[a:] + right[:b])])[0]
            agrees_left = a == 0 or ids[0] == left[a]
            agrees_right = b == len(right) or ids[-1] == right[b - 1]
            if agrees_left and agrees_right and (len(ids) > 1 or (a == 0 and b == len(right))):
                return left[:a] + ids + right[b:]
            if a == 0 and b == len(right):
                return ids
            n *= 2

    def tree(self, symbols: str) -> list[int]:
        level = self.merges([symbols[i:i + LEAF] for i in range(0, len(symbols), LEAF)])
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i]
                     for i in range(0, len(level), 2)]
        return level[0] if level else []

    def distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        long = [i for i, p in enumerate(pieces) if len(p) > LONG_PIECE
                and not any(s in p for s in self.special)]
        short = list(pieces)
        for i in long:
            short[i] = ""
        flat, cut = self.batch.distinct(short)
        if not long:
            return flat, cut
        rows = [flat[cut[i]:cut[i + 1]] for i in range(len(pieces))]
        split = self.batch.tok.pre_tokenizer
        for i in long:
            own: list[int] = []
            for symbols, _ in split.pre_tokenize_str(pieces[i]):
                own += self.tree(symbols) if len(symbols) > LEAF else self.merges([symbols])[0]
            rows[i] = np.array(own, dtype=np.uint32)
        return np.concatenate(rows), bounds(np.array([len(r) for r in rows]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.batch.encode(texts, self.distinct)


class Decoder:
    """Text of ids: bytes of every id in one table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        rows = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            rows[i] = bytes(byte[c] for c in token)
        self.flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
        self.cut = bounds(np.array([len(r) for r in rows]))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        lens = np.diff(self.cut)[ids]
        data = gather_ranges(self.flat, self.cut[:-1][ids], lens).tobytes()
        ends = bounds(lens)[at]
        return [data[ends[i]:ends[i + 1]].decode("utf-8", errors="replace") for i in range(len(at) - 1)]


@functools.lru_cache(maxsize=4)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


@functools.lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", out: str = "ids",
           keep_text: bool = True) -> DataFrame:
    """Add ``out`` (array<int>): the ids of every whole text. Map only."""
    if out in df.columns:
        raise ValueError(f"the input already has a column {out!r}; name another one with out=")
    kept = [c for c in df.columns if keep_text or c != text_col]

    def run(batches):
        enc = tree_encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, text_col, 4 << 20):
                ids, at = enc.encode(strings(part, text_col))
                col = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], col], names=[*kept, out])

    schema = df.select(*kept).withColumn(out, F.lit(None).cast("array<int>")).schema
    return df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the ids (NULL ids give ''). Map only."""
    if out in df.columns:
        raise ValueError(f"the input already has a column {out!r}; name another one with out=")
    names = df.columns

    def run(batches):
        dec = decoder(tokenizer)
        for batch in batches:
            step = 2000
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                lists = part.column(ids_col)
                at = bounds(np.array([len(x) if x.is_valid else 0 for x in lists], dtype=np.int64)) \
                    if lists.null_count else lists.offsets.to_numpy().astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                text = dec.decode(ids, at - at[0])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(text, pa.string())], names=[*names, out])

    schema = df.withColumn(out, F.lit(None).cast("string")).schema
    return df.mapInArrow(run, schema)
