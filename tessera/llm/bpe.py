"""Vectorised use of the tokenizers library on whole batches of texts.

A text is cut at single spaces into pieces that the library's own splitting
treats independently (byte-level files attach the space to the word after it;
word files drop white space). Only the distinct pieces of a batch are encoded,
and the ids of the texts are then gathered with NumPy. A bounded memory of
pieces carries over between batches. Texts in which a space is followed by white space or
by the end are encoded whole, so the result always equals the library's.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import bounds, gather_ranges

#: Every code point some library treats as white space.
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNCLEAN = rf" (?:[{WHITE}]|\z)"
REMEMBERED = 600_000
PER_CALL = 500
#: Letters whose lower case and composition are the same everywhere, then plain punctuation.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


class BatchEncoder:
    """Ids of many texts at once, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.keeps_space = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["normalizer"]
        self.special = sorted(t["content"] for t in spec["added_tokens"])
        self.seen: dict[str, bytes] = {}
        vocab = spec["model"]["vocab"]
        #: byte-level files: tokens that start with a space; word files: tokens that end a word
        self.marked = np.zeros(max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, dtype=bool)
        self.marked[[i for t, i in vocab.items()
                     if (t[0] == "\u0120" if self.keeps_space else t.endswith("</w>"))]] = True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32)
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, bounds) of the given pieces; ids of pieces seen before are remembered."""
        rows = [self.seen.get(p) for p in pieces]
        new = [i for i, r in enumerate(rows) if r is None]
        for i, ids in zip(new, self._encode_new([pieces[i] for i in new])):
            rows[i] = ids
        for i in new[:max(0, REMEMBERED - len(self.seen))]:
            self.seen[pieces[i]] = rows[i]
        lens = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // 4
        return np.frombuffer(b"".join(rows), dtype=np.uint32), bounds(lens)

    def _marks(self, piece: str) -> int:
        """Marked tokens that the piece surely has, 0 if that is not plain."""
        if self.keeps_space:
            return int(piece[:1] == " " and "<|" not in piece)
        plain = PLAIN_WORD.fullmatch(piece)
        return 0 if plain is None or "<|" in piece else (plain[1] != "") + (plain[2] != "")

    def _encode_new(self, pieces: list[str]) -> list[bytes]:
        """Plain pieces go in long joined strings, cut again at their marked tokens."""
        marks = np.fromiter(map(self._marks, pieces), dtype=np.int64, count=len(pieces))
        rows: list[bytes] = [b""] * len(pieces)
        plain, rest = np.flatnonzero(marks), list(np.flatnonzero(marks == 0))
        groups = [plain[i:i + PER_CALL] for i in range(0, len(plain), PER_CALL)]
        glue = "" if self.keeps_space else " "
        joined = self.tok.encode_batch_fast([glue.join([pieces[i] for i in g]) for g in groups],
                                            add_special_tokens=False)
        for g, e in zip(groups, joined):
            ids = np.array(e.ids, dtype=np.uint32)
            at, need = np.flatnonzero(self.marked[ids]), np.cumsum(marks[g])
            if len(at) != need[-1]:
                rest += list(g)
                continue
            cut = np.append(at, len(ids)) if self.keeps_space else np.append(0, at[need - 1] + 1)
            raw, cut = ids.tobytes(), (cut * 4).tolist()
            for k, i in enumerate(g.tolist()):
                rows[i] = raw[cut[k]:cut[k + 1]]
        for i, e in zip(rest, self.tok.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            rows[i] = array.array("I", e.ids).tobytes()
        return rows

    def pieces(self, texts: pa.Array):
        """(distinct pieces, index per piece, piece bounds per text, rows to encode whole).

        Rows to encode whole have no pieces here.
        """
        whole = pc.match_substring_regex(texts, UNCLEAN).to_numpy(zero_copy_only=False) \
            if self.keeps_space else np.zeros(len(texts), dtype=bool)
        if whole.any():
            texts = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts)
        if not self.keeps_space:
            texts = pc.replace_substring(texts, "\n", " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten()
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))) \
            .astype(np.int64)
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        if not self.keeps_space:
            return coded.dictionary.to_pylist(), index, at, np.flatnonzero(whole)
        # all but a text's first piece carry the space before them: added to the distinct words only
        head = words.take(pa.array(at[:-1])).dictionary_encode()
        index = index.copy()
        index[at[:-1]] = len(coded.dictionary) + head.indices.to_numpy(zero_copy_only=False)
        used = np.zeros(len(coded.dictionary) + len(head.dictionary), dtype=bool)
        used[index] = True
        spaced = pc.binary_join_element_wise(
            pa.scalar(" ", pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
        pieces = pa.concat_arrays([spaced, head.dictionary]).filter(pa.array(used))
        return pieces.to_pylist(), (np.cumsum(used) - 1)[index], at, np.flatnonzero(whole)

    def encode(self, texts: pa.Array, distinct=None) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, bounds per text). ``distinct`` may replace the encoder of the pieces."""
        words, index, at, whole = self.pieces(texts)
        flat, cut = (distinct or self.distinct)(words)
        lens = np.diff(cut)[index] if len(words) else np.zeros(0, dtype=np.int64)
        ids = gather_ranges(flat, cut[:-1][index], lens)
        doc = bounds(lens)[at]
        if len(whole):
            rows = [ids[doc[i]:doc[i + 1]] for i in range(len(texts))]
            for i, own in zip(whole, self.whole([texts[int(i)].as_py() for i in whole])):
                rows[i] = own
            return np.concatenate(rows), bounds(np.array([len(r) for r in rows]))
        return ids, doc


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> BatchEncoder:
    """One encoder per file and Python worker."""
    return BatchEncoder(path)
