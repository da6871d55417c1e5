"""Token counts from a tokenizer compiled to a finite-state transducer.

The merges of a word-end BPE file become a deterministic transducer whose
transitions carry the number of tokens they add. A state is what the future
depends on: for every recent position from which a token may still be open,
the last token of the encoding up to there and its count, relative to now. (A
token extends an encoding exactly when it and the token before it stay apart if
encoded together.) States and transitions are compiled when first met and
kept; the compiled part is dropped when it exceeds ``MAX_STATES``. The last
symbol of a word has its own transitions, which return to the start.

A long unsplit word is cut into chunks. Each chunk's state map is evaluated,
independently of the others, on the entry states that the symbols just before
it suggest; the maps then compose through a prefix scan, and an entry that was
not foreseen is evaluated where it turns up. Distinct pieces of a batch are
counted once.

Defined cases: NULL and empty texts have 0 bytes and 0 tokens; very long texts
and words are counted whole; special strings inside texts count as the library
counts them; rows are independent; input columns are kept, and clashing
output names are refused.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import PLAIN_WORD, encoder
from tessera.llm.bpe_tree import byte_symbols
from tessera.llm.common import bounds, strings, text_slices

END = "</w>"
MAX_STATES = 120_000
CHUNK = 128
WARM_UP = 32
REMEMBERED = 200_000


class Transducer:
    """Deterministic, lazily compiled; symbols are the file's byte characters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        if spec["end_of_word_suffix"] != END:
            raise ValueError("this transducer is compiled from files with word ends")
        self.vocab = spec["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.opened = {t[:i] for t in (v.removesuffix(END) for v in self.vocab) for i in range(1, len(t) + 1)}
        self.apart: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self):
        self.start = ("", ((0, "", 0),))
        self.states = {self.start: 0}
        self.keys = [self.start]
        self.inner: list[dict[str, tuple[int, int]]] = [{}]
        self.last: list[dict[str, int]] = [{}]

    def merged(self, text: str) -> list[str]:
        """Merges of one short string, used while compiling."""
        end = text.endswith(END)
        parts = list(text.removesuffix(END))
        if end:
            parts[-1] += END
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, before: str, token: str) -> bool:
        key = (before, token)
        if key not in self.apart:
            if len(self.apart) > 4 * MAX_STATES:
                self.apart.clear()
            self.apart[key] = token in self.vocab and self.merged(before + token) == ([before, token] if before else [token])
        return self.apart[key]

    def _closing(self, state: int, symbol: str, end: str) -> tuple[str, int]:
        """Token that ends with the symbol, and the tokens it adds."""
        text, open_ = self.keys[state]
        for back, before, count in open_:
            token = text[len(text) - back:] + symbol + end
            if self.follows(before, token):
                return token, count + 1
        raise ValueError(f"no token of the file ends here: {text + symbol!r}")

    def compile_inner(self, state: int, symbol: str) -> tuple[int, int]:
        token, added = self._closing(state, symbol, "")
        text, open_ = self.keys[state]
        grown = text + symbol
        still = tuple((b + 1, t, c - added) for b, t, c in open_ if grown[len(grown) - b - 1:] in self.opened)
        keep = max([b for b, _, _ in still], default=0)
        key = (grown[len(grown) - keep:], ((0, token, 0), *still))
        to = self.states.setdefault(key, len(self.keys))
        if to == len(self.keys):
            self.keys.append(key)
            self.inner.append({})
            self.last.append({})
        self.inner[state][symbol] = (to, added)
        return to, added

    def run(self, state: int, symbols: str) -> tuple[int, int]:
        """(state, tokens added) after symbols inside a word."""
        n, inner = 0, self.inner
        for c in symbols:
            hop = inner[state].get(c) or self.compile_inner(state, c)
            state = hop[0]
            n += hop[1]
        return state, n

    def finish(self, state: int, symbol: str) -> int:
        n = self.last[state].get(symbol)
        if n is None:
            n = self.last[state][symbol] = self._closing(state, symbol, END)[1]
        return n

    def state_map(self, symbols: str, entries) -> dict[int, tuple[int, int]]:
        return {s: self.run(s, symbols) for s in entries}

    def compose(self, first: dict, symbols: str, second: dict) -> dict:
        """Map of both chunks one after the other; unforeseen entries are evaluated now."""
        out = {}
        for entry, (middle, n) in first.items():
            if middle not in second:
                second[middle] = self.run(middle, symbols)
            exit_, m = second[middle]
            out[entry] = (exit_, n + m)
        return out

    def count_word(self, symbols: str) -> int:
        if len(self.keys) > MAX_STATES:
            self.reset()
        inner, end = symbols[:-1], symbols[-1]
        if len(inner) <= CHUNK:
            state, n = self.run(0, inner)
            return n + self.finish(state, end)
        chunks = [inner[i:i + CHUNK] for i in range(0, len(inner), CHUNK)]
        maps = [self.state_map(chunks[0], (0,))]
        maps += [self.state_map(c, {self.run(0, before[-WARM_UP:])[0]}) for before, c in zip(chunks, chunks[1:])]
        total = maps[0]
        for c, m in zip(chunks[1:], maps[1:]):
            total = self.compose(total, c, m)
        state, n = total[0]
        return n + self.finish(state, end)


class Counter:
    """Tokens of distinct pieces, then of texts."""

    def __init__(self, path: str):
        self.batch = encoder(path)
        if self.batch.keeps_space:
            raise ValueError("the file must drop white space")
        self.machine = Transducer(path)
        self.bytes = dict(zip((chr(i) for i in range(256)), byte_symbols()))
        self.special = re.compile("|".join(map(re.escape, self.batch.special)))
        self.seen: dict[str, int] = {}

    def _letters(self, text: str) -> str:
        if text.isascii():
            return text
        return "".join(self.bytes[chr(b)] for b in text.encode())

    def piece(self, piece: str) -> int:
        simple = PLAIN_WORD.fullmatch(piece)
        if simple and "<|" not in piece:
            return sum(self.machine.count_word(self._letters(w)) for w in (simple[1].lower(), simple[2]) if w)
        tok, n = self.batch.tok, 0
        rest = self.special.split(piece)
        for part in rest:
            words = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part)) if part else ()
            n += sum(self.machine.count_word(w) for w, _ in words if w)
        return n + len(rest) - 1

    def counts(self, texts: pa.Array) -> np.ndarray:
        words, index, at, _ = self.batch.pieces(texts)
        each = np.zeros(len(words), dtype=np.int64)
        room = REMEMBERED - len(self.seen)
        for i, w in enumerate(words):
            n = self.seen.get(w)
            if n is None:
                n = self.piece(w)
                if room > 0:
                    self.seen[w] = n
                    room -= 1
            each[i] = n
        return np.diff(bounds(each[index])[at])


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer: str, text_col: str = "text", out: str = "n_tokens",
                 keep_text: bool = True) -> DataFrame:
    """Add ``out`` (long): the tokens of every whole text. Map only."""
    if out in df.columns:
        raise ValueError(f"the input already has a column {out!r}; name another one with out=")
    kept = [c for c in df.columns if keep_text or c != text_col]

    def run(batches):
        machine = counter(tokenizer)
        for batch in batches:
            for part in text_slices(batch, text_col):
                n = machine.counts(strings(part, text_col))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(n, pa.int64())],
                                                 names=[*kept, out])

    schema = df.select(*kept).withColumn(out, F.lit(None).cast("long")).schema
    return df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
