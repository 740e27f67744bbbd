"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match.  A sequence of tokens is the
word's BPE encoding exactly if every token encodes to itself and no adjacent pair would
have merged differently across its border; that check runs vectorised over all distinct
pairs of a batch.  Only words that fail it are merged exactly, pair by pair.

Nulls count as empty texts; empty texts have no ids; ids of special tokens in a text are
those the tokenizers library gives.  Repeated rows are encoded like any other row; extra
columns do not matter, as only the two named ones are read.  Texts of any length are
encoded whole; a worker's memory holds one and what it remembers of short units.  No ties arise, as ids
follow from the text alone.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices

#: White space as Unicode defines it; Python's str.isspace and Arrow also count U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NOT_WHITE = re.compile(f"[^{WHITE}]+")
_END = "\x01"  # stands for the end-of-word suffix in lookups; no byte-level symbol is this character
_BIG = np.int64(1) << 40
#: Units (runs without white space) of up to KNOWN_LENGTH characters whose ids a worker remembers; all are forgotten when it is reached.
KNOWN, KNOWN_LENGTH = 400_000, 32


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBPE:
    """A word-level BPE model with an end-of-word suffix, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[i] = t
        self._token_bytes = [t.encode() for t in self.tokens]
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self._byte = str.maketrans({chr(b): c for b, c in byte_symbols().items()})

        def key(t: str) -> str:
            return t[: -len(suffix)] + _END if suffix and t.endswith(suffix) else t

        self.vocab = {key(t): i for t, i in model["vocab"].items()}
        self.longest = max(map(len, self.vocab))
        n = len(self.tokens)
        # rank 0 for symbols, then merges in their order; a merge never ranks below what it joins
        self.rank = np.zeros(n, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys, out = [], []
        for r, m in enumerate(model["merges"], 1):
            a, b = m.split(" ") if isinstance(m, str) else m
            ia, ib, ic = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if (ia, ib) in self.merges:
                continue
            self.merges[ia, ib] = (r, ic)
            if self.left[ic] == ic and ia != ic:
                self.rank[ic], self.left[ic], self.right[ic] = r, ia, ib
            keys.append(ia * n + ib)
            out.append(r)
        order = np.argsort(keys)
        self._pair, self._pair_rank = np.asarray(keys, np.int64)[order], np.asarray(out, np.int64)[order]
        # symbols are told apart by a rank below every merge
        self._order = np.where(self.rank > 0, self.rank + n, np.arange(n))
        self._offset = n
        self._itself = np.full(n, -1, np.int8)
        self._known: dict[str, tuple[int, ...]] = {}  # units met before, at most KNOWN

    # -- the three steps ------------------------------------------------------------------
    def propose(self, word: str) -> list[int]:
        """Greedy longest match over a word of byte-level symbols, the end mark included."""
        vocab, longest, out, i, n = self.vocab, self.longest, [], 0, len(word)
        last = n - 1 if word.endswith(_END) else -1  # the end mark never stands alone
        while i < n:
            j = min(n, i + longest)
            while (t := vocab.get(word[i:j])) is None or j == last:
                j -= 1
            out.append(t)
            i = j
        return out

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self._pair, k), len(self._pair) - 1)
        return np.where(self._pair[at] == k, self._pair_rank[at] + self._offset, _BIG)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart: undo merges from the later side, look for one that would have come first."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        ok, todo = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _BIG)
        order, left, right = self._order, self.left, self.right
        while len(todo):
            bad = self._merged(a, b) < limit
            ok[todo[bad]] = False
            keep = ~bad
            todo, a, b, limit = todo[keep], a[keep], b[keep], limit[keep]
            ra, rb = right[a], left[b]
            a_base, b_base = ra == a, rb == b
            first = np.where(order[a] > order[b], ~a_base, b_base & ~a_base)
            second = ~first & ~b_base
            limit = np.where(first, order[a], np.where(second, order[b] + 1, limit))
            a, b = np.where(first, ra, a), np.where(second, rb, b)
            go = first | second
            todo, a, b, limit = todo[go], a[go], b[go], limit[go]
        return ok

    def exact(self, word: str) -> list[int]:
        """Merge by rank, leftmost first, with a heap: n log n for words of any length."""
        ids: list[int] = [self.vocab[c] for c in self._symbols(word)]
        return self._merge(ids)

    def _symbols(self, word: str) -> Iterable[str]:
        return [*word[:-2], word[-2:]] if word.endswith(_END) else word

    def _merge(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        if n <= 40:  # a scan is faster than a heap
            none, get = (1 << 40, -1), merges.get
            best = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
            while best and (m := min(best)) is not none:
                i = best.index(m)
                ids[i : i + 2] = [m[1]]
                del best[i]
                if i < len(best):
                    best[i] = get((ids[i], ids[i + 1]), none)
                if i:
                    best[i - 1] = get((ids[i - 1], ids[i]), none)
            return ids
        nxt, prv, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(*merges[p], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heap = [(r, i, c) for r, c, i in heap]
        heapq.heapify(heap)
        while heap:
            r, i, c = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or merges.get((ids[i], ids[j])) != (r, c):
                continue
            ids[i], alive[j], nxt[i] = c, False, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
                if m := merges.get((c, ids[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if prv[i] >= 0 and (m := merges.get((ids[prv[i]], c))):
                heapq.heappush(heap, (m[0], prv[i], m[1]))
        return [t for t, x in zip(ids, alive, strict=True) if x]

    def _is_itself(self, tokens: np.ndarray) -> np.ndarray:
        for t in tokens[self._itself[tokens] < 0].tolist():
            parts, stack = [], [t]
            while stack:
                x = stack.pop()
                if self.left[x] == x:
                    parts.append(x)
                else:
                    stack += [int(self.right[x]), int(self.left[x])]
            self._itself[t] = self._merge(parts) == [t]
        return self._itself[tokens] == 1

    # -- whole units ----------------------------------------------------------------------
    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Distinct words of byte-level symbols to ids: propose, verify all borders at once, mend those that fail."""
        guess = [self.propose(w) for w in words]
        lens = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter(chain.from_iterable(guess), np.int64, int(lens.sum()))
        word = np.repeat(np.arange(len(words)), lens)
        used, at = np.unique(flat, return_inverse=True)
        failed = np.zeros(len(words), bool)
        failed[word[~self._is_itself(used)[at]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, at = np.unique(flat[inner] * len(self.tokens) + flat[inner + 1], return_inverse=True)
        ok = self.compatible(pairs // len(self.tokens), pairs % len(self.tokens))
        failed[word[inner[~ok[at]]]] = True
        for i in np.flatnonzero(failed).tolist():
            guess[i] = self.exact(words[i])
        return guess

    def split(self, unit: str) -> list[str | int]:
        """A unit free of white space to words of byte-level symbols, and ids of special tokens."""
        out: list[str | int] = []
        for part in self._special.split(unit) if self._special and "<|" in unit else (unit,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                if part.isascii() and part.isalpha():
                    out.append(part + _END)
                    continue
                for w in self._words.findall(part):
                    if not w.isascii():
                        w = w.encode().decode("latin-1").translate(self._byte)
                    elif not w.isprintable():
                        w = w.translate(self._byte)
                    out.append(w + _END)
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all units, and the number of ids of each."""
        known = self._known
        new = [u for u in units if u not in known]
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = units
        parts = [self.split(u) for u in new]
        words = list({w for p in parts for w in p if isinstance(w, str)})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        long: dict[str, tuple[int, ...]] = {}
        for u, p in zip(new, parts, strict=True):
            (known if len(u) <= KNOWN_LENGTH else long)[u] = tuple(ids[p[0]]) if len(p) == 1 and isinstance(p[0], str) else tuple(t for w in p for t in (ids[w] if isinstance(w, str) else (w,)))
        rows = [known[u] if u in known else long[u] for u in units]
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.uint32, int(lens.sum())), lens

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin (one bound more than texts)."""
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            units = pa.array([_NOT_WHITE.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            units = pc.utf8_split_whitespace(texts)
        bounds = np.asarray(units.offsets).astype(np.int64)
        bounds = bounds - bounds[0]
        coded = pc.dictionary_encode(units.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        flat, lens = self.encode_units(coded.dictionary.to_pylist())
        starts = np.cumsum(lens) - lens
        at = np.asarray(coded.indices).astype(np.int64)
        n = lens[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else flat[:0]
        return ids, ends[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens joined by spaces, special ones kept: what a model file without a decoder asks for."""
        return b" ".join(map(self._token_bytes.__getitem__, ids.tolist()))


@lru_cache(2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, ids: little-endian unsigned 32-bit integers) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in (x for batch in batches for x in slices(batch)):
            ids, at = model.encode_batch(b.column("text"))
            raw, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
            yield pa.record_batch([b.column("doc_id"), pa.array([raw[i:j] for i, j in zip(at, at[1:], strict=False)], pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc id, ids, decoded text) of rows that hold ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in (x for batch in batches for x in slices(batch, "ids")):
            texts = [model.decode(np.frombuffer(x, "<u4")).decode() for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """Per document: number of ids, and SHA-256 of ids and of the decoded text."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
