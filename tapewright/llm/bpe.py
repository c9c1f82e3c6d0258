"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  Each round looks every
neighbouring pair up in the sorted merge keys (binary search), finds each word's
lowest rank and merges all places of that rank at once, until no word has a
known pair.  Words are distinct pieces of a batch of texts, so a piece that
occurs a million times is merged once per cache life.

Results equal those of the ``tokenizers`` library for byte-level BPE files
without special post-processing; ``tests/llm/test_tokens.py`` compares them.  Words of more
than ``LONG_WORD`` bytes leave the rounds for a heap of the same merges, with the same ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PartCache, as_bytes, slices

_NONE = np.int64(1) << 60
#: Words of more bytes are merged with a heap: rounds would pass over all their symbols again and again.
LONG_WORD = 2048
#: Distinct pieces and parts whose ids a worker keeps; it lets go of old ones beyond them.
PIECES, PARTS = 100_000, 120_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Merges:
    """A vocabulary and its merges as arrays sorted by pair key."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        key = left * self.size + right
        key, first = np.unique(key, return_index=True)
        self.key, self.rank, self.made = key, first.astype(np.int64), made[first]
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(self.size)]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged id of each pair."""
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[at] == want
        return np.where(hit, self.rank[at], _NONE), self.made[at]

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, all words together in rounds."""
        out: list[list[int]] = [[]] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._merge_long(w)
            elif w:
                short.append(i)
        if not short:
            return out
        sym = self.of_byte[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        word = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
        done_sym, done_word = [], []
        # of place i: what the pair (i, i + 1) merges to, if it lies in one word
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        look = np.flatnonzero(word[:-1] == word[1:])
        while len(sym):
            rank[look], made[look] = self.find(sym[look], sym[look + 1])
            start = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, start)
            if (low == _NONE).any():
                over = (low == _NONE).repeat(np.diff(start, append=len(word)))
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
                if not len(sym):
                    break
                start = np.flatnonzero(np.diff(word, prepend=-1))
                low = low[low != _NONE]
            take = rank == low.repeat(np.diff(start, append=len(word)))
            both = take[1:] & take[:-1]
            if both.any():  # of places that overlap, as in "aaa", every second one from the left merges
                head = take.copy()
                head[1:] &= ~take[:-1]
                place = np.arange(len(take))
                take &= (place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0
            at = np.flatnonzero(take)
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            # only pairs beside a merged symbol are new
            at -= np.arange(len(at))
            near = np.zeros(len(sym), bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            look = np.flatnonzero(near)
            rank[look] = _NONE
            look = look[look + 1 < len(sym)]
            look = look[word[look] == word[look + 1]]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        ids = sym[np.argsort(word, kind="stable")].tolist()
        cut = [0, *np.cumsum(np.bincount(word, minlength=len(short))).tolist()]
        for i, a, b in zip(short, cut, cut[1:], strict=False):
            out[i] = ids[a:b]
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """One very long word: a heap of pairs over a linked list of symbols."""
        sym = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
        table = self._table()
        heap = [(r[0], i, sym[i], sym[i + 1]) for i in range(len(sym) - 1) if (r := table.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = table[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := table.get((sym[x], sym[y]))):
                    heapq.heappush(heap, (r[0], x, sym[x], sym[y]))
        return [s for s in sym if s >= 0]

    @lru_cache(maxsize=1)  # noqa: B019  one table a process
    def _table(self) -> dict[tuple[int, int], tuple[int, int]]:
        return {divmod(int(k), self.size): (int(r), int(m)) for k, r, m in zip(self.key, self.rank, self.made, strict=True)}

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Merges, PartCache]:
    """The merges of a file and a cache of parts, once a worker process."""
    import public_tokenizers
    import regex

    merges, pattern = Merges(path), regex.compile(public_tokenizers.PATTERN)

    known: dict[str, bytes] = {}

    def pieces(parts: list[str]) -> list[bytes]:
        # a run of letters, with or without one space before it, is one piece
        found = [[x] if x.isalpha() or x[:1] == " " and x[1:].isalpha() else pattern.findall(x) for x in parts]
        distinct = set(chain.from_iterable(found))
        fresh = [p for p in distinct if p not in known]
        if len(known) + len(fresh) > PIECES:
            known.clear()
            fresh = list(distinct)
        known.update(zip(fresh, map(as_bytes, merges.merge_words([p.encode() for p in fresh])), strict=True))
        return [known[x[0]] if len(x) == 1 else b"".join(map(known.__getitem__, x)) for x in found]

    return merges, PartCache(pieces, lambda text: pieces([text])[0], merges.special, PARTS)


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, and with ``keep_ids``
    also ids array<int>.  A null or empty text has no ids; a null doc_id stays null;
    repeated rows give repeated results; other columns are not read.  No shuffle.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, cache = codec(path)
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            # texts become Python strings a few at a time: a batch of whole texts is large
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for part in slices(sizes.tolist()):
                counts, digests, decoded, kept = [], [], [], []
                for raw in cache.encode_batch(texts[part].to_pylist()):
                    ids = np.frombuffer(raw, np.uint32)
                    listed = ids.tolist()
                    counts.append(len(listed))
                    digests.append(hashlib.sha256(",".join(map(merges.decimal.__getitem__, listed)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(merges.decode(listed).encode()).hexdigest())
                    if keep_ids:
                        kept.append(ids.astype(np.int32))
                columns = [ids_of[part], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(coded, schema)
