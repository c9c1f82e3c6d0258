"""Token counts at every prefix of a text, for sentencepiece BPE models.

A BPE encoding is decided by its neighbours: tokens t1 ... tn are the encoding of their text
if and only if every pair of neighbours encodes to just these two tokens, since a merge
across a border would also happen with the two tokens alone.  So each prefix ends with
exactly one token that goes with the last token of the prefix before it, and

    count[end] = count[start of that token] + 1

gives the count of every prefix in one walk.  No piece has a space behind its first other
character, so the walk starts anew at every run of spaces; what words share is kept.

The table holds one signed byte for each character: by how much the count changes there.
Questions about truncation and budgets are answered from it, without encoding again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .pretokens import text_batches

SPACE = "▁"
TABLE = "doc_id long, n_chars long, n_bytes long, n_tokens long, steps binary"


class Pieces:
    """Merge rules of a sentencepiece BPE model with byte fallback, and the walk over prefixes.

    Words of up to ``SHORT`` characters are remembered, and of two generations of ``limit`` words the
    older one goes; results don't depend on it.  Models that change characters before they
    encode (anything but spaces and a space put in front) are refused.
    """

    SHORT = 48

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "ﬁ  Á Ａ "
        if "".join(model.encode(probe, out_type=str)).count("<0x") == 0 and "".join(model.encode(probe, out_type=str)) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model changes texts before it encodes them")
        if not any(model.is_byte(i) for i in range(model.vocab_size())):
            raise ValueError("the model has no byte fallback")
        self.score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        self.longest = max(map(len, self.score))
        if self.longest > 24:
            raise ValueError("counts may change by more than a byte holds")
        inner = any(SPACE in p.lstrip(SPACE) for p in self.score)
        # characters that no piece holds never merge: a text can be cut around them
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.score))
        word = f"[^{SPACE}{re.escape(alone)}]"
        self.parts = re.compile(f"[{re.escape(alone)}]|{SPACE}+{word}*|{word}+" if alone else f"{SPACE}+{word}*|{word}+") if not inner else re.compile("(?s).+")
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: what can stand behind a token, by token
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short string: the pair of best score merges first, ties from the left."""
        tokens = list(text)
        while len(tokens) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(tokens, tokens[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            at = scores.index(best)
            tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]
        return tokens

    def _goes(self, before: str, token: str, known: dict[str, bool]) -> bool:
        """Whether the two encode to themselves side by side (``before`` may be empty); ``known`` holds what goes behind ``before``."""
        self.n_pairs += 1
        yes = known[token] = self.merged(before + token) == ([before, token] if before else [token])
        return yes

    def walk(self, word: str) -> bytes:
        """By how much the count of tokens changes with each character, as signed bytes."""
        score, longest, pairs = self.score, self.longest, self.pairs
        if self.n_pairs > 2 * self.limit:
            pairs.clear()
            self.n_pairs = 0
        # what may follow each prefix's last token, that token's start, the count
        behind, starts, count, steps = [pairs.setdefault("", {})], [0], [0], []
        for end in range(1, len(word) + 1):
            # one start alone is right, so the likely ones go first: the last token grows, or the character stands alone
            start = starts[-1]
            for start in (start, end - 1, *range(max(0, end - longest), end - 1)):
                token = word[start:end]
                if token in score:
                    known = behind[start]
                    yes = known.get(token)
                    if yes is None:
                        yes = self._goes(word[starts[start] : start], token, known)
                    if yes:
                        n = count[start] + 1
                        break
            else:  # a character without a piece: its bytes
                start, token = end - 1, word[end - 1]
                n = count[start] + len(token.encode())
            steps.append((n - count[-1]) & 255)
            starts.append(start)
            behind.append(pairs.get(token) or pairs.setdefault(token, {}))
            count.append(n)
        return bytes(steps)

    def _fresh(self, part: str) -> bytes:
        """The steps of a part not met lately: cut between characters that no piece has side by side."""
        inside, at, out = self.inside, 0, []
        for i in range(1, len(part)):
            if part[i - 1 : i + 1] not in inside:
                out.append(part[at:i])
                at = i
        if not at:
            return self.walk(part)
        return b"".join([self._steps_of(x) for x in (*out, part[at:])])

    def _steps_of(self, part: str) -> bytes:
        got = self.known.get(part)
        if got is None:
            got = self.older.get(part)
            if got is None:
                got = self._fresh(part)
            if len(part) <= self.SHORT:
                self.known[part] = got
        return got

    def steps(self, text: str) -> bytes:
        """One signed byte for each character of ``text``: the change of the count of tokens there."""
        if not text:
            return b""
        of = self._steps_of
        # the space put in front belongs to the first character
        out = b"".join([of(part) for part in self.parts.findall(SPACE + text.replace(" ", SPACE))])
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        return bytes([(out[0] + out[1]) & 255]) + out[2:]


def prefix_table(docs: DataFrame, model: str) -> DataFrame:
    """For each document: doc_id, n_chars, n_bytes (UTF-8), n_tokens and ``steps``.

    ``steps`` has one signed byte for each character; the sum of the first p of them is the
    exact number of tokens of the text's first p characters, as sentencepiece's ``encode``
    gives them for the model in the file ``model``.  A null text counts as empty: no steps,
    no tokens.  Repeated rows and null doc_ids give rows of their own; other columns are not
    read; an empty table gives an empty one.  Texts may be of any length: the walk is linear.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in text_batches(texts):
                some = [x or "" for x in texts[part]]
                steps = [pieces.steps(x) for x in some]
                total = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in steps]
                columns = [
                    batch.column(0)[part.start : part.stop], pa.array([len(x) for x in some], pa.int64()), pa.array([len(x.encode()) for x in some], pa.int64()),
                    pa.array(total, pa.int64()), pa.array(steps, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_bytes", "n_tokens", "steps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TABLE)


def _counts(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)


@F.pandas_udf(LongType())
def tokens_at(steps: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first ``chars`` characters (of the whole text if it is shorter; 0 below 1)."""

    def one(s: bytes | None, n: float) -> int | None:
        if s is None or n != n:
            return None
        return int(np.frombuffer(s, np.int8)[: max(0, int(n))].sum(dtype=np.int64))

    return pd.Series([one(s, n) for s, n in zip(steps, chars, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def longest_within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix of at most ``budget`` tokens.

    Counts may fall from one prefix to the next (a word's end can merge what its middle
    could not), so this is the last prefix within the budget, not the first beyond it.
    """

    def one(s: bytes | None, n: float) -> int | None:
        if s is None or n != n:
            return None
        within = np.nonzero(_counts(s) <= n)[0]
        return int(within[-1]) + 1 if len(within) else 0

    return pd.Series([one(s, n) for s, n in zip(steps, budget, strict=True)], dtype="Int64")


def truncated(docs: DataFrame, table: DataFrame, budget: int) -> DataFrame:
    """``docs`` (doc_id unique) with every text cut to its longest prefix of at most ``budget`` tokens, and ``n_tokens``.

    Texts of documents that the table lacks are null.
    """
    keep = table.select("doc_id", longest_within("steps", F.lit(budget)).alias("_keep"), tokens_at("steps", longest_within("steps", F.lit(budget))).alias("n_tokens"))
    rest = [c for c in docs.columns if c not in ("text", "n_tokens")]
    return docs.join(keep, "doc_id", "left").select(*rest, F.expr("CASE WHEN _keep IS NOT NULL THEN substring(text, 1, CAST(_keep AS INT)) END").alias("text"), "n_tokens")


def over(limit: int) -> Column:
    """Whether a row of the table has more than ``limit`` tokens."""
    return F.col("n_tokens") > limit
