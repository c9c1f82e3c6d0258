"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and context windows.

Learning: of a bounded sample of labelled rows (``LABELLED`` of them, smallest hashes
first) the words, and word beginnings, that occur in toxic texts and hardly ever in
clean ones become terms, each the longest beginning that keeps the support of its
shortest one.  They form a trie.

Scoring: the distinct words of a batch are run through the trie together, level by level,
each with the state of a Levenshtein automaton; the automaton is the same for all words,
as its input is which letters near the current place equal the trie's letter, and a
branch ends when no state can still accept.  Exact hits, misspelled
hits (``id1ot``, ``moroon``) and hits within quotation (quotation marks around, or a
reporting word shortly before) have different weights; the weighted count of hits gives
the score by a logistic curve fitted on the same labelled rows.

doc_id, lang, source and labels are never inputs of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

#: At most so many labelled rows are learned from.
LABELLED = 20_000
#: A term is at least so many times as common in toxic texts as in clean ones; at SUREST times its weight is 1.
PURITY, SUREST = 20, 200
#: A term occurs in at least so many toxic texts, in a sample of any size, and would be as toxic by chance at most so often.
LEAST, CHANCE = 5, 1e-5
#: Letters of scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han), and lengths of the runs of them that may be terms.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+)")
GRAMS = (2, 3, 4)
_WORD = re.compile(r"(?:[^\W_]|[@$!]+(?=[^\W_]))(?:[\w*@$!’'-]*[\w*@$])?")
#: Characters that stand for letters, quotation marks, reporting words.
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_SIGNS = "@$!"
_QUOTES = "\"“”„«»‘‹›"
_REPORTING = frozenset("said says wrote writes called calls quoted quote reported claimed dit écrit sagte schrieb dijo escribió".split())
#: Words on either side of a hit that belong to its context.
WINDOW = 8
#: Letters of the word beginnings that may be terms; words may have any length.
BEGINNINGS = 3, 12
#: A term of so many letters may have its first letter edited too.
LONG = 9
WEIGHT = {"exact": 1.0, "misspelled": 0.6}
QUOTED = 0.25
_MISS: tuple[str, float] = ("", 0.0)
_NOTHING: tuple[str, float, int] = ("", 0.0, 1)


def folded(word: str) -> str:
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()


class Lexicon:
    """Terms, as (term, whole word, weight).  ``clean`` are words of clean texts that no automaton may take for a term; without ``edits`` none does."""

    def __init__(self, terms: list[tuple[str, bool, float]], clean: set[str] | None = None, edits: bool = True):
        self.terms, self.clean = terms, clean or set()
        self.weight = {term: w for term, _, w in terms}
        self.words = {term for term, whole, _ in terms if whole}
        self.stems = {term for term, whole, _ in terms if not whole}
        self.lengths = sorted({len(term) for term in self.stems})
        self.least = self.lengths[0] if self.lengths else 1
        self.heads = {term[: self.least] for term in self.stems}
        self.trie = Trie([(term, whole) for term, whole, _ in terms])
        self.automata = {most: Automaton(most) for most in (1, 2)} if edits else {}

    def exact(self, word: str) -> str:
        """The term that a word is, or begins with; the shortest of them."""
        if word[: self.least] in self.heads:
            for k in self.lengths:
                if k <= len(word) and word[:k] in self.stems:
                    return word[:k]
        return word if word in self.words else ""

    def pieces(self, run: str) -> list[str]:
        """The terms in a run without spaces, from left to right, none within another."""
        out, i = [], 0
        while i < len(run):
            term = next((run[i : i + k] for k in self.lengths if run[i : i + k] in self.stems), "")
            out += [term] if term else []
            i += max(1, len(term))
        return out

    def within(self, words: list[str], most: int) -> list[str]:
        """For each word the nearest term at most ``most`` edits (insertion, deletion, change, swap of neighbours) away, or "".

        A term that is a word beginning is compared with all beginnings of the word.  Word
        terms need over three letters for each edit, beginnings over four, and the last
        letter of a beginning must stand (or be swapped) unless it has ``LONG`` letters.
        Terms whose first letter isn't the word's need ``LONG`` letters, and the word at
        most one fewer.  Of equally near terms the first by code points is taken.
        """
        return self.trie.nearest(words, self.automata[most])

    def hits(self, words: list[str]) -> list[tuple[str, float]]:
        """How folded words match: the kind of hit and its weight, or ("", 0)."""
        out, near = [_MISS] * len(words), {1: {}, 2: {}}
        for i, word in enumerate(words):
            if term := self.exact(word):
                out[i] = "exact", WEIGHT["exact"] * self.weight[term]
                continue
            forms = (word,)
            if not word.isalpha():
                bare = word.lstrip(_SIGNS)
                if bare != word and (term := self.exact(bare)):
                    out[i] = "exact", WEIGHT["exact"] * self.weight[term]
                    continue
                if not any(map(str.isalpha, word)):
                    continue
                forms = (bare, word) if bare != word else (word,)
            for form in forms:
                plain = form if form.isalpha() else "".join(filter(str.isalpha, form.translate(_LOOKALIKE)))
                if plain != form and (term := self.exact(plain)):
                    out[i] = "misspelled", WEIGHT["misspelled"] * self.weight[term]
                    break
                if len(plain) >= 4 and word not in self.clean and plain not in self.clean:
                    near[1 if len(plain) < LONG else 2].setdefault(plain, []).append(i)
        for most, forms in near.items() if self.automata else ():
            for form, term in zip(forms, self.within(list(forms), most), strict=True):
                if term:
                    for i in forms[form]:
                        if out[i] is _MISS:
                            out[i] = "misspelled", WEIGHT["misspelled"] * self.weight[term]
        return out


class Automaton:
    """The Levenshtein automaton for up to ``most`` edits, the same one for all words.

    Along a term, depth i, a state holds for each number of edits the positions i - 2 .. i + 2
    of the word that can be reached, as bits, and those behind the first letter of a swap.
    What a letter does depends on the state and on which of the word's letters i - 3 .. i + 3
    equal it; transitions are computed once and kept in a table.  State 0 is dead.
    """

    def __init__(self, most: int):
        self.most = most
        self.states: list[tuple[int, ...]] = [(0, 0, 0, 0, 0)]
        self.number = {self.states[0]: 0}
        self.table = np.full((64, 128), -1, np.int32)
        self.edits = np.full((64, 5), 9, np.int8)  # least edits at each position
        self.table[0] = 0
        self.start = self._state((4, 8, 16 if most > 1 else 0, 0, 0))

    def _state(self, s: tuple[int, ...]) -> int:
        n = self.number.get(s)
        if n is None:
            n = self.number[s] = len(self.states)
            self.states.append(s)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.edits = np.concatenate([self.edits, np.full_like(self.edits, 9)])
            for e in (2, 1, 0):
                self.edits[n, [k for k in range(5) if s[e] >> k & 1]] = e
        return n

    def _next(self, state: int, same: int) -> int:
        r0, r1, r2, t1, t2 = self.states[state]
        kept = same >> 1
        a = r0 & kept
        b = (r1 & kept | r0 >> 1 | r0 | a << 1 | t1 & same) & 31 & ~a
        c = (r2 & kept | r1 >> 1 | r1 | b << 1 | a << 1 | t2 & same) & 31 & ~a & ~b if self.most > 1 else 0
        if not a | b | c:
            return 0
        swap = same >> 2
        return self._state((a, b, c, r0 & swap, r1 & swap & ~r0 if self.most > 1 else 0))

    def step(self, states: np.ndarray, same: np.ndarray) -> np.ndarray:
        out = self.table[states, same]
        missing = out < 0
        if missing.any():
            for s, x in set(zip(states[missing].tolist(), same[missing].tolist(), strict=True)):
                n = self._next(s, x)
                self.table[s, x] = n
            out = self.table[states, same]
        return out


_FAR = 1 << 20
#: Words that go through the trie together.
TOGETHER = 4096


class Trie:
    """Terms as a trie in arrays; the children of a node are neighbours."""

    def __init__(self, terms: list[tuple[str, bool]]):
        root: dict = {}
        for term, whole in sorted(terms, key=lambda t: (not t[1], t[0])):
            node = root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, whole)  # a beginning takes the word too
        self.terms = sorted({t for t, _ in terms})
        place = {t: i for i, t in enumerate(self.terms)}
        nodes: list[tuple[dict, int, int, int]] = [(root, 0, 0, 0)]  # with letter, first letter, letter before
        begin, end, term, whole = [], [], [], []
        for node, letter, first, _ in nodes:
            begin.append(len(nodes))
            for c in sorted(x for x in node if x):
                nodes.append((node[c], ord(c), first or ord(c), letter))
            end.append(len(nodes))
            t = node.get("", ("", False))
            term.append(place[t[0]] if t[0] else -1)
            whole.append(t[1])
        self.begin, self.end, self.term, self.whole = np.array(begin), np.array(end), np.array(term), np.array(whole, bool)
        self.letter, self.first, self.before = (np.array([n[i] for n in nodes], np.int32) for i in (1, 2, 3))
        # of the terms at and below a node: shortest and longest word, shortest beginning, longest of all
        low, high, short, long = (np.full(len(nodes), x) for x in (_FAR, -_FAR, _FAR, 0))
        for i in range(len(nodes) - 1, -1, -1):
            below = slice(self.begin[i], self.end[i])
            low[i], high[i] = low[below].min(initial=_FAR), high[below].max(initial=-_FAR)
            short[i], long[i] = short[below].min(initial=_FAR), long[below].max(initial=0)
            if term[i] >= 0:
                n = len(self.terms[term[i]])
                long[i] = max(long[i], n)
                if whole[i]:
                    low[i], high[i] = min(low[i], n), max(high[i], n)
                else:
                    short[i] = n
        self.low, self.high, self.short, self.long = low, high, short, long

    def nearest(self, words: list[str], automaton: Automaton) -> list[str]:
        out = [""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            # words of about one length; very long ones fewer at a time
            block = order[at : at + max(1, min(TOGETHER, (1 << 20) // (len(words[order[at]]) + 8)))]
            at += len(block)
            for i, t in zip(block, self._nearest([words[i] for i in block], automaton), strict=True):
                out[i] = self.terms[t] if t >= 0 else ""
        return out

    def _nearest(self, words: list[str], automaton: Automaton) -> np.ndarray:
        size = np.array([len(w) for w in words])
        width = int(size.max())
        # three places before each word and beyond it hold no letter
        letters = np.full((len(words), width + 9), -1, np.int32)
        letters[:, 3 : 3 + width] = np.frombuffer("".join([w.ljust(width) for w in words]).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(words), width)
        letters[:, 3 : 3 + width][np.arange(width) >= size[:, None]] = -1
        best = np.full(len(words), _FAR)  # edits, then number of the term
        found = np.full(len(words), _FAR * 9)
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        state, depth = np.full(len(words), automaton.start, np.int32), 0
        powers = (1 << np.arange(7)).astype(np.int32)
        while len(word):
            if depth:
                counts = self.end[node] - self.begin[node]
                up = np.repeat(np.arange(len(word)), counts)
                child = np.arange(len(up)) - np.repeat(np.cumsum(counts) - counts, counts) + self.begin[node[up]]
            else:
                up, child = self._first(size, letters[:, 3])
            w, n = word[up], size[word[up]]
            other = self.first[child] != letters[w, 3]
            fits = ((self.low[child] <= n + automaton.most) & (self.high[child] >= n - automaton.most)) | (self.short[child] <= n + automaton.most)
            fits &= ~other | (self.long[child] >= LONG) & (n >= LONG - 1)
            up, child, w, n, other = up[fits], child[fits], w[fits], n[fits], other[fits]
            if depth + 7 > letters.shape[1]:
                letters = np.pad(letters, ((0, 0), (0, 8)), constant_values=-1)
            same = (letters[:, depth : depth + 7][w] == self.letter[child][:, None]) @ powers
            new = automaton.step(state[up], same)
            depth += 1
            alive = new > 0
            word, node, state, n, other = w[alive], child[alive], new[alive], n[alive], other[alive]
            ends = np.flatnonzero((self.term[node] >= 0) & (~other | (depth >= LONG)))
            if len(ends):
                self._accept(automaton, depth, word[ends], node[ends], state[ends], n[ends], letters, found)
        got = found < _FAR * 9
        best[got] = found[got] % _FAR
        return np.where(got, best, -1)

    def _first(self, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with the children of the root that may follow: their own first letter's, and for long words those of long terms."""
        top = np.arange(self.begin[0], self.end[0])
        if not len(top):
            return top, top
        at = np.minimum(np.searchsorted(self.letter[top], first), len(top) - 1)
        own = np.flatnonzero(self.letter[top[at]] == first)
        long = np.flatnonzero(size >= LONG - 1)
        far = top[self.long[top] >= LONG]
        up, child = np.repeat(long, len(far)), np.tile(far, len(long))
        other = self.letter[child] != first[up]
        return np.concatenate([own, up[other]]), np.concatenate([top[at[own]], child[other]])

    def _accept(self, automaton: Automaton, depth: int, word: np.ndarray, node: np.ndarray, state: np.ndarray, n: np.ndarray, letters: np.ndarray, found: np.ndarray) -> None:
        edits = automaton.edits[state].astype(np.int64)
        at = depth - 2 + np.arange(5)  # positions in the word
        ok = at == n[:, None]
        stem = np.flatnonzero(~self.whole[node])
        if len(stem):
            held = at <= n[stem, None]
            if depth < LONG:
                c, p = self.letter[node[stem]][:, None], self.before[node[stem]][:, None]
                last, prior = (letters[word[stem][:, None], np.clip(at + 2 - back, 0, letters.shape[1] - 1)[None, :]] for back in (0, 1))
                held &= (last == c) | (prior == c) & (last == p)
            ok[stem] = held
        least = np.where(ok, edits, 9).min(axis=1)
        good = (least <= automaton.most) & (depth > np.where(self.whole[node], 3, 4) * least)
        np.minimum.at(found, word[good], least[good] * _FAR + self.term[node[good]])


class Scorer:
    """Weighted hits of whole texts.  Words met are remembered up to a bound; results don't depend on it."""

    def __init__(self, lexicon: Lexicon, kept: int = 100_000):
        self.lexicon, self.kept = lexicon, kept
        self.known: dict[str, tuple[str, float, int]] = {}

    def chunks(self, new: Iterable[str]) -> dict[str, tuple[str, float, int]]:
        """For each run of characters without white space its best hit, and 1; with parts in a script without spaces the sum of hits, and their number."""
        known = self.known
        out = {c: known[c] for c in new if c in known}
        fresh = [c for c in new if c not in out]
        words: dict[str, tuple[str, float]] = {}
        split = []
        for c in fresh:
            runs: list[str] = []
            if c.isascii():
                found = [c.lower()] if c.isalpha() else _WORD.findall(c.lower())
            else:
                parts = _UNSPACED.split(c) if _UNSPACED.search(c) else [c]
                found, runs = [folded(x) for part in parts[::2] for x in _WORD.findall(part)], parts[1::2]
            for w in found:
                words[w] = _MISS
            split.append((found, runs))
        words = dict(zip(words, self.lexicon.hits(list(words)), strict=True))
        got = {}
        for c, (found, runs) in zip(fresh, split, strict=True):
            kind, weight = words[found[0]] if len(found) == 1 else max((words[w] for w in found), key=lambda x: x[1], default=_MISS)
            if runs and (terms := [t for run in runs for t in self.lexicon.pieces(folded(run))]):
                got[c] = ("exact", weight + WEIGHT["exact"] * sum(self.lexicon.weight[t] for t in terms), len(terms) + (weight > 0))
            else:
                got[c] = (kind, weight, 1) if weight else _NOTHING
        if len(known) + len(got) > self.kept:
            known.clear()
        if len(got) <= self.kept:
            known.update(got)
        return out | got

    def all_evidence(self, texts: Iterable[str | None]) -> Iterator[tuple[float, int, int, int]]:
        """Weighted sum, and numbers of exact, misspelled and quoted hits, of each text; texts share lookups up to some size."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(text.split() if text else [])
            size += len(held[-1])
            if size > 60_000:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def evidence(self, text: str | None) -> tuple[float, int, int, int]:
        return next(self.all_evidence([text]))

    def _together(self, held: list[list[str]]) -> Iterator[tuple[float, int, int, int]]:
        found = self.chunks(set().union(*held))
        bad = {c for c, x in found.items() if x[1]}
        for chunks in held:
            if bad.isdisjoint(chunks):
                yield 0.0, 0, 0, 0
                continue
            total, kinds = 0.0, Counter()
            for i, c in enumerate(chunks):
                if c in bad:
                    kind, weight, n = found[c]
                    if self._quoted(chunks, i):
                        kind, weight = "quoted", weight * QUOTED
                    kinds[kind] += n
                    total += weight
            yield total, kinds["exact"], kinds["misspelled"], kinds["quoted"]

    @staticmethod
    def _quoted(chunks: list[str], i: int) -> bool:
        """Whether a hit stands in quotation marks or shortly behind a reporting word and a mark.

        The marks are the nearest ones: a quotation that was closed before the hit doesn't hold it,
        nor does one that opens behind it.
        """
        before, after = chunks[max(0, i - WINDOW) : i], chunks[i + 1 : i + 1 + WINDOW]
        opens = lambda x: x[:1] in _QUOTES if x else False
        closes = lambda x: (x.rstrip(".,;:!?")[-1:] or " ") in _QUOTES
        last = next((x for x in reversed(before) if opens(x) or closes(x)), "")
        first = next((x for x in after if opens(x) or closes(x)), "")
        opened = opens(chunks[i]) or opens(last) and not closes(last)
        closed = closes(chunks[i]) or closes(first) and not opens(first)
        if opened and closed:
            return True
        reported = any(folded(x.strip(".,:;")) in _REPORTING for x in before)
        return reported and (opened or closed)


def _beginnings(text: str, wanted: set[str] | None = None) -> set[str]:
    """Words of a text, each with a NUL behind it, and their beginnings of ``BEGINNINGS`` letters.

    Of a run in a script without spaces all its pieces of ``GRAMS`` letters.  Only those in
    ``wanted`` are returned, if given; it holds the shorter beginnings of those it holds.
    """
    out: set[str] = set()
    words: set[str] = set()
    for chunk in set(text.split()):
        if chunk.isascii():
            words.update([chunk.lower()] if chunk.isalpha() else _WORD.findall(chunk.lower()))
            continue
        for part in _UNSPACED.split(chunk) if _UNSPACED.search(chunk) else [chunk]:
            if part and _UNSPACED.match(part):
                run = folded(part)
                out.update(run[i : i + k] for k in GRAMS for i in range(len(run) - k + 1))
            else:
                words.update(folded(x) for x in _WORD.findall(part))
    if wanted is not None:
        out &= wanted
    least, most = BEGINNINGS
    for w in words:
        w = w.lstrip(_SIGNS)
        if wanted is None:
            out.add(w + "\0")
            out.update([w[:k] for k in range(least, min(len(w), most) + 1)])
            continue
        if w + "\0" in wanted:
            out.add(w + "\0")
        for k in range(least, min(len(w), most) + 1):
            if w[:k] not in wanted:
                break
            out.add(w[:k])
    return out


def _counts(rows: DataFrame, column: str, wanted: set[str] | None, words_only: bool = False) -> DataFrame:
    """In how many texts each beginning occurs; a task sums up before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                n.update(_beginnings(text, wanted) if isinstance(text, str) else ())
                if len(n) > 200_000:
                    yield pd.DataFrame({"term": list(n), column: list(n.values())})
                    n.clear()
        yield pd.DataFrame({"term": list(n), column: list(n.values())}).astype({"term": object, column: "int64"})

    return rows.select("text").mapInPandas(run, f"term string, {column} long").groupBy("term").agg(F.sum(column).alias(column))


@dataclass
class Model:
    terms: list[tuple[str, bool, float]]
    clean: list[str]
    slope: float
    base: float

    def scorer(self) -> Scorer:
        return Scorer(Lexicon(self.terms, set(self.clean)))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * math.log1p(evidence)))))


def _terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """Beginnings with at least ``LEAST`` toxic texts that are PURITY times as common there as in clean ones.

    Their odds' lower confidence bound, exact and at the level 1 - CHANCE, is above even:
    where one text in nine is toxic, six toxic texts and no clean one are enough.

    Of the beginnings of one kind the longest that keeps 19 in 20 of the shortest's texts
    is taken; it is a whole word if the word alone keeps them, or several words if they
    cover it.  A term's weight follows its log odds and is 1 for the surest.
    """

    def odds(t: str) -> float:
        return (toxic[t] + 0.5) / (n_toxic + 1) * (n_clean + 1) / (clean.get(t, 0) + 0.5)

    def chance(t: str) -> float:
        """How often so many of the texts with a term, or more, would be toxic if it told nothing."""
        n, p = toxic[t] + clean.get(t, 0), n_toxic / (n_toxic + n_clean)
        ways = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(toxic[t], n + 1))
        return sum(map(math.exp, ways))

    good = {t: n for t, n in toxic.items() if n >= LEAST and odds(t) >= PURITY and chance(t) <= CHANCE}
    follows: dict[str, list[str]] = {}
    for t in good:
        follows.setdefault(t[:-1], []).append(t)
    words: dict[str, list[str]] = {}
    for t in good:
        if t.endswith("\0"):
            for k in range(3, len(t)):
                words.setdefault(t[:k], []).append(t)
    out: dict[str, bool] = {}
    for t in good:
        if t[:-1] in good or t[: BEGINNINGS[1]] in good and len(t) > BEGINNINGS[1] + 1:  # a shorter beginning is as telling
            continue
        stem, n = t, good[t]
        while longer := [x for x in follows.get(stem, []) if good[x] * 20 >= n * 19]:
            stem = max(longer, key=lambda x: (good[x], x))
        among = words.get(stem, [])
        if not stem.endswith("\0") and among and len(among) <= 3 and n * 19 <= sum(good[x] for x in among) * 20 <= n * 26:
            out.update(dict.fromkeys((x[:-1] for x in among), True))
        else:
            out[stem.rstrip("\0")] = stem.endswith("\0")
    weight = {t: min(1.0, math.log(odds(t + "\0" if whole else t)) / math.log(SUREST)) for t, whole in out.items()}
    return [(t, out[t], round(weight[t], 2)) for t in sorted(out)]


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and base of a curve over log(1 + evidence), from (evidence, clean, toxic) counts.

    Half a clean row without evidence and half a toxic one with evidence 1 are added, and
    the slope is held back a little, so that separable rows have an answer too.
    """
    points = [*points, (0.0, 0.5, 0), (1.0, 0, 0.5)]
    slope, base = 1.0, -1.0
    for _ in range(60):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for e, clean, toxic in points:
            x, n = math.log1p(e), clean + toxic
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, base + slope * x))))
            w = n * p * (1 - p)
            g0, g1 = g0 + toxic - n * p, g1 + (toxic - n * p) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        g1, h11, h00 = g1 - 1e-2 * slope, h11 + 1e-2, h00 + 1e-6
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        size = max(1.0, abs(d0) / 2, abs(d1) / 2)
        base, slope = base + d0 / size, slope + d1 / size
        if abs(d0) + abs(d1) < 1e-7:
            break
    return slope, base


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5, limit: int = LABELLED) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod ``fold`` is not 0.

    A doc_id with both labels counts as toxic; equal texts count once.  Without labelled
    rows of both kinds nothing is a term and every score is that of a text without hits.
    """
    label = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    learn = label.filter(F.crc32(F.col("doc_id").cast("string")) % fold != 0)
    sample = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # `limit` rows of twelve bytes at most, so the documents need no shuffle
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(sample), "doc_id")
    once = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    once = written(once, "labelled")
    size = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic = size.get(1, 0)
    if not n_toxic or not size.get(0):
        return Model([], [], 1.0, -3.0)
    toxic = {r["term"]: r["t"] for r in _counts(once.filter("toxic = 1"), "t", None).filter(F.col("t") >= LEAST).collect()}
    clean = {r["term"]: r["c"] for r in _counts(once.filter("toxic = 0"), "c", set(toxic)).collect()}
    terms = _terms(toxic, clean, n_toxic, size[0])
    lexicon = Lexicon(terms)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Words of clean texts that the automata would take for terms."""
        scorer, found = Scorer(lexicon), set()
        for batch in batches:
            for text in batch["text"]:
                hits = scorer.chunks(set(text.split()))
                found.update(folded(x) for chunk, hit in hits.items() if hit[0] == "misspelled" for x in _WORD.findall(chunk))
        yield pd.DataFrame({"term": list(found)}, dtype=object)

    # words of the bounded sample
    ordinary = [r["term"] for r in once.filter("toxic = 0").select("text").mapInPandas(taken, "term string").distinct().collect()]
    model = Model(terms, ordinary, 1.0, 0.0)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of clean texts all words that an automaton takes for terms are ordinary by now
        scorers = {1: model.scorer(), 0: Scorer(Lexicon(model.terms, set(model.clean), edits=False))}
        for batch in batches:
            for toxic, scorer in scorers.items():
                texts = batch["text"][batch["toxic"] == toxic]
                yield pd.DataFrame({"toxic": toxic, "e": [round(e[0], 1) for e in scorer.all_evidence(texts)]})

    curve = once.select("toxic", "text").mapInPandas(weigh, "toxic int, e double").groupBy("e").agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t"))
    model.slope, model.base = _logistic([(r["e"], r["c"], r["t"]) for r in curve.collect()])
    return model


#: What scoring adds to a row.
SCORED = ("score", "predicted", "exact_hits", "misspelled_hits", "quoted_hits")


def scoring(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of a text column: a struct of ``SCORED``."""
    told = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, predicted int, exact_hits int, misspelled_hits int, quoted_hits int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = told.value
        scorer = model.scorer()
        for texts in batches:
            found = list(scorer.all_evidence(x if isinstance(x, str) else None for x in texts))
            p = [model.score(e[0]) for e in found]
            kinds = {k: [e[i] for e in found] for i, k in ((1, "exact_hits"), (2, "misspelled_hits"), (3, "quoted_hits"))}
            yield pd.DataFrame({"score": p, "predicted": [int(x >= 0.5) for x in p]} | kinds)

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the columns ``SCORED``, which replace columns of these names; no shuffle."""
    kept = [c for c in docs.columns if c not in SCORED]
    found = docs.select(F.struct(*kept).alias("row"), scoring(docs.sparkSession, model)(F.col("text")).alias("found"))
    return found.select("row.*", "found.*")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, as they are, whose texts aren't predicted to be toxic."""
    return docs.filter(scoring(docs.sparkSession, model)(F.col("text"))["predicted"] == 0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and hit counts of every document.

    A null or empty text has the score of a text without hits.  A null doc_id is scored
    and not held out.  Repeated rows give repeated results; other columns are not read.
    """
    model = fit(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "exact_hits", "misspelled_hits", "quoted_hits")
