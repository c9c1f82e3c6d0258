"""Cutting texts at places where byte-level BPE never joins symbols.

A byte-level pre-tokenizer lets a piece start with one space and never lets a
piece hold anything but white space behind which more white space follows.  So
a text without neighbouring white-space characters can be cut before each space
and each line break, and the cut parts encode exactly as they do within the
text.  Other texts are left to the caller's own path.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

#: White space other than spaces and line breaks; texts with it are not cut.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Marks that form a piece of their own behind a word.
_MARKS = ".,;:!?"


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class PartCache:
    """Ids of parts that texts share, in bounded memory, as bytes of unsigned 32-bit integers.

    ``encode_parts`` gets a list of distinct strings and returns the bytes of their ids.
    ``encode_odd`` gets one text that cannot be cut and returns the bytes of its ids.
    ``special`` maps strings that stand for one id wherever they occur.
    Of two generations of about ``limit`` parts the older one goes; results don't depend on it.
    """

    def __init__(
        self,
        encode_parts: Callable[[list[str]], list[bytes]],
        encode_odd: Callable[[str], bytes],
        special: dict[str, int] | None = None,
        limit: int = 400_000,
    ):
        self.encode_parts, self.encode_odd, self.limit = encode_parts, encode_odd, limit
        self.special = special or {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def _parts(self, text: str) -> list[str] | None:
        """The parts of a text, or None if it cannot be cut.

        The first part is marked by a NUL before it (and, as all parts, follows no space
        character); a part that begins a line has the line break before it; what is left
        out before every other part is one space.
        """
        if "\0" in text or _OTHER_SPACE.search(text):
            return None
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or "\n" in parts:  # two side by side, or one at an end
            return None
        parts[0] = "\0" + parts[0]
        return parts

    def _learn(self, fresh: list[str]) -> None:
        """A word with a mark behind it has the ids of the word, then those of the mark."""
        cores = {x: x[:-1] for x in fresh if x[-1] in _MARKS and x[-2:-1].isalnum()}
        wanted = dict.fromkeys(x for x in fresh if x not in cores)
        wanted.update(dict.fromkeys(c for c in cores.values() if c not in self.known))
        if wanted:
            texts = [x if x[0] == "\n" else x[1:] if x[0] == "\0" else " " + x for x in wanted]
            self.known.update(zip(wanted, self.encode_parts(texts), strict=True))
        if cores and not self.marks:
            self.marks = dict(zip(_MARKS, self.encode_parts(list(_MARKS)), strict=True))
        for x, core in cores.items():
            self.known[x] = self.known[core] + self.marks[x[-1]]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text; none for a null or empty one."""
        jobs: list[list[tuple[list[str] | None, str, int | None]]] = []
        seen: set[str] = set()
        for text in texts:
            jobs.append([])
            for plain, special in self._segments(text or ""):
                parts = self._parts(plain) if plain else []
                seen.update(parts or ())
                jobs[-1].append((parts, plain, special))
        fresh = []
        for x in seen.difference(self.known):
            got = self.older.get(x)
            if got is None:
                fresh.append(x)
            else:
                self.known[x] = got
        self._learn(fresh)
        of = self.known.__getitem__
        out = []
        for job in jobs:
            ids = b""
            for parts, plain, special in job:
                ids += self.encode_odd(plain) if parts is None else b"".join(map(of, parts))
                ids += as_bytes([special]) if special is not None else b""
            out.append(ids)
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        return out

    def _segments(self, text: str) -> list[tuple[str, int | None]]:
        """Runs of ordinary text, each with the id of the special string behind it."""
        if self.split_special is None or not any(x in text for x in self.special):
            return [(text, None)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out.append((text[at : m.start()], self.special[m.group()]))
            at = m.end()
        return [*out, (text[at:], None)]


def slices(sizes: list[int], most: int = 1_000_000) -> list[slice]:
    """Slices of a list of things of those sizes, of about ``most`` in all, one thing at least."""
    cuts, room = [0], 0
    for i, size in enumerate(sizes):
        room += size
        if room >= most and i + 1 < len(sizes):
            cuts.append(i + 1)
            room = 0
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)]


def text_batches(texts: list[str | None], chars: int = 1_000_000) -> list[slice]:
    """Slices of a list of texts of about so many characters, one text at least."""
    return slices([len(x or "") for x in texts], chars)
