"""What was done: each stage's result under the digest of all that it was made from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.landing_table import names_in, put_text
from ..sources.shared import deleted, file_system


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


class Ledger:
    """Entries under ``path``: (stage, digest of inputs) and where the stage's tables lie.

    An entry appears by a rename after its tables are whole, so a killed stage leaves none and
    runs again.  A forced run writes new tables and a new entry beside the old one; the
    newest holds.  ``log`` tells which stages did work in this session.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log: list[tuple[str, bool]] = []

    def _entries(self, stage: str) -> list[tuple[int, str]]:
        """(running number, digest) of a stage's entries, in order."""
        found = (n.split("-", 1) for n in names_in(self.spark, f"{self.path}/ledger/{stage}", ".json"))
        return sorted((int(n), d) for n, d in found)

    def _tables(self, stage: str, number: int, inputs: str) -> dict[str, DataFrame]:
        told = json.loads(self.spark.read.text(f"{self.path}/ledger/{stage}/{number:08d}-{inputs}.json", wholetext=True).first()[0])
        return {name: self.spark.read.schema(t["schema"]).parquet(f"{self.path}/{t['folder']}") for name, t in told.items()}

    def number_of(self, stage: str) -> int:
        """The running number of a stage's newest entry, 0 if it has none."""
        return max((n for n, _ in self._entries(stage)), default=0)

    def digest_of(self, stage: str) -> str:
        """What the newest entry of a stage was made from."""
        return self._entries(stage)[-1][1]

    def latest(self, stage: str) -> dict[str, DataFrame] | None:
        """The tables that a stage wrote last, whatever they were made from."""
        entries = self._entries(stage)
        return self._tables(stage, *entries[-1]) if entries else None

    def once(self, stage: str, inputs: str, make: Callable[[], dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]], force: bool = False) -> dict[str, DataFrame]:
        """The stage's tables for these inputs: read if they were made before, made otherwise.

        ``make`` isn't called if they were; nothing but the ledger's names is read then.  A table may be
        a function of those that the stage wrote before it, so that what they took isn't done again.
        """
        entries = self._entries(stage)
        same = [n for n, d in entries if d == inputs]
        if same and not force:
            self.log.append((stage, False))
            return self._tables(stage, same[-1], inputs)
        told, done = {}, {}
        for name, df in make().items():
            df = df(done) if callable(df) else df
            folder = f"tables/{stage}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            done[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
            told[name] = {"folder": folder, "schema": ", ".join(f"`{c}` {t}" for c, t in df.dtypes)}
        number = 1 + max((n for n, _ in entries), default=0)
        put_text(self.spark, json.dumps(told), f"{self.path}/ledger/{stage}/{number:08d}-{inputs}.json")
        self.log.append((stage, True))
        return self._tables(stage, number, inputs)

    def cleared(self, stage: str, keep: int = 1) -> int:
        """Delete all but the newest entries of a stage and their tables; how many went."""
        old = self._entries(stage)[:-keep] if keep else self._entries(stage)
        for number, inputs in old:
            name = f"{self.path}/ledger/{stage}/{number:08d}-{inputs}.json"
            told = json.loads(self.spark.read.text(name, wholetext=True).first()[0])
            fs, where = file_system(self.spark, name)
            fs.delete(where, False)
            for t in told.values():
                deleted(self.spark, f"{self.path}/{t['folder']}")
        return len(old)
