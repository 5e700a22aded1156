"""Numbered states of a folder: small texts that appear whole or not at all, each number once.

To publish, a number is claimed by creating a file exclusively, so of two writers at once one fails. The text is written under a name of its own and
renamed, so a reader sees it whole or not. A writer that dies in between leaves a claim without a state: readers go on
with the state before, and a claim older than STALE_MS no longer counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

STALE_MS = 10 * 60_000


class PublishedMeanwhile(OSError):
    """Another writer has the number."""


class States:
    def __init__(self, spark: SparkSession, path: str, prefix: str = "state="):
        self.path, self.prefix = path.rstrip("/"), prefix
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop(f"{self.path}/{name}")

    def names(self) -> list[str]:
        root = self._hadoop(self.path)
        return [s.getPath().getName() for s in self._store.listStatus(root)] if self._store.exists(root) else []

    def numbers(self) -> list[int]:
        """Numbers of the published states, rising."""
        found = (n.removeprefix(self.prefix) for n in self.names() if n.startswith(self.prefix))
        return sorted(int(n) for n in found if n.isdigit())

    def read(self, number: int) -> str | None:
        """The text of a state; None for one that can't be read."""
        at = self._at(f"{self.prefix}{number}")
        if not self._store.exists(at) or self._store.getFileStatus(at).getLen() < 3:
            return None
        file = self._store.open(at)
        try:
            text = file.readUTF()
        except Exception:  # cut short by something else than this class
            return None
        finally:
            file.close()
        return text

    def newest(self) -> tuple[int, str] | None:
        """Number and text of the newest state that can be read."""
        for number in reversed(self.numbers()):
            text = self.read(number)
            if text is not None:
                return number, text
        return None

    def next_number(self) -> int:
        return max(self.numbers(), default=0) + 1

    def publish(self, number: int, text: str) -> None:
        """Make `text` the state of a number; PublishedMeanwhile if it has one or another writer claims it."""
        claim, target = self._at(f".claim-{number}"), self._at(f"{self.prefix}{number}")
        if self._store.exists(claim) and not self._store.exists(target):
            now = self._store.getFileStatus(claim).getModificationTime()
            if _now_ms() - now > STALE_MS:
                self._store.delete(claim, False)
        try:
            self._store.create(claim, False).close()
        except Exception as error:
            raise PublishedMeanwhile(f"{self.prefix}{number} of {self.path} was published meanwhile") from error
        if self._store.exists(target):
            raise PublishedMeanwhile(f"{self.prefix}{number} of {self.path} was published meanwhile")
        temporary = self._at(f".tmp-{uuid.uuid4().hex}")
        out = self._store.create(temporary, False)
        out.writeUTF(text)
        out.close()
        if not self._store.rename(temporary, target):
            self._store.delete(temporary, False)
            raise PublishedMeanwhile(f"could not publish {self.prefix}{number} of {self.path}")


def _now_ms() -> int:
    import time

    return int(time.time() * 1000)
