"""A folder of versioned artifacts: data is written under new names, and one manifest, put in place by one rename, makes a version of them.

manifest-<number>.json names every artifact of a version. It is written aside, closed and renamed to the next free number, which fails if another writer took
that number; so a reader sees the whole version before or the whole version after, and of two writers one is told. What a failed build leaves is named by no
manifest and goes with the next `vacuum`. The folder must be in a file system whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer has put a version in place since this one was read."""


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    folder: str

    def path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{name}".rstrip("/"))

    def conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def files(self):
        return self.path().getFileSystem(self.conf())

    def numbers(self) -> list[int]:
        """Versions that are in place, oldest first."""
        if not self.files().exists(self.path()):
            return []
        names = [s.getPath().getName() for s in self.files().listStatus(self.path())]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def read(self, number: int | None = None) -> dict | None:
        """A version's manifest, the newest for None; None if there is none."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return None
            number = numbers[-1]
        stream = self.files().open(self.path(f"manifest-{number:09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def new_data(self) -> str:
        """A folder for artifacts that no version names yet."""
        return f"{self.folder.rstrip('/')}/data-{uuid.uuid4().hex}"

    def commit(self, manifest: dict, after: int | None) -> dict:
        """Puts a version in place after version `after` (None: the first). Its "data" lists the folders it needs."""
        number = (after or 0) + 1
        whole = manifest | {"number": number}
        aside = self.path(f"aside-{uuid.uuid4().hex}")
        stream = self.files().create(aside, True)
        stream.write(json.dumps(whole, ensure_ascii=False).encode())
        stream.close()
        try:
            self.rename(aside, self.path(f"manifest-{number:09d}.json"))
        except Py4JJavaError as error:
            self.files().delete(aside, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise ConflictError(f"version {number} is there already") from None
            raise
        return whole

    def rename(self, source, target) -> None:
        """Fails if the target is there."""
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files().makeQualified(source).toUri(), self.conf()).rename(self.files().makeQualified(source), self.files().makeQualified(target), none)

    def vacuum(self, keep: int = 1, older_than_s: float = 86_400.0) -> list[str]:
        """Removes versions but the newest `keep`, and data and manifests aside that no version left names and that are older than a running build can be."""
        numbers = self.numbers()
        gone = [f"manifest-{n:09d}.json" for n in numbers[: max(0, len(numbers) - keep)]]
        needed = {d.rstrip("/").rpartition("/")[2] for n in numbers[-keep:] for d in self.read(n)["data"]}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        if self.files().exists(self.path()):
            for s in self.files().listStatus(self.path()):
                name = s.getPath().getName()
                if name not in needed and name.startswith(("data-", "aside-")) and now - s.getModificationTime() >= 1000 * older_than_s:
                    gone.append(name)
        for name in gone:
            self.files().delete(self.path(name), True)
        return gone
