"""Model versions and aliases as a log of commits.

    <root>/<name>/versions/<folder>   a version's files, written once
    <root>/<name>/log/<number>.json   commit <number>

A version is first written into a folder of its own, then a commit makes it
known; moving an alias is a commit as well. A commit holds the state after it
(number of versions, and version and folder of every alias), so a reader looks
at the last one only and never sees a half-written model. Commit ``n + 1`` is
created if absent, in one atomic step; a writer that comes second reads the new
state and tries again, so no version number is given twice and no move of an
alias is lost.

The step is a hard link on a local file system and ``FileContext.rename``
without overwriting on others (atomic on HDFS; an object store needs a
connector whose rename or create is conditional).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "commit long, action string, version long, alias string, folder string, metrics map<string,double>, at string"
_WIDTH = 12


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def register(self, name: str, save: Callable[[str], None], metrics: dict | None = None) -> int:
        """Writes a model with ``save(folder)`` and returns its version number."""
        folder = f"{self.root}/{name}/versions/{uuid.uuid4().hex}"
        save(folder)

        def change(state: dict) -> dict:
            version = state["versions"] + 1
            return {"versions": version, "action": "register", "version": version, "folder": folder,
                    "metrics": {k: float(v) for k, v in (metrics or {}).items()}}

        return self._commit(name, change)["version"]

    def promote(self, name: str, version: int, alias: str = "Champion") -> None:
        """Moves ``alias`` to ``version``."""
        row = self.log(name).where((F.col("action") == "register") & (F.col("version") == version)).select("folder").first()
        if row is None:
            raise LookupError(f"no version {version} of {name}")

        def change(state: dict) -> dict:
            aliases = state["aliases"] | {alias: {"version": version, "folder": row.folder}}
            return {"aliases": aliases, "action": "promote", "version": version, "alias": alias, "folder": row.folder, "metrics": {}}

        self._commit(name, change)

    def resolve(self, name: str, alias: str = "Champion") -> tuple[int, str]:
        """Version and folder behind an alias."""
        found = self._state(name)[1]["aliases"].get(alias)
        if found is None:
            raise LookupError(f"no model {name}@{alias}")
        return found["version"], found["folder"]

    def log(self, name: str) -> DataFrame:
        """All commits: commit, action, version, alias, folder, metrics, at."""
        if not self._numbers(name):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).json(f"{self.root}/{name}/log/*.json")

    def metrics(self, name: str) -> DataFrame:
        """M5: (version, key, value) of every version."""
        return self.log(name).where("action = 'register'").select("version", F.explode("metrics").alias("key", "value"))

    # ------------------------------------------------------------ commits
    def _commit(self, name: str, change: Callable[[dict], dict]) -> dict:
        while True:  # every turn but the last is another writer's commit
            number, state = self._state(name)
            new = state | {"alias": None} | change(state) | {"commit": number + 1, "at": self.spark.range(1).select(F.current_timestamp().cast("string")).first()[0]}
            if self._create(f"{self.root}/{name}/log/{number + 1:0{_WIDTH}d}.json", json.dumps(new)):
                return new

    def _state(self, name: str) -> tuple[int, dict]:
        numbers = self._numbers(name)
        if not numbers:
            return 0, {"versions": 0, "aliases": {}}
        path = f"{self.root}/{name}/log/{numbers[-1]:0{_WIDTH}d}.json"
        return numbers[-1], json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        folder, fs = self._fs(f"{self.root}/{name}/log")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _create(self, path: str, text: str) -> bool:
        """The file with this text, if there is none yet; it appears whole."""
        target, fs = self._fs(path)
        draft = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}"
        if fs.getScheme() == "file":
            local = lambda p: self._fs(p)[0].toUri().getPath()
            os.makedirs(os.path.dirname(local(path)), exist_ok=True)
            with open(local(draft), "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(local(draft), local(path))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(local(draft))
        from py4j.protocol import Py4JJavaError

        source = self._fs(draft)[0]
        out = fs.create(source, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            fs.delete(source, False)
            return False
