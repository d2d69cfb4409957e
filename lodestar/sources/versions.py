"""Versions of a small document, each created by one writer alone.

A folder holds ``0000000007.json`` and so on; the latest is what counts. A writer claims the
next number by creating its claim file, which the file system lets one of them do, and the
version then appears whole, by rename. Whoever was too late reads again and repeats its change
on top of the other's.

A writer that dies between claim and rename leaves a claim without a version. After
STALE_SECONDS others take such a claim for void and remove it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

STALE_SECONDS = 600


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.folder = folder.rstrip("/")

    def file(self, name: str):
        """(file system, path) of a name in the folder."""
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self._conf), path

    def latest(self) -> dict | None:
        system, folder = self.file("")
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        names = sorted(n for n in names if n.endswith(".json"))
        if not names:
            return None
        system, path = self.file(names[-1])
        stream = system.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, content: dict) -> bool:
        """Whether this version is ours: another writer may have made it first."""
        system, temporary = self.file(f".{uuid.uuid4().hex}")
        _, claim = self.file(f"{version:010d}.claim")
        _, path = self.file(f"{version:010d}.json")
        if not self._claimed(system, claim, path):
            return False
        stream = system.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        return system.rename(temporary, path)

    def _claimed(self, system, claim, path) -> bool:
        system.mkdirs(claim.getParent())
        if system.exists(claim) and not system.exists(path):
            if time.time() - system.getFileStatus(claim).getModificationTime() / 1000 < STALE_SECONDS:
                return False
            system.delete(claim, False)
        try:
            return not system.exists(path) and system.createNewFile(claim)
        except Exception as error:  # some file systems raise where others return false
            if "FileAlreadyExists" in str(error):
                return False
            raise
