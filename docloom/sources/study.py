"""Study table with commits (H6): trials appended by many writers.

``path/data/<part>`` holds the Parquet files of one append; it is visible only
through ``path/commits/<version>.json``, which names it.  A commit file is
written under another name and made visible by one atomic step that fails
where the version exists; the writer then takes the next version.  So no append
is lost, a failed one is never seen, and a reader of a version always gets the
same rows.

Defined results: a table without commits has no rows (and must be given a
schema); null trial ids are one trial of their study; of several attempts at a
trial the latest commit counts, inside one commit the greatest ``attempt``
(null least), then the greatest row as JSON.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"([0-9]{20})\.json")


class CommitConflict(RuntimeError):
    """Every version tried was taken by another writer."""


class StudyTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        p, fs = self._at(f"{self.path}/commits")
        if not fs.exists(p):
            return []
        names = [m[1] for s in fs.listStatus(p) if (m := _VERSION.fullmatch(s.getPath().getName()))]
        return sorted(map(int, names))

    def _manifest(self, version: int) -> dict:
        p, fs = self._at(f"{self.path}/commits/{version:020d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, trials: DataFrame, study: str) -> str:
        """Write the trials of one append; not visible yet.  Returns the part's name."""
        part = uuid.uuid4().hex
        trials.withColumn("study", F.lit(study)).write.parquet(f"{self.path}/data/{part}")
        return part

    def commit(self, part: str, retries: int = 100) -> int:
        """Make a staged part visible; returns its version.  A part that is
        committed already keeps its version."""
        known = self.versions()
        for v in known:
            if self._manifest(v)["part"] == part:
                return v
        for version in range(known[-1] + 1 if known else 1, (known[-1] if known else 0) + 1 + retries):
            if self._publish(json.dumps({"version": version, "part": part}), f"{self.path}/commits/{version:020d}.json"):
                return version
        raise CommitConflict(f"{retries} versions were taken")

    def _publish(self, text: str, target: str) -> bool:
        """Write a whole file that must not exist yet; false where it does."""
        temp = f"{self.path}/commits/.{uuid.uuid4().hex}.tmp"
        p, fs = self._at(temp)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()
        dst, _ = self._at(target)
        try:
            if fs.getUri().getScheme() == "file":  # a local rename replaces; a link doesn't
                local = [re.sub("^file:/*", "/", x) for x in (temp, target)]
                os.link(*local)
                return True
            options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
            none = self.spark.sparkContext._gateway.new_array(options, 1)
            none[0] = options.NONE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(p, dst, none)
            return True
        except FileExistsError:
            return False
        except Exception:
            if fs.exists(dst):
                return False
            raise
        finally:
            if fs.exists(p):
                fs.delete(p, False)

    def append(self, trials: DataFrame, study: str) -> int:
        """Append trials (trial_id, any columns) to a study; returns the version."""
        return self.commit(self.stage(trials, study))

    def read_all(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        """All attempts up to ``version`` (default: now) with ``commit_version``.
        Columns that an append lacks are null."""
        parts = {self._manifest(v)["part"]: v for v in self.versions() if version is None or v <= version}
        if not parts:
            if schema is None:
                raise FileNotFoundError(f"{self.path} has no commits")
            return self.spark.createDataFrame([], f"{schema}, commit_version long")
        reader = self.spark.read.option("mergeSchema", True)
        rows = (reader.schema(schema) if schema else reader).parquet(*[f"{self.path}/data/{x}" for x in parts])
        known = self.spark.createDataFrame(list(parts.items()), "_st_part string, commit_version long")
        named = rows.withColumn("_st_part", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/[^/]*$", 1))
        return named.join(known, "_st_part").drop("_st_part")

    def read(self, version: int | None = None, schema: str | None = None, attempt: str = "attempt") -> DataFrame:
        """The latest attempt at each (study, trial_id)."""
        rows = self.read_all(version, schema)
        own: Column = F.col(attempt) if attempt in rows.columns else F.lit(0)
        whole = F.struct(*rows.columns)
        best = F.max_by(whole, F.struct("commit_version", own, F.to_json(whole)))
        return rows.groupBy("study", "trial_id").agg(best.alias("_st_row")).select("_st_row.*")
