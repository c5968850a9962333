"""An endless, replayable generator as a streaming data source.

The reference's generator yields ``rows[i % n]`` for ever.  ``CyclicSteps``
is the ``i``: a stream of ``(step, row_no, epoch)``, whose offsets are steps.
Each trigger opens ``rowsPerBatch`` further steps, cut into ``partitions``
ranges that tasks generate on their own; a batch that is run again, after a
failure or a restart, has the very same rows.

Spark doesn't tell a Python source where its query stands, so the source notes
the end of each batch that it plans in the file ``progress`` before the batch
runs (written beside and renamed).  The note is never behind the query's own
log, so a restarted query goes on where it stopped.  With ``steps`` the stream
ends there.  An empty table (``rows`` 0) has no steps at all.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .named_files import file_system

# the reader runs in Python workers; see hooks.py
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of an Arrow batch.
CHUNK = 1 << 16


class Steps(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CyclicReader(DataSourceStreamReader):
    def __init__(self, rows: int, per_batch: int, partitions: int, steps: int | None, progress: str):
        self.rows, self.per_batch, self.many, self.steps, self.progress = rows, per_batch, max(1, partitions), steps, progress
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self._noted()
        if self.rows:
            self.at += self.per_batch
        if self.steps is not None:
            self.at = min(self.at, self.steps)
        return {"step": self.at if self.rows else 0}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = start["step"], end["step"]
        if last > self._noted():
            self._note(last)
        cuts = [first + (last - first) * i // self.many for i in range(self.many + 1)]
        return [Steps(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def read(self, partition: Steps) -> Iterator[pa.RecordBatch]:
        for at in range(partition.first, partition.last, CHUNK):
            step = np.arange(at, min(at + CHUNK, partition.last))
            yield pa.record_batch([pa.array(step), pa.array(step % self.rows), pa.array(step // self.rows)], ["step", "row_no", "epoch"])

    def commit(self, end: dict) -> None:
        pass

    def _noted(self) -> int:
        fs, path = file_system(self.progress)
        if fs.get_file_info(path).type != pafs.FileType.File:
            return 0
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())["step"]

    def _note(self, step: int) -> None:
        fs, path = file_system(self.progress)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        beside = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(beside) as f:
            f.write(json.dumps({"step": step}).encode())
        fs.move(beside, path)


class CyclicSteps(DataSource):
    """``spark.readStream.format("cyclic_steps")`` with the options rows,
    rowsPerBatch, partitions, steps (none: endless) and progress."""

    @classmethod
    def name(cls) -> str:
        return "cyclic_steps"

    def schema(self) -> str:
        return "step long, row_no long, epoch long"

    def streamReader(self, schema) -> CyclicReader:
        o = self.options
        return CyclicReader(int(o["rows"]), int(o.get("rowsPerBatch", 1000)), int(o.get("partitions", 8)),
                            int(o["steps"]) if "steps" in o else None, o["progress"])
