"""A streaming source of frames: folders of images, the newest of each run only.

    spark.dataSource.register(FrameSource)
    spark.readStream.format("frames").option("path", "/cameras").load()

A run is a folder of ``<number>.jpg``. An offset holds each run's highest number, so
a restart goes on where its checkpoint ends. A batch takes the newest frame of each
run and skips those it has overtaken: frames are dropped, never queued. A
folder that can't be listed for a while (a camera or a mount that is away) keeps
its offset, and its frames come once it is back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "run_id string, seq long, skipped long, content binary"


@dataclass
class Newest(InputPartition):
    """The frame of a run that a batch takes, and how many it skips."""

    run_id: str
    seq: int
    skipped: int


class FrameSource(DataSource):
    """Options: ``path``, and ``every`` to take each frame instead of the newest (for replays)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameReader(self.options["path"], self.options.get("every", "false").lower() == "true")


class FrameReader(DataSourceStreamReader):
    def __init__(self, path: str, every: bool = False):
        self.path, self.every = path, every
        self.known: dict[str, int] = {}

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def _numbers(self) -> dict[str, list[int]]:
        """The frames there are, by run; none of a run whose folder can't be listed now."""
        from pyarrow import fs

        system, root = self._files()
        found: dict[str, list[int]] = {}
        try:
            runs = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory]
        except OSError:
            return {}
        for folder in runs:
            try:
                infos = system.get_file_info(fs.FileSelector(folder))
            except OSError:
                continue
            stems = [i.base_name.rpartition(".") for i in infos if i.is_file]
            found[folder.rstrip("/").rpartition("/")[2]] = sorted(int(s) for s, _, kind in stems if kind == "jpg" and s.isdigit())
        return found

    def initialOffset(self) -> dict:
        return {"runs": "{}"}

    def latestOffset(self) -> dict:
        for run, numbers in self._numbers().items():
            if numbers:
                self.known[run] = max(numbers[-1], self.known.get(run, -1))
        return {"runs": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, until = json.loads(start["runs"]), json.loads(end["runs"])
        self.known = {r: max(n, self.known.get(r, -1)) for r, n in (before | until).items()} | {r: n for r, n in self.known.items() if r not in before | until}
        there, out = self._numbers(), []
        for run, last in sorted(until.items()):
            due = [n for n in there.get(run, ()) if before.get(run, -1) < n <= last]
            if self.every:
                out += [Newest(run, n, 0) for n in due]
            elif due:
                out.append(Newest(run, due[-1], len(due) - 1))
        return out

    def read(self, partition: Newest) -> Iterator[tuple]:
        system, root = self._files()
        try:
            with system.open_input_stream(f"{root}/{partition.run_id}/{partition.seq}.jpg") as stream:
                content = stream.read()
        except OSError:  # gone meanwhile: a frame that is lost isn't waited for
            return
        yield partition.run_id, partition.seq, partition.skipped, content

    def commit(self, end: dict) -> None:
        pass
