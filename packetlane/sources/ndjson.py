"""Growing files of answers, a JSON object a line, as a stream (format "ndjson_chunks")."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class NdjsonChunks(DataSource):
    """request, seq, text, last of the lines of all files of a folder; fields may be named by options (request, text, done).

    An offset is the end of the last whole line of each file, so a line that is still being written waits, and a batch that comes again reads
    the same bytes. seq counts a request's lines in its file. Lines that are no objects are skipped. The folder must be mounted everywhere.
    """

    @classmethod
    def name(cls):
        return "ndjson_chunks"

    def schema(self):
        return "request string, seq int, text string, last boolean"

    def streamReader(self, schema: StructType):  # noqa: N802
        return ChunkReader(self.options)


class ChunkReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["path"].removeprefix("file:")
        self.fields = [options.get("request", "request"), options.get("text", "response"), options.get("done", "done")]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for path in sorted(glob.glob(os.path.join(self.folder, "*.ndjson"))):
            end = os.path.getsize(path)
            with open(path, "rb") as f:
                while end:  # back to the last line's end
                    start = max(0, end - 65536)
                    f.seek(start)
                    at = f.read(end - start).rfind(b"\n")
                    if at >= 0:
                        end = start + at + 1
                        break
                    end = start
            if end:
                out[os.path.basename(path)] = end
        return out

    def partitions(self, start: dict, end: dict):
        return [InputPartition((name, start.get(name, 0), to)) for name, to in end.items() if to > start.get(name, 0)]

    def read(self, partition):
        name, start, end = partition.value
        request, text, done = self.fields
        seen: dict[str, int] = {}
        with open(os.path.join(self.folder, name), "rb") as f:
            while f.tell() < end:  # lines before the batch only count
                at, line = f.tell(), f.readline()
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(row, dict) or request not in row:
                    continue
                key = str(row[request])
                seq = seen[key] = seen.get(key, -1) + 1
                if at >= start:
                    yield key, seq, str(row.get(text) or ""), bool(row.get(done))
