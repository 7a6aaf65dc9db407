"""A growing table as a stream: the offset is the largest id read, so nothing is read twice or polled row by row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from paceframe.runtime import send_by_value

NOTHING = -(2**63)


@dataclass
class Slice(InputPartition):
    """One row group and the ids wanted from it, ``after`` excluded and ``upto`` included."""

    file: str
    group: int
    after: int
    upto: int


class MarkReader(DataSourceStreamReader):
    """Reads the rows of Parquet files whose id lies between two marks.

    Only footers are read to find the newest id and the row groups to read; a task reads one row group, its wanted
    columns alone, batch by batch.
    """

    def __init__(self, path: str, key: str, columns: list[str]) -> None:
        self.path, self.key, self.columns = path, key, columns

    def initialOffset(self) -> dict:
        return {"mark": NOTHING}

    def latestOffset(self) -> dict:
        return {"mark": max((high for *_, high in self._groups()), default=NOTHING)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, upto = start["mark"], end["mark"]
        return [Slice(file, group, after, upto) for file, group, low, high in self._groups() if high > after and low <= upto]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, _ = _file_system(self.path)
        with files.open_input_file(partition.file) as raw:
            wanted = list(dict.fromkeys([*self.columns, self.key]))
            for batch in pq.ParquetFile(raw).iter_batches(row_groups=[partition.group], columns=wanted):
                ids = batch.column(batch.schema.get_field_index(self.key))
                inside = pc.and_(pc.greater(ids, partition.after), pc.less_equal(ids, partition.upto))
                yield batch.filter(inside).select(self.columns)

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        """(file, row group, smallest id, largest id); groups that hold no id are left out."""
        files, place = _file_system(self.path)
        for info in sorted(_data_files(files, place), key=lambda f: f.path):
            with files.open_input_file(info.path) as raw:
                parquet = pq.ParquetFile(raw)
                at = parquet.schema_arrow.get_field_index(self.key)
                for group in range(parquet.num_row_groups):
                    known = parquet.metadata.row_group(group).column(at).statistics
                    if known is not None and known.has_min_max:
                        yield info.path, group, known.min, known.max
                    elif known is None or known.null_count != parquet.metadata.row_group(group).num_rows:
                        found = pc.min_max(parquet.read_row_group(group, [self.key]).column(0))
                        if found["max"].is_valid:
                            yield info.path, group, found["min"].as_py(), found["max"].as_py()


class MarkedRows(DataSource):
    """Options ``path`` (a folder of Parquet files) and ``key`` (a whole-number column); needs a schema of top-level columns."""

    @classmethod
    def name(cls) -> str:
        return "marked_rows"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return MarkReader(self.options["path"], self.options["key"], schema.names)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _data_files(files: fs.FileSystem, place: str) -> list[fs.FileInfo]:
    found = files.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]


def marked_stream(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """The rows of an append-only table as a stream in the order of their ids' increments.

    Each batch has the rows beyond the last batch's mark, up to the largest id there is. Ids must grow: a row that appears
    later with an id at or below the mark is not read, as with any high-water mark; rows without an id never are. An
    empty or missing folder is an empty stream. The folder must be reachable from all executors.
    """
    send_by_value()
    spark.dataSource.register(MarkedRows)
    return spark.readStream.format("marked_rows").schema(schema).option("path", path).option("key", key).load()
