"""Outside catalogs as a Spark data source.

`spark.read.format("outside_catalog").option("path", ..).load()` gives one row for each asset of an exported library, in
one schema for all providers. The export is a folder of Parquet files that all executors reach; each row group is a
partition, and as a stream the folder's files are read in order of their names. The options since and until (moments in
UTC) go down to the files, whose statistics rule out row groups. They are options, as Spark 4.1 keeps the filters that a
Python source has accepted with the DataFrame and applies them to its other uses, too.

An export has the columns of LIBRARY, any of which may be missing. A row without a file and without an id can't be
referred to and is left out; one with an id but without a file stays, as a reference: it lends its date and place, and
no file of it is ever opened. Moments carry the zone of each photo: the wall clock is the moment shifted by it, and
without a zone the moment in UTC is unknown. Half a coordinate, or 0/0, is no place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "outside_catalog"
ASSETS = """external_id string, path string, original_path string, name string, bytes long, taken_at timestamp_ntz, taken_at_utc timestamp_ntz, gps_lat double, gps_lon double,
  title string, description string, favourite boolean, albums array<string>, people array<string>, keywords array<string>, is_reference boolean"""
_MOMENT, _TEXTS = pa.timestamp("us"), pa.list_(pa.string())
#: The columns of an export, and their kinds.
LIBRARY = {
    "external_id": pa.string(), "path": pa.string(), "original_path": pa.string(), "name": pa.string(), "bytes": pa.int64(), "moment": _MOMENT, "zone_seconds": pa.int32(),
    "gps_lat": pa.float64(), "gps_lon": pa.float64(), "title": pa.string(), "description": pa.string(), "favourite": pa.bool_(), "albums": _TEXTS, "people": _TEXTS, "keywords": _TEXTS,
}


def files_of(path: str) -> ds.FileSystemDataset:
    return ds.dataset(path.removeprefix("file://") if path.startswith("file:///") else path, format="parquet")


def assets(rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
    """Rows of an export as assets."""
    have = set(rows.schema.names)
    col = {n: pc.cast(rows.column(n), t, safe=False) if n in have else pa.nulls(rows.num_rows, t) for n, t in LIBRARY.items()}
    col = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in col.items()}
    zone = col["zone_seconds"]
    wall = pc.add(col["moment"], pc.cast(pc.multiply(pc.fill_null(pc.cast(zone, pa.int64()), 0), 1_000_000), pa.duration("us")))
    placed = pc.and_(pc.and_(pc.is_valid(col["gps_lat"]), pc.is_valid(col["gps_lon"])), pc.invert(pc.and_(pc.equal(col["gps_lat"], 0), pc.equal(col["gps_lon"], 0))))
    placed = pc.fill_null(placed, False)
    own = pa.array(range(rows.num_rows), pa.int64())
    # a null index takes null; if_else() reads past the end of strings that don't begin at an array's start, as in all batches of a row group but the first
    written = {n: pc.take(col[n], pc.if_else(pc.equal(pc.utf8_trim_whitespace(col[n]), ""), pa.scalar(None, pa.int64()), own)) for n in ("path", "title", "description", "external_id")}
    lists = {n: pa.array([list(dict.fromkeys(x)) if x else [] for x in col[n].to_pylist()], _TEXTS) for n in ("albums", "people", "keywords")}
    out = {
        **col, **written, **lists, "taken_at": wall, "taken_at_utc": pc.if_else(pc.is_valid(zone), col["moment"], pa.scalar(None, _MOMENT)),
        "gps_lat": pc.if_else(placed, col["gps_lat"], None), "gps_lon": pc.if_else(placed, col["gps_lon"], None), "favourite": pc.fill_null(col["favourite"], False), "is_reference": pc.is_null(written["path"]),
    }
    names = [x.split()[0] for x in ASSETS.replace("\n", " ").split(",")]
    batch = pa.RecordBatch.from_arrays([out[n] for n in names], names)
    return batch.filter(pc.or_(pc.is_valid(out["path"]), pc.is_valid(out["external_id"])))


class Rows(InputPartition):
    """Row groups of one file."""

    def __init__(self, file: str, groups: tuple[int, ...]):
        self.file, self.groups = file, groups


def _between(options: dict[str, str]) -> ds.Expression | None:
    """moment from since on and before until."""
    limits = [(n, pa.scalar(datetime.fromisoformat(options[n]), _MOMENT)) for n in ("since", "until") if options.get(n)]
    each = [ds.field("moment") >= v if n == "since" else ds.field("moment") < v for n, v in limits]
    return reduce(lambda a, b: a & b, each) if each else None


def _read(options: dict[str, str], part: Rows) -> Iterator[pa.RecordBatch]:
    own, condition = files_of(options["path"]), _between(options)
    fragment = own.format.make_fragment(part.file, own.filesystem, row_groups=part.groups)
    names = [n for n in LIBRARY if n in fragment.physical_schema.names]
    for batch in fragment.to_batches(columns=names, filter=condition):
        if batch.num_rows:
            yield assets(batch)


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        own = files_of(self.options["path"])
        groups = [Rows(f.path, tuple(g.id for g in one.row_groups)) for f in own.get_fragments() for one in f.split_by_row_group(_between(self.options), schema=own.schema)]
        return groups or [Rows("", ())]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition) if partition.file else iter(())


class CatalogStream(DataSourceStreamReader):
    """The export's files in order of their names; a file never changes once it is there."""

    def __init__(self, options: dict[str, str]):
        self.options, self.path = options, options["path"]

    def _files(self) -> list[str]:
        return sorted(f.path for f in files_of(self.path).get_fragments())

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self._files(), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Rows(f.path, tuple(range(f.num_row_groups))) for f in files_of(self.path).get_fragments() if start["after"] < f.path <= end["after"]]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)


class OutsideCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ASSETS

    def reader(self, schema) -> DataSourceReader:
        return CatalogReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CatalogStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OutsideCatalog)


def catalog(spark: SparkSession, path: str, since: str = "", until: str = "") -> DataFrame:
    """The assets of the export at path."""
    register(spark)
    return spark.read.format(FORMAT).options(path=path, since=since, until=until).load()
