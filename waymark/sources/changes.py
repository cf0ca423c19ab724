"""A table of a database as a Spark data source: read whole in planned parts, or as a stream of the rows past an offset.

Executors open their own connections, by any DB-API module that they have; nothing passes through the driver but keys.

    spark.dataSource.register(Changes)
    rows = spark.read.format("waymark_changes").schema(...).options(module="psycopg", database=url, sql=select, key="id").load()
    new = spark.readStream.format("waymark_changes")...  # the same options

Options: module, database (the argument of the module's connect), sql (a SELECT), key (an integer column of it, unique, that
rises with each change), rows (of a part), limit (the first rows by key; not for streams).

Parts end where a walk along the key says, so each has `rows` rows however keys are spread. Comparisons with whole numbers,
equality with strings and null tests go into the parts' statements as well; Spark tests them again, since a database may
compare otherwise. A stream's offset is the greatest key that was there; a restart reads past the last one committed.

Defined cases: rows whose key is null are not read; a row that appears later with a key at or under the offset is not read
by a stream; an empty table gives no rows and leaves the offset where it was; a column that the SELECT lacks is an error.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from contextlib import closing

from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

ROWS = 100_000
#: Below any key.
LEAST = -(1 << 63)
_SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Keys(ds.InputPartition):
    """The rows with low < key <= high."""

    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


#: Spark wants a part even of a table without rows.
NOTHING = Keys(LEAST, LEAST)


class Table:
    """The options of one source, and its statements."""

    def __init__(self, options: dict[str, str], schema: StructType):
        missing = [o for o in ("module", "database", "sql", "key") if not options.get(o)]
        if missing:
            raise ValueError(f"options are missing: {', '.join(missing)}")
        self.module, self.database, self.sql = options["module"], options["database"], options["sql"]
        self.key, self.columns = _quoted(options["key"]), [_quoted(f.name) for f in schema.fields]
        self.rows = int(options.get("rows", ROWS))
        self.limit = int(options["limit"]) if "limit" in options else None
        if self.rows < 1 or (self.limit is not None and self.limit < 0):
            raise ValueError("rows is 1 at least, limit 0 at least")
        self.where: list[str] = []
        self.values: list = []

    def run(self, select: str, where: list[str], values: list, tail: str = "") -> Iterator[tuple]:
        module = importlib.import_module(self.module)
        mark = {"qmark": "?", "format": "%s", "pyformat": "%s"}[module.paramstyle]
        text = f"SELECT {select} FROM ({self.sql}) q WHERE {' AND '.join([*where, *self.where])} {tail}"
        with closing(module.connect(self.database)) as connection, closing(connection.cursor()) as cursor:
            cursor.execute(text.replace("\0", mark), [*values, *self.values])
            while rows := cursor.fetchmany(2_000):
                yield from rows

    def end(self, low: int, high: int | None, nth: int) -> int | None:
        """The nth key past `low`, up to `high`."""
        where, values = [f"{self.key} > \0"], [low]
        if high is not None:
            where, values = [*where, f"{self.key} <= \0"], [*values, high]
        # Filters come after these, so their values do.
        return next((k for (k,) in self.run(self.key, where, values, f"ORDER BY {self.key} LIMIT 1 OFFSET {nth - 1}")), None)

    def greatest(self, low: int) -> int:
        found = next(iter(self.run(f"MAX({self.key})", [f"{self.key} > \0"], [low])))[0]
        return low if found is None else int(found)

    def parts(self, low: int, high: int) -> list[Keys]:
        out = []
        while low < high:
            end = self.end(low, high, self.rows)
            out.append(Keys(low, high if end is None else int(end)))
            low = out[-1].high
        return out or [NOTHING]

    def read(self, part: Keys) -> Iterator[tuple]:
        yield from self.run(", ".join(self.columns), [f"{self.key} > \0", f"{self.key} <= \0"], [part.low, part.high])


class _Batch(ds.DataSourceReader):
    def __init__(self, table: Table):
        self.table = table

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        for f in filters:
            # With a limit it is the first rows of all, not of those that a filter leaves.
            column = _quoted(f.attribute[0]) if self.table.limit is None and len(getattr(f, "attribute", ())) == 1 else None
            if column and type(f) in _SIGNS and (whole(f.value) or (isinstance(f, ds.EqualTo) and isinstance(f.value, str))):
                self.table.where.append(f"{column} {_SIGNS[type(f)]} \0")
                self.table.values.append(f.value)
            elif column and isinstance(f, (ds.IsNull, ds.IsNotNull)):
                self.table.where.append(f"{column} IS {'NOT ' if isinstance(f, ds.IsNotNull) else ''}NULL")
            yield f

    def partitions(self) -> list[Keys]:
        if self.table.limit == 0:
            return [NOTHING]
        high = self.table.end(LEAST, None, self.table.limit) if self.table.limit is not None else None
        return self.table.parts(LEAST, self.table.greatest(LEAST) if high is None else int(high))

    def read(self, partition: Keys) -> Iterator[tuple]:
        return self.table.read(partition)


class _Stream(ds.DataSourceStreamReader):
    def __init__(self, table: Table):
        self.table, self.last = table, LEAST

    def initialOffset(self) -> dict:
        return {"key": LEAST}

    def latestOffset(self) -> dict:
        self.last = self.table.greatest(self.last)
        return {"key": self.last}

    def partitions(self, start: dict, end: dict) -> list[Keys]:
        return self.table.parts(start["key"], end["key"])

    def read(self, partition: Keys) -> Iterator[tuple]:
        return self.table.read(partition)

    def commit(self, end: dict) -> None:
        self.last = max(self.last, end["key"])


class Changes(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "waymark_changes"

    def schema(self) -> str:
        raise ValueError("give the schema of the rows with .schema(...)")

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return _Batch(Table(self.options, schema))

    def streamReader(self, schema: StructType) -> ds.DataSourceStreamReader:
        if "limit" in self.options:
            raise ValueError("a stream has no limit")
        return _Stream(Table(self.options, schema))
