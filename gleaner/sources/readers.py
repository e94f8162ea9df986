"""Readers: saved pages, SQLite stores, JSON lines, query batches and seeds."""

from __future__ import annotations

import csv
import re
import sqlite3
import tomllib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCAN = "url id path host title language relevance token_count status_code content_type fetched_at crawl_depth".split()


def scan(table: DataFrame, columns: list[str] = SCAN, where=None) -> DataFrame:
    """Columns of a page table, NULL for those it lacks."""
    out = table if where is None else table.where(where)
    return out.select(*(F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in columns))


def saved_pages(table: DataFrame) -> DataFrame:
    """HTML pages (or of unknown type) to index, by id."""
    return scan(table, where=F.col("content_type").isNull() | F.col("content_type").ilike("text/html%")).orderBy("id")


def page_by_path(table: DataFrame, path: str) -> DataFrame:
    return scan(table, where=F.col("path") == path).limit(1)


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of the .html files under a folder, whatever the case of the suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").endswith(".html")).select("path", F.decode("content", "UTF-8").alias("html"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a .jsonl file; blank lines are skipped."""
    if not path.rstrip("/").endswith(".jsonl"):
        raise ValueError("not a .jsonl file")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def query_batch(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of a tab-separated batch: blank rows skipped, two fields each, the last of an id wins."""
    found: dict[int, str] = {}
    with open(path, newline="", encoding="utf-8") as f:
        for n, row in enumerate(csv.reader(f, delimiter="\t"), 1):
            if not any(c.strip() for c in row):
                continue
            fields = [c.strip() for c in row]
            if not (len(fields) == 2 and re.fullmatch(r"[+-]?\d+", fields[0])):
                raise ValueError(f"line {n}: a whole number and a query are needed, two fields")
            found[int(fields[0])] = fields[1]
    return spark.createDataFrame(sorted(found.items()), "query_id long, query string")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Crawl seeds of a TOML file with [[sites]] tables; none where the file can't be used."""
    kind = "url string, max_pages_per_seed int, request_timeout double, retry_delay double, request_delay double, retries int, round_robin_weight int"
    try:
        with open(path, "rb") as f:
            sites = tomllib.load(f)["sites"]
        rows = []
        for s in sites:
            u = urlsplit(s["url"])
            row = (s["url"], int(s.get("max_pages_per_seed", -1)), float(s.get("request_timeout", 10)), float(s.get("retry_delay", 1)), float(s.get("request_delay", 1)), int(s.get("retries", 3)), int(s.get("round_robin_weight", 1)))
            if u.scheme not in ("http", "https") or not u.hostname or row[5] < 1 or row[6] < 1:
                raise ValueError(s["url"])
            rows.append(row)
    except (OSError, KeyError, TypeError, ValueError):
        rows = []
    return spark.createDataFrame(rows, kind)


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))
        self.columns = [f.name for f in schema.fields]

    def _connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        con = self._connect()
        low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        con.close()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part):
        con = self._connect()
        names = ", ".join(f'"{c}"' for c in self.columns)
        yield from con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (part.low, part.high))
        con.close()


class SqliteSource(DataSource):
    """``spark.read.format("gleaner_sqlite").option("table", t).load(path)``: a table by ranges of rowid."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_sqlite"

    def schema(self) -> str:
        con = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        info = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        con.close()
        if not info:
            raise ValueError(f"no table {self.options['table']}")
        kinds = {"INTEGER": "long", "REAL": "double", "BLOB": "binary"}
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in info)

    def reader(self, schema):
        return _SqliteReader(self.options, schema)


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("gleaner_sqlite").option("table", table).option("partitions", partitions).load(path)


def check_columns(table: DataFrame, needed: list[str]) -> None:
    missing = [c for c in needed if c not in table.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
