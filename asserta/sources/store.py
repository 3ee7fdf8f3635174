"""Where facts are kept: a log with a folder for each transaction, a compacted base by attribute, and a manifest.

A transaction is committed when the manifest names it, and the manifest is replaced by an atomic rename after the log
is written; so readers see whole transactions, and a snapshot is a manifest. Many small transactions are gathered into
segments, many segments into larger ones, so a manifest and a plan have at most FOLDERS entries for each level.
Compaction rewrites only attributes that the log touched; the others keep the base files they have. The base has each
attribute in two orders, by value and by entity, so that both kinds of look-up prune row groups, and says of each
record whether it is what is true now, so that only attributes in the log need an aggregation.

A writer holds a lease on the lock and renews it with each commit. A lease that has run out may be taken over; the
writer that lost it finds another's name in the manifest and records nothing more. An id once taken by a folder of the
log is never given again; those of transactions that failed are listed in the manifest, for who follows the log.

A store's URI is a folder of any file system that Spark knows, or ``sqlite://FILE`` or
``mysql://USER:PASSWORD@HOST:PORT/DATABASE?facts=FOLDER``: these keep manifest and lock in a table of the database,
the facts in the folder (for SQLite the file's name with ``.facts``)."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asserta.model import DATOM, FACT, FactError
from asserta.operators.facts import coalesced, current
from asserta.schema import FIRST_ID, Schema, bootstrap
from asserta.sources.workspace import child_names, delete_path, read_text, rename_path, write_text

#: Records of the log that call for a compaction.
LOG_LIMIT = 100_000
#: Records that a task of a compaction sorts: few, so its memory doesn't grow with the base, and tasks are many.
PER_TASK = 500_000
#: Folders of one level that are gathered into one.
FOLDERS = 64
#: Seconds after which a writer's lock may be taken over, unless it was renewed.
LEASE = 600.0
ORDERS = {"value": ("a", "tag", "s", "n", "ts", "e"), "entity": ("a", "e", "tag", "s", "n", "ts")}
BASE = T.StructType([*DATOM.fields, T.StructField("current", T.BooleanType())])


@dataclass
class Manifest:
    next_id: int
    max_tx: int
    log: dict[int, int] = field(default_factory=dict)  # transactions in folders of their own, and their records
    segments: list[list] = field(default_factory=list)  # level, name, records of those gathered
    touched: list[int] = field(default_factory=list)  # attributes that log and segments have records of
    base: dict[int, int] = field(default_factory=dict)  # by attribute, the compaction that wrote its files
    failed: list[int] = field(default_factory=list)  # ids with a folder of the log, but not committed
    writer: str = ""
    schema: dict = field(default_factory=dict)

    def records(self) -> int:
        return sum(self.log.values()) + sum(n for _, _, n in self.segments)

    def to_text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_text(cls, text: str) -> Manifest:
        x = json.loads(text)
        return cls(**x | {k: {int(a): b for a, b in x[k].items()} for k in ("log", "base")})


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # The manifest and the lock

    def manifest(self) -> Manifest | None:
        text = read_text(self.spark, f"{self.path}/manifest.json")
        return Manifest.from_text(text) if text else None

    def publish(self, manifest: Manifest) -> None:
        """Replaces the manifest, unless another writer has taken over."""
        self.check_writer(manifest)
        self._put(manifest)

    def check_writer(self, manifest: Manifest) -> None:
        there = self.manifest()
        if there and there.writer != manifest.writer:
            raise FactError(f"{self.path} has another writer: {there.writer}")

    def _put(self, manifest: Manifest) -> None:
        write_text(self.spark, f"{self.path}/manifest.json", manifest.to_text())

    def lock(self, owner: str) -> None:
        """One writer at a time; another one's lease that hasn't run out raises FactError."""
        path = f"{self.path}/writer.lock"
        held = read_text(self.spark, path)
        if held and _until(held) < time.time():
            rename_path(self.spark, path, f"{path}.{uuid.uuid4().hex}")
        try:
            write_text(self.spark, path, _lease(owner), replace=False)
        except FileExistsError:
            raise FactError(f"{self.path} has a writer: {held}") from None

    def renew(self, owner: str) -> None:
        write_text(self.spark, f"{self.path}/writer.lock", _lease(owner))

    def unlock(self, owner: str) -> None:
        if (read_text(self.spark, f"{self.path}/writer.lock") or "").startswith(f"{owner} "):
            delete_path(self.spark, f"{self.path}/writer.lock")

    def take_over(self, owner: str, now: dt.datetime) -> Manifest:
        """The manifest, in the name of a writer that has the lock. Folders of the log that no manifest names are
        failed transactions."""
        manifest = self.manifest()
        if manifest is None:
            return self._create(owner, now)
        there = [int(n[3:]) for n in child_names(self.spark, f"{self.path}/txlog") if n.startswith("tx=")]
        lost = {t for t in there if t > manifest.max_tx} - {*manifest.failed}
        manifest.failed = sorted({*manifest.failed, *lost})
        manifest.next_id = max([manifest.next_id, *(t + 1 for t in lost)])
        manifest.writer = owner
        self._put(manifest)
        return manifest

    def _create(self, owner: str, now: dt.datetime) -> Manifest:
        rows = bootstrap(now)
        delete_path(self.spark, f"{self.path}/txlog/tx=0")
        manifest = Manifest(FIRST_ID, 0, writer=owner, schema=Schema.start().to_json())
        self.append(0, self.spark.createDataFrame(rows, DATOM).coalesce(1), len(rows), {r[1] for r in rows}, manifest)
        return manifest

    # The log

    def staging(self, tx: int, writer: str) -> str:
        return f"{self.path}/staging/{writer.replace(':', '-')}/tx={tx}"

    def append(self, tx: int, records: DataFrame, n: int, attributes: set[int], manifest: Manifest, staged: bool = False) -> None:
        """Moves a transaction's records, and what is staged for it, to the log, and publishes the manifest with it."""
        self.check_writer(manifest)
        path = self.staging(tx, manifest.writer)
        records.drop("tx").write.mode("append" if staged else "overwrite").parquet(path)
        try:
            rename_path(self.spark, path, f"{self.path}/txlog/tx={tx}")
        except FileExistsError:
            raise FactError(f"{self.path} has another writer") from None
        manifest.log[tx] = n
        manifest.max_tx = max(manifest.max_tx, tx)
        manifest.touched = sorted({*manifest.touched, *attributes})
        try:
            self.publish(manifest)
        except Exception:
            there = self.manifest()
            if there is None or tx not in there.log:
                raise

    def gathered(self, manifest: Manifest) -> Manifest:
        """The manifest with a segment in place of transactions or segments of one level that are too many."""
        if len(manifest.log) > FOLDERS:
            level, rows, n, rest = 0, self._folders(manifest), sum(manifest.log.values()), manifest.segments
        else:
            levels = [s[0] for s in manifest.segments]
            level = next((x for x in {*levels} if levels.count(x) > FOLDERS), None)
            if level is None:
                return manifest
            own, rest = [s for s in manifest.segments if s[0] == level], [s for s in manifest.segments if s[0] != level]
            rows, n = self._segments(own), sum(s[2] for s in own)
        name = uuid.uuid4().hex
        rows.coalesce(max(1, n // LOG_LIMIT)).write.parquet(f"{self.path}/segments/{name}")
        done = Manifest.from_text(manifest.to_text())
        done.segments = [*rest, [level + 1, name, n]]
        done.log = {} if level == 0 else done.log
        self.publish(done)
        return self.gathered(done)

    def _folders(self, manifest: Manifest) -> DataFrame:
        paths = [f"{self.path}/txlog/tx={t}" for t in manifest.log]
        return self.spark.read.schema(DATOM).option("basePath", f"{self.path}/txlog").parquet(*paths).select(*DATOM.names)

    def _segments(self, segments: list[list]) -> DataFrame:
        return self.spark.read.schema(DATOM).parquet(*[f"{self.path}/segments/{name}" for _, name, _ in segments])

    def logged(self, manifest: Manifest) -> DataFrame:
        """The records that aren't compacted."""
        out = self._folders(manifest) if manifest.log else self.spark.createDataFrame([], DATOM)
        return out.unionByName(self._segments(manifest.segments)) if manifest.segments else out

    # Base and record

    def based(self, manifest: Manifest, attributes: set[int], order: str = "value") -> DataFrame | None:
        """The compacted records of attributes, in files of one of the ORDERS."""
        versions: dict[int, list[int]] = {}
        for a in attributes & manifest.base.keys():
            versions.setdefault(manifest.base[a], []).append(a)
        out = None
        for version, own in sorted(versions.items()):
            root = f"{self.path}/base/{version}/{order}"
            part = self.spark.read.schema(BASE).option("basePath", root).parquet(*[f"{root}/a={a}" for a in own]).select(*BASE.names)
            out = part if out is None else out.unionByName(part)
        return out

    def datoms(self, manifest: Manifest, attribute: int | None = None, order: str = "value") -> DataFrame:
        """The record as of a manifest. Where one attribute is asked for, only its base files are listed."""
        base = self.based(manifest, {*manifest.base} if attribute is None else {attribute}, order)
        out = self.logged(manifest)
        return out if base is None else out.unionByName(base.drop("current"))

    def now(self, manifest: Manifest, attribute: int | None, order: str) -> DataFrame:
        """Current facts as of a manifest: straight from the base, but for attributes that the log has records of."""
        wanted = {*manifest.base} if attribute is None else {attribute}
        touched = {*manifest.touched}
        still = self.based(manifest, wanted - touched, order)
        out = None if still is None else still.where("current").select(*FACT)
        if touched & wanted or attribute is None and touched:
            moved = self.logged(manifest)
            before = self.based(manifest, wanted & touched, order)
            moved = moved if before is None else moved.unionByName(before.drop("current"))
            out = current(moved) if out is None else out.unionByName(current(moved))
        return self.spark.createDataFrame([], DATOM).select(*FACT) if out is None else out

    def merged(self, manifest: Manifest, columns: tuple[str, ...], tasks: int) -> DataFrame:
        """Base and log of what the log touched, without repeated operations, in ranges of the columns and sorted by them.
        What one value or one entity has very much of is dealt out by the other columns. One exchange and one sort serve
        both the order and what is done to each fact's operations; the last sort is for the writer, which looks for one
        at the top, and Spark leaves it out."""
        before = self.based(manifest, {*manifest.touched})
        rows = self.logged(manifest)
        rows = rows if before is None else rows.unionByName(before.drop("current"))
        rows = rows.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns, "tx", "retracted")
        return coalesced(rows, columns).sortWithinPartitions(*columns)

    def compact(self, manifest: Manifest) -> Manifest:
        """Moves log and segments into the base, without repeated operations, and publishes the result."""
        if not manifest.log and not manifest.segments:
            return manifest
        version = max([0, *manifest.base.values()]) + 1
        before = self.based(manifest, {*manifest.touched})
        tasks = 1 + (manifest.records() + (before.count() if before else 0)) // PER_TASK
        rows = self.merged(manifest, ORDERS["value"], tasks)
        root, columns = f"{self.path}/base/{version}", ORDERS["entity"]
        rows.write.mode("overwrite").partitionBy("a").parquet(f"{root}/value")
        rows = self.spark.read.schema(BASE).parquet(f"{root}/value")
        rows.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns).write.mode("overwrite").partitionBy("a").parquet(f"{root}/entity")
        done = Manifest.from_text(manifest.to_text())
        done.base |= dict.fromkeys(manifest.touched, version)
        done.log, done.segments, done.touched = {}, [], []
        self.publish(done)
        return done


def _lease(owner: str) -> str:
    return f"{owner} until {time.time() + LEASE:.3f}"


def _until(lock: str) -> float:
    return float(lock.rpartition(" ")[2])


class SqlStore(Store):
    """Manifest and lock in a table (name, value) of a database reached by Python's DB-API; facts in a folder."""

    def __init__(self, spark: SparkSession, path: str, connect: Callable[[], object], mark: str):
        super().__init__(spark, path)
        self.connect, self.mark = connect, mark
        self._do("CREATE TABLE IF NOT EXISTS asserta (name VARCHAR(32) PRIMARY KEY, value LONGTEXT)" if mark == "%s" else "CREATE TABLE IF NOT EXISTS asserta (name TEXT PRIMARY KEY, value TEXT)")

    def _do(self, sql: str, *values: str) -> tuple[list[tuple], int]:
        """One statement in a transaction of its own: its rows, and how many it changed."""
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(sql.replace("?", self.mark), values)
            rows = cursor.fetchall() if cursor.description else []
            connection.commit()
            return rows, cursor.rowcount
        finally:
            connection.close()

    def _get(self, name: str) -> str | None:
        rows, _ = self._do("SELECT value FROM asserta WHERE name = ?", name)
        return rows[0][0] if rows else None

    def manifest(self) -> Manifest | None:
        text = self._get("manifest")
        return Manifest.from_text(text) if text else None

    def publish(self, manifest: Manifest) -> None:
        """Compare and swap: the manifest that is replaced has to be this writer's."""
        text = self._get("manifest")
        if text is None:
            return self._put(manifest)
        if Manifest.from_text(text).writer != manifest.writer or self._do("UPDATE asserta SET value = ? WHERE name = 'manifest' AND value = ?", manifest.to_text(), text)[1] != 1:
            raise FactError(f"{self.path} has another writer")

    def _put(self, manifest: Manifest) -> None:
        self._do("REPLACE INTO asserta VALUES ('manifest', ?)", manifest.to_text())

    def lock(self, owner: str) -> None:
        held = self._get("lock")
        if held and _until(held) < time.time():
            self._do("DELETE FROM asserta WHERE name = 'lock' AND value = ?", held)
        insert = "INSERT OR IGNORE INTO" if self.mark == "?" else "INSERT IGNORE INTO"
        if self._do(f"{insert} asserta VALUES ('lock', ?)", _lease(owner))[1] != 1:
            raise FactError(f"{self.path} has a writer: {held}")

    def renew(self, owner: str) -> None:
        self._do("UPDATE asserta SET value = ? WHERE name = 'lock'", _lease(owner))

    def unlock(self, owner: str) -> None:
        held = self._get("lock") or ""
        if held.startswith(f"{owner} "):
            self._do("DELETE FROM asserta WHERE name = 'lock' AND value = ?", held)


def _sqlite(spark: SparkSession, uri: str) -> Store:
    path = uri.split("://", 1)[1]
    return SqlStore(spark, f"{path}.facts", lambda: sqlite3.connect(path, timeout=30), "?")


def _mysql(spark: SparkSession, uri: str) -> Store:
    u = urlparse(uri)
    folder = parse_qs(u.query).get("facts")
    if not folder:
        raise FactError("a MySQL store needs ?facts=FOLDER, where its facts are kept")
    try:
        import pymysql
    except ImportError:
        raise FactError("a MySQL store needs the package pymysql") from None
    return SqlStore(spark, folder[0], lambda: pymysql.connect(host=u.hostname, port=u.port or 3306, user=unquote(u.username or ""), password=unquote(u.password or ""), database=u.path.strip("/")), "%s")


def _jdbc(spark: SparkSession, uri: str) -> Store:
    raise FactError(f"{uri}: tables of other databases are read by spark.read.jdbc, and written to a store by Connection.transact_frame")


SCHEMES: dict[str, Callable[[SparkSession, str], Store]] = {"mysql": _mysql, "sqlite": _sqlite, "jdbc": _jdbc}


def open_store(spark: SparkSession, uri: str) -> Store:
    """The store that a URI names."""
    scheme = uri.split(":", 1)[0] if ":" in uri else ""
    return SCHEMES.get(scheme, Store)(spark, uri)
