"""Collections: immutable segments of rows, numbered commits that list them, and a registry of open collections.

A write adds a segment of its own rows (with their text index) and a table of tombstones: for each key that it touches,
the number below which rows of that key are dead.  So a write costs what its batch costs, rows and operations may
arrive in any order, and the last one by number counts.  A commit is one small file that names all segments, the
schema and the next row number; it appears whole, and only if no other writer took its number first.  A writer that lost the race
takes the next number on top of the other's commit, so no write is lost and none waits for a lock.

Readers pin a commit and see nothing else.  ``compact`` merges segments and leaves dead rows out.  Files are reached
through Spark's own file system layer, so a collection can lie in any store that Spark writes to.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.operators.filters import combine
from facetry.plans import search
from facetry.request import SearchRequest
from facetry.schema import SearchSchema
from facetry.sources import ingest, postings

NAME = re.compile(r"^[a-zA-Z0-9_-]{1,64}$")
READ, WRITE, READ_WRITE = "READ", "WRITE", "READ_WRITE"
WAIT_FOR, NONE, IMMEDIATE = 0, 1, 2


class Files:
    """Small text files and folders in Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self._fs.exists(self._path(p))

    def make(self, p: str) -> None:
        self._fs.mkdirs(self._path(p))

    def create_new(self, p: str, text: str) -> bool:
        """Writes a file that appears whole; False if there is one of this name already."""
        beside = f"{p}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(beside), True)
        out.write(text.encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # where renaming would replace a file
                try:
                    os.link(self._path(beside).toUri().getPath(), self._path(p).toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not self.exists(p) and self._fs.rename(self._path(beside), self._path(p))
        finally:
            self._fs.delete(self._path(beside), False)

    def read(self, p: str) -> str:
        stream = self._fs.open(self._path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, p: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(p)))

    def delete(self, p: str) -> None:
        self._fs.delete(self._path(p), True)

    def age_ms(self, p: str, now_ms: int) -> int:
        return now_ms - self._fs.getFileStatus(self._path(p)).getModificationTime()

    def size(self, p: str) -> int:
        return self._fs.getContentSummary(self._path(p)).getLength()


class Conflict(RuntimeError):
    """Another writer's commit came first, and this change does not fit on top of it."""


@dataclass(frozen=True)
class Commit:
    """What a version of a collection consists of."""

    n: int
    next_seq: int
    schema: str
    segments: tuple[str, ...] = ()
    tombstones: tuple[str, ...] = ()
    clean: bool = True  # no row of the segments is dead
    epochs: dict[str, int] = field(default_factory=dict)  # the last batch of each stream

    @classmethod
    def from_json(cls, text: str) -> Commit:
        raw = json.loads(text)
        return cls(**{**raw, "segments": tuple(raw["segments"]), "tombstones": tuple(raw["tombstones"])})


#: Segments above which a write is followed by a compaction.
MAX_SEGMENTS = 64
FILE_BYTES = 128 << 20
#: Rows that a merge sorts in one task, at most about.
FILE_ROWS = 250_000
MAX_TRIES = 1000


class Collection:
    def __init__(self, spark: SparkSession, root: str, schema: SearchSchema | None, mode: str = READ_WRITE):
        self.spark, self.root, self.mode = spark, root, mode
        self.files = Files(spark, root)
        self._given = schema
        self._index: tuple[int, postings.TextIndex] | None = None
        self.refresh()

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: SearchSchema, mode: str = READ_WRITE) -> Collection:
        files = Files(spark, root)
        files.make(f"{root}/_commits")
        if not files.create_new(cls._commit_path(root, 0), json.dumps(asdict(Commit(0, 0, schema.to_json())))):
            raise ValueError(f"There is a collection in {root} already")
        return cls(spark, root, None, mode)

    @classmethod
    def open(cls, spark: SparkSession, root: str, schema: SearchSchema | None = None, mode: str = READ_WRITE) -> Collection:
        return cls(spark, root, schema, mode)

    @staticmethod
    def exists(spark: SparkSession, root: str) -> bool:
        return Files(spark, root).exists(f"{root}/_commits")

    @staticmethod
    def struct(schema: SearchSchema) -> T.StructType:
        return T.StructType(schema.struct().fields + [T.StructField("_src", T.StringType()), T.StructField("_doc", T.LongType())])

    # ---- commits ----

    @staticmethod
    def _commit_path(root: str, n: int) -> str:
        return f"{root}/_commits/{n:012d}.json"

    def _commits(self) -> list[int]:
        return [int(x[:12]) for x in self.files.names(f"{self.root}/_commits") if re.fullmatch(r"\d{12}\.json", x)]

    def latest(self) -> Commit:
        return Commit.from_json(self.files.read(self._commit_path(self.root, max(self._commits()))))

    def current(self) -> tuple[int, int]:
        """The number of the last commit, and the next row number."""
        last = self.latest()
        return last.n, last.next_seq

    def refresh(self) -> None:
        """Pins the last commit."""
        self.commit = self.latest()
        self.schema = self._given or SearchSchema.from_json(self.commit.schema)
        self.df = self._rows(self.commit, self.schema)

    def _rows(self, commit: Commit, schema: SearchSchema) -> DataFrame:
        """The live rows of a commit."""
        if not commit.segments:
            return self.spark.createDataFrame([], self.struct(schema))
        rows = self.spark.read.schema(self.struct(schema)).parquet(*[f"{self.root}/{s}/rows" for s in commit.segments])
        if commit.clean or not commit.tombstones:
            return rows
        dead = self._dead(commit)
        return rows.join(dead, (rows[schema.key] == dead["__key"]) & (rows["_doc"] < dead["__below"]), "left_anti")

    def _dead(self, commit: Commit) -> DataFrame:
        table = self.spark.read.schema("__key string, __below long").parquet(*[f"{self.root}/{t}" for t in commit.tombstones])
        return table.groupBy("__key").agg(F.max("__below").alias("__below"))

    def _publish(self, change, refresh: int = WAIT_FOR) -> Commit:
        """Commits ``change`` of the last commit; where another writer is first, of theirs."""
        for _ in range(MAX_TRIES):
            last = self.latest()
            new = replace(change(last), n=last.n + 1)
            if self.files.create_new(self._commit_path(self.root, new.n), json.dumps(asdict(new))):
                break
        else:
            raise Conflict(f"{MAX_TRIES} commits of others came first")
        if refresh != NONE:
            self.refresh()
        return new

    def _may_write(self) -> None:
        if self.mode == READ:
            raise RuntimeError("The collection is open for reading only")

    def vacuum(self, keep: int = 2, retain_ms: int = 3_600_000, now_ms: int | None = None) -> list[str]:
        """Removes commits that are older than the last ``keep``, not pinned here, and older than ``retain_ms`` (which gives
        readers elsewhere that time), and the files that no remaining commit names."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        numbers = self._commits()
        old = [n for n in numbers[:-keep] if n != self.commit.n and self.files.age_ms(self._commit_path(self.root, n), now_ms) >= retain_ms]
        left = [Commit.from_json(self.files.read(self._commit_path(self.root, n))) for n in numbers if n not in old]
        used = {x for c in left for x in c.segments + c.tombstones}
        gone = [x for x in self.files.names(self.root) if re.fullmatch(r"[st]-[0-9a-f]{32}", x) and x not in used and self.files.age_ms(f"{self.root}/{x}", now_ms) >= retain_ms]
        for n in old:
            self.files.delete(self._commit_path(self.root, n))
        for x in gone:
            self.files.delete(f"{self.root}/{x}")
        return gone

    # ---- writing ----

    def _write_segment(self, rows: DataFrame, schema: SearchSchema) -> str:
        name = f"s-{uuid.uuid4().hex}"
        rows.select(*self.struct(schema).names).write.parquet(f"{self.root}/{name}/rows")
        if schema.searchable_text():
            written = self.spark.read.schema(self.struct(schema)).parquet(f"{self.root}/{name}/rows")
            postings.write(written, schema, f"{self.root}/{name}/index")
        return name

    def _write_tombstones(self, keys: DataFrame) -> str:
        name = f"t-{uuid.uuid4().hex}"
        keys.toDF("__key", "__below").write.parquet(f"{self.root}/{name}")
        return name

    def index(self, items: list[dict], now_ms: int, refresh: int = WAIT_FOR) -> list[str | None]:
        """Applies a request's items in order; returns for each item None or why it was rejected.

        Items are dicts with ``document`` and optionally ``action, tenant, tier, ttl_seconds``.
        """
        while True:
            seq = self.current()[1]
            rows = [
                (seq + i, x.get("action", ingest.UPDATE), x["document"], x.get("tenant"), x.get("tier"), x.get("ttl_seconds"), now_ms)
                for i, x in enumerate(items)
            ]
            try:
                return self.apply(self.spark.createDataFrame(rows, ingest.OPERATION), seq + len(rows), refresh, first_seq=seq)
            except Conflict:  # another writer took these numbers
                continue

    def apply(self, ops: DataFrame, next_seq: int, refresh: int = WAIT_FOR, report: bool = True, first_seq: int | None = None, epoch: tuple[str, int] | None = None) -> list[str | None]:
        """Applies operations with numbers of their own, in any order; the last one of each key by number counts.

        ``first_seq`` says that the numbers were taken from the last commit: if that is not so any more, Conflict is raised.  ``epoch`` names
        a stream and its batch; a batch that is committed already changes nothing.
        """
        self._may_write()
        schema = self.schema
        # The last operations are found by a sort of each partition before the shuffle: dealt, since one file may be one task's.
        parsed = ingest.parse(ops.repartition("seq"), schema)
        if report and (bad := ingest.whole_request_error(parsed).select("error").first()):
            raise ValueError(bad["error"])
        base = self.latest()
        if epoch and base.epochs.get(epoch[0], -1) >= epoch[1]:
            return []
        last = ingest.latest(parsed, schema).persist()
        try:
            rows = ingest.stamped(last.filter(F.col("action") == ingest.UPDATE), schema)
            if first_seq is None and base.segments:  # numbers below the next one may be a replay of rows that are here
                least = last.agg(F.min("seq")).first()[0]
                if least is not None and least < base.next_seq:
                    here = self._rows(base, schema).select(F.col(schema.key).alias("__key"), F.col("_doc").alias("__doc"))
                    rows = rows.join(here, (rows[schema.key] == here["__key"]) & (rows["_doc"] == here["__doc"]), "left_anti")
            segment, dead = self._write_segment(rows, schema), self._write_tombstones(last.select(schema.key, "seq"))
        finally:
            last.unpersist()

        def change(c: Commit) -> Commit:
            if c.schema != base.schema or (first_seq is not None and c.next_seq != first_seq):
                raise Conflict("numbers or schema changed")
            seen = c.epochs | {epoch[0]: epoch[1]} if epoch else c.epochs
            return replace(c, next_seq=max(c.next_seq, next_seq), segments=(*c.segments, segment), tombstones=(*c.tombstones, dead), clean=not c.segments, epochs=seen)

        try:
            done = self._publish(change, refresh)
        except Conflict:
            self.files.delete(f"{self.root}/{segment}")
            self.files.delete(f"{self.root}/{dead}")
            raise
        if len(done.segments) > MAX_SEGMENTS:
            try:
                self.compact(refresh=refresh)
            except Conflict:  # another writer merges them
                pass
        return [r["error"] for r in parsed.select("seq", "error").orderBy("seq").collect()] if report else []

    def load(self, rows: DataFrame, next_seq: int, refresh: int = WAIT_FOR) -> None:
        """Adds typed rows with one row for each key, as of their ``_doc``."""
        self._may_write()
        segment = self._write_segment(rows, self.schema)
        written = self.spark.read.schema(self.struct(self.schema)).parquet(f"{self.root}/{segment}/rows")
        dead = self._write_tombstones(written.select(self.schema.key, "_doc"))
        self._publish(lambda c: replace(c, next_seq=max(c.next_seq, next_seq), segments=(*c.segments, segment), tombstones=(*c.tombstones, dead), clean=not c.segments), refresh)

    def _kill(self, rows: DataFrame) -> int:
        """Deletes these versions of rows, not later ones of their keys; how many."""
        dead = self._write_tombstones(rows.select(self.schema.key, F.col("_doc") + 1))
        n = self.spark.read.parquet(f"{self.root}/{dead}").count()
        if n:
            self._publish(lambda c: replace(c, tombstones=(*c.tombstones, dead), clean=False))
        else:
            self.files.delete(f"{self.root}/{dead}")
        return n

    def delete_by_query(self, filters, tenant: str = "") -> int:
        """Deletes what the filters match; how many rows that were."""
        self._may_write()
        if not filters:
            raise ValueError("At least one filter is needed")
        return self._kill(self._rows(self.latest(), self.schema).filter(combine(self.schema, filters, tenant)))

    def sweep(self, now_ms: int) -> int:
        """Deletes what has expired; how many rows that were."""
        self._may_write()
        return self._kill(ingest.expired(self._rows(self.latest(), self.schema), now_ms)) if self.schema.ttl_enabled else 0

    def compact(self, files: int | None = None, refresh: int = WAIT_FOR) -> tuple[int, int]:
        """Merges all segments into one without dead rows, in so many files or by size and rows; how many segments there were and are.

        Tombstones are merged too and stay, so that an operation that comes late still loses to a later one.
        """
        self._may_write()
        base = self.latest()
        if not base.segments:
            return 0, 0
        size = sum(self.files.size(f"{self.root}/{s}/rows") for s in base.segments)
        live = self._rows(base, self.schema)
        rows = live.repartitionByRange(files or max(1, size // FILE_BYTES, -(-live.count() // FILE_ROWS)), "_doc").sortWithinPartitions("_doc")
        segment, dead = self._write_segment(rows, self.schema), self._write_tombstones(self._dead(base))

        def change(c: Commit) -> Commit:
            if not set(base.segments) <= set(c.segments) or c.schema != base.schema:
                raise Conflict("another writer has merged these segments")
            more = [s for s in c.segments if s not in base.segments], [t for t in c.tombstones if t not in base.tombstones]
            return replace(c, segments=(segment, *more[0]), tombstones=(dead, *more[1]), clean=not any(more))

        done = self._publish(change, refresh)
        return len(base.segments), len(done.segments)

    def update_schema(self, schema: SearchSchema) -> None:
        """Swaps the schema and projects the documents anew from their JSON, in one commit."""
        self._may_write()
        while True:
            base = self.latest()
            old_schema = SearchSchema.from_json(base.schema)
            old = self._rows(base, old_schema)
            system = [n for n, _ in _system(old_schema)]
            ops = old.select(F.col("_doc").alias("seq"), F.lit(ingest.UPDATE).alias("action"), F.col("_src").alias("document"), *system)
            typed = ingest.parse(ops, schema)
            missing = [F.lit(None).cast(t).alias(n) for n, t in _system(schema) if n not in system]
            rows = typed.select(*[f.name for f in schema.fields], *[n for n, _ in _system(schema) if n in system], *missing, "_src", F.col("seq").alias("_doc"))
            segments = (self._write_segment(rows, schema),) if base.segments else ()

            def change(c: Commit, base=base, segments=segments) -> Commit:
                if c.n != base.n:
                    raise Conflict("the collection has changed")
                return replace(c, schema=schema.to_json(), segments=segments, clean=True)

            try:
                self._given = None
                self._publish(change)
                return
            except Conflict:
                continue

    # ---- reading ----

    def text_index(self) -> postings.TextIndex | None:
        """The index of the pinned commit; rows that a later write replaced count in its statistics until ``compact``."""
        if not self.schema.searchable_text() or not self.commit.segments:
            return None
        if self._index is None or self._index[0] != self.commit.n:
            paths = [f"{self.root}/{s}/index" for s in self.commit.segments]
            self._index = self.commit.n, postings.TextIndex.open(self.spark, paths, live=self.commit.clean)
        return self._index[1]

    def search(self, request: SearchRequest) -> search.SearchResult:
        if self.mode == WRITE:
            raise RuntimeError("The collection is open for writing only")
        return search.run(self.df, self.schema, request, index=self.text_index() if request.has_text() else None)

    def count(self, filters=(), tenant: str = "") -> int:
        return search.count(self.df, self.schema, filters, tenant).first()["count"]

    def lookup(self, keys) -> list[str]:
        return [r["_src"] for r in search.lookup(self.df, self.schema, keys).select("_src").collect()] if keys else []

    def health(self) -> dict:
        return {"writer_open": self.mode != READ, "searcher_available": self.mode != WRITE, "doc_count": self.df.count(), "segment_count": len(self.commit.segments)}


def _system(schema: SearchSchema):
    from facetry.schema import SYSTEM

    return SYSTEM if schema.ttl_enabled else ()


class Registry:
    """Open collections by name, below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._open = spark, root, {}

    @staticmethod
    def name(name: str) -> str:
        name = name or "default"
        if not NAME.match(name):
            raise ValueError(f"Invalid collection name: {name!r}")
        return name

    def create(self, name: str, schema_json: str, mode: str = READ_WRITE) -> Collection:
        if not name:
            raise ValueError("A collection needs a name")
        name = self.name(name)
        path = f"{self.root}/{name}"
        if name in self._open or Collection.exists(self.spark, path):
            raise ValueError(f"Collection {name} exists already")
        try:
            schema = SearchSchema.from_json(schema_json)
        except (ValueError, KeyError) as e:
            raise RuntimeError(f"Cannot create collection {name}: {e}") from e
        self._open[name] = Collection.create(self.spark, path, schema, mode)
        return self._open[name]

    def open(self, name: str, schema_json: str = "", mode: str = READ_WRITE) -> Collection:
        name = self.name(name)
        if name not in self._open:
            if not Collection.exists(self.spark, f"{self.root}/{name}"):
                raise ValueError(f"Unknown collection: {name}")
            self._open[name] = Collection.open(self.spark, f"{self.root}/{name}", SearchSchema.from_json(schema_json) if schema_json else None, mode)
        return self._open[name]

    def close(self, name: str) -> None:
        name = self.name(name)
        if name == "default":
            raise ValueError("The default collection cannot be closed")
        self.get(name)
        del self._open[name]

    def get(self, name: str = "") -> Collection:
        name = self.name(name)
        if name not in self._open:
            raise ValueError(f"Unknown collection: {name}")
        return self._open[name]

    def list(self) -> list[str]:
        return sorted(self._open)

    def health(self) -> dict[str, dict]:
        return {n: c.health() for n, c in sorted(self._open.items())}
