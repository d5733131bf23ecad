"""A collection: chunks by id with their vectors, kept as segments of Parquet and a log of which segments count.

A change writes one segment with the rows it changes (a delta) and one log
entry. A log entry is created, never overwritten, so that of two writers of one
version the second fails. Where FANOUT segments of one level have gathered they
are merged into one of the next level, so that a row is rewritten about as often
as the logarithm of the collection's size to that base. Rows are (id, document,
metadata map, version, embedding); segments also hold who wrote them (seq) and
whether a row is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talefold.functions.text import preview

SCHEMA = "id string, document string, metadata map<string,string>, version bigint, embedding array<float>"
SEGMENT = SCHEMA + ", seq bigint, deleted boolean"
COLUMNS = ["id", "document", "metadata", "version", "embedding"]
#: Segments of one level that are merged into one of the next.
FANOUT = 8


def upserted(existing: DataFrame, incoming: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The last write of each id: the greatest version, incoming before existing at equal versions.

    Rows of null id are dropped. Of equal rows any may stay; `tie` columns are
    all other columns, so the outcome is the same in every run.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1))).where(F.col(key).isNotNull())
    rest = [c for c in existing.columns if c not in (key, version)]
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"), *[F.to_json(F.struct(F.col(c))) if "map" in dict(existing.dtypes)[c] else F.col(c) for c in rest]))
    return both.withColumn("_k", last).where("_k = 1").drop("_k", "_new")


def inserted(existing: DataFrame, ids: list[str], document: str, metadata: dict[str, str]) -> DataFrame:
    """The same document under every new id; ids that exist stay as they are. No ids is an error."""
    if not ids:
        raise ValueError("no ids")
    spark = existing.sparkSession
    entries = F.create_map(*[x for k, v in ({"query_type": "Title"} | metadata).items() for x in (F.lit(k), F.lit(v))])
    new = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string").join(existing.select("id"), "id", "left_anti")
    return existing.unionByName(new.select("id", F.lit(document).alias("document"), entries.alias("metadata"), F.lit(0).cast("bigint").alias("version")), allowMissingColumns=True)


def updated(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """New documents (id, document) for ids that exist; the rest of each row stays. `changed` asks for a new embedding."""
    new = changes.groupBy("id").agg(F.max("document").alias("_document"))
    rows = existing.join(new, "id", "left")
    changed = F.col("_document").isNotNull() & ~F.col("_document").eqNullSafe(F.col("document"))
    return rows.withColumn("changed", changed).withColumn("document", F.coalesce("_document", "document")).drop("_document")


def deleted(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("id").distinct(), "id", "left_anti")


def absent(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids asked for that no row has."""
    return ids.select("id").distinct().join(existing, "id", "left_anti")


def page(df: DataFrame, key: str = "id", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in the order of the key from offset on; limit None, 0 or less is all."""
    rows = df.orderBy(key).offset(max(0, offset))
    return rows.limit(limit) if limit and limit > 0 else rows


def listing(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    return page(df, "id", offset, limit).select("id", preview(F.col("document")).alias("preview"))


def _merged(rows: DataFrame, keep_deleted: bool) -> DataFrame:
    """Of each id the row that counts: the greatest version, then the last written, among those written after its last deletion."""
    by = Window.partitionBy("id")
    gone = F.coalesce(F.max(F.when(F.col("deleted"), F.col("seq"))).over(by), F.lit(-1))
    rows = rows.withColumn("_gone", gone).where((F.col("seq") > F.col("_gone")) | (F.col("deleted") & (F.col("seq") == F.col("_gone"))))
    last = F.row_number().over(Window.partitionBy("id", "deleted").orderBy(F.desc("version"), F.desc("seq")))
    rows = rows.withColumn("_k", last).where("_k = 1").drop("_gone", "_k")
    return rows if keep_deleted else rows.where(~F.col("deleted"))


class Collection:
    """A named collection in a folder that all executors share.

    `embed` makes the vectors of documents as they are written; without it a
    collection keeps the vectors that rows bring, if any.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, embed: Callable[[Column], Column] | None = None):
        if not name.strip():
            raise ValueError("a collection needs a name")
        self.spark, self.path, self.embed = spark, f"{root.rstrip('/')}/{name.strip()}", embed

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The newest log entry; -1 where there is none."""
        fs, path = self._fs()
        log = path(f"{self.path}/log")
        if not fs.exists(log):
            return -1
        names = [f.getPath().getName() for f in fs.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def segments(self, version: int | None = None) -> list[dict]:
        """What a version consists of: folders with their level and the range of changes (first, last seq) they hold, oldest first."""
        v = self.version() if version is None else version
        if v < 0:
            return []
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/log/{v:012d}.json").collect()))

    def create(self) -> int:
        """Make the collection if it isn't there."""
        return self.version() if self.version() >= 0 else self._commit(-1, [])

    def _commit(self, seen: int, segments: list[dict]) -> int:
        """Write log entry seen + 1; an error if another writer has done so since `seen` was read."""
        fs, path = self._fs()
        target = path(f"{self.path}/log/{seen + 1:012d}.json")
        try:
            out = fs.create(target, False)
        except Exception as e:
            raise RuntimeError(f"version {seen + 1} of {self.path} was written by somebody else") from e
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        return seen + 1

    def _segment(self, rows: DataFrame, level: int, first: int, last: int) -> dict:
        name = f"s{first:012d}-{uuid.uuid4().hex}"
        rows.select(*COLUMNS, "seq", "deleted").write.parquet(f"{self.path}/{name}")
        return {"name": name, "level": level, "first": first, "last": last}

    def _rows(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], SEGMENT)
        return self.spark.read.schema(SEGMENT).parquet(*[f"{self.path}/{s['name']}" for s in segments])

    def _append(self, rows: DataFrame, seen: int, deleted: bool = False) -> int:
        """One segment of these rows, then merges of what has gathered."""
        seq = seen + 1
        segments = [*self.segments(seen), self._segment(rows.withColumn("seq", F.lit(seq).cast("bigint")).withColumn("deleted", F.lit(deleted)), 0, seq, seq)]
        while len(segments) >= FANOUT and len({s["level"] for s in segments[-FANOUT:]}) == 1:
            old, tail = segments[:-FANOUT], segments[-FANOUT:]
            # deletions are forgotten once no older segment is left
            segments = [*old, self._segment(_merged(self._rows(tail), bool(old)), tail[0]["level"] + 1, tail[0]["first"], tail[-1]["last"])]
        return self._commit(seen, segments)

    def read(self) -> DataFrame:
        """All rows; of a collection that doesn't exist, none. A single segment without deletions is read as it is."""
        segments = self.segments()
        rows = self._rows(segments)
        if len(segments) == 1 and segments[0]["level"] > 0:
            return rows.select(*COLUMNS)
        return _merged(rows, False).select(*COLUMNS)

    def _shaped(self, df: DataFrame) -> DataFrame:
        given = F.col("embedding") if "embedding" in df.columns else F.lit(None).cast("array<float>")
        vector = self.embed(F.col("document")) if self.embed else given
        return df.select("id", "document", F.col("metadata").cast("map<string,string>").alias("metadata"), F.col("version").cast("bigint").alias("version"), vector.cast("array<float>").alias("embedding"))

    def upsert(self, incoming: DataFrame, batch: int | None = None) -> int:
        """Write these rows: the greatest version of an id counts, the later written one of equal versions. Null ids are dropped.

        `batch` writes ids in that many groups, one segment each, so that one
        write never holds more than its group.
        """
        seen = self.version()
        rows = self._shaped(incoming)
        empty = self.spark.createDataFrame([], SCHEMA)
        if batch is None or batch <= 1:
            return self._append(upserted(empty, rows), seen)
        for k in range(batch):
            seen = self._append(upserted(empty, rows.where(F.pmod(F.xxhash64("id"), F.lit(batch)) == k)), seen)
        return seen

    def insert(self, ids: list[str], document: str, metadata: dict[str, str]) -> int:
        """The same document under every new id; ids that exist stay."""
        seen = self.version()
        all_rows = inserted(self.read().drop("embedding"), ids, document, metadata)
        new = all_rows.join(self.read().select("id"), "id", "left_anti")
        return self._append(self._shaped(new), seen)

    def update(self, changes: DataFrame) -> int:
        """New documents (id, document) for ids that exist; only rows that change are written, and embedded, again."""
        seen = self.version()
        touched = self.read().join(changes.select("id").distinct(), "id", "left_semi")
        return self._append(self._shaped(updated(touched, changes).where("changed").drop("changed")), seen)

    def delete(self, ids: DataFrame) -> int:
        seen = self.version()
        gone = self.read().join(ids.select("id").distinct(), "id", "left_semi").withColumn("document", F.lit(None).cast("string")).withColumn("metadata", F.lit(None).cast("map<string,string>")).withColumn("embedding", F.lit(None).cast("array<float>"))
        return self._append(gone, seen, True)

    def reset(self) -> int:
        """An empty version; older segments stay until vacuum()."""
        return self._commit(self.version(), [])

    def vacuum(self) -> None:
        """Delete the segments that the newest version doesn't name."""
        fs, path = self._fs()
        kept = {s["name"] for s in self.segments()}
        for f in fs.listStatus(path(self.path)):
            name = f.getPath().getName()
            if name.startswith("s") and name not in kept:
                fs.delete(f.getPath(), True)

    def get(self, key: str) -> DataFrame:
        """The row of an id; the filter reaches the scan."""
        segments = self.segments()
        return _merged(self._rows(segments).where(F.col("id") == key), False).select(*COLUMNS)

    def count(self) -> int:
        return self.read().count()

    def peek(self, n: int = 5, width: int = 500) -> DataFrame:
        return page(self.read(), limit=n).select("id", F.substring("document", 1, width).alias("document"))

    def ids(self, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, int]:
        """A page of ids, and how many there are in all."""
        ids = self.read().select("id")
        return page(ids, offset=offset, limit=limit), ids.count()

    def list(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        return listing(self.read(), offset, limit)

    def content(self) -> DataFrame:
        """What searches see: rows whose query_type is content."""
        return self.read().where(F.try_element_at("metadata", F.lit("query_type")) == "content")


class Collections:
    """The collections of a folder: one is active, others can be made and chosen."""

    def __init__(self, spark: SparkSession, root: str, name: str, embed: Callable[[Column], Column] | None = None):
        self.spark, self.root, self.embed = spark, root, embed
        self.active = self.choose(name)

    def choose(self, name: str) -> Collection:
        """Make the named collection if there is none, and the active one."""
        self.active = Collection(self.spark, self.root, name, self.embed)
        self.active.create()
        return self.active
