"""Formatted collections: records in volumes, bucketed by id, with names, aliases and masks.

``write_collection`` stores below one folder

* ``records``: all columns with position, letters and volume, in partitions by volume and
  hash buckets of the id, each file sorted by id.  A join on the id reads the buckets in
  place; a lookup opens only the buckets of its ids;
* ``volumes``: records, letters and positions of every volume;
* ``names``: further identifiers of the records, bucketed so that one name held by a large
  part of all records fills several buckets;
* ``aliases`` and ``masks``, added later.

There are volumes times buckets files, so a volume should hold many letters for each bucket.
The tables are registered in the session's catalog as external tables; another session
registers them again with ``Collection.open``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.functions.text import letter_count
from recordmill.plans.ordered import Running, dense_positions, running
from recordmill.session import materialize

#: Letters of one bucket over all volumes, if the number of buckets is not given.
BUCKET_LETTERS = 1 << 27
#: Buckets that one name can fill.
NAME_PARTS = 16
_MAX_BUCKETS = 100_000
_RESERVED = ("position", "letters", "volume")


def write_collection(
    records: DataFrame,
    path: str,
    *,
    id_column: str = "id",
    text: str = "body",
    order: Sequence[str] | None = None,
    names: str | None = None,
    volume_letters: int = 1 << 40,
    volumes: int | None = None,
    buckets: int | None = None,
) -> Collection:
    """Store ``records`` as a collection and open it.

    In the order of ``order`` (the id, if none is given) a record belongs to the volume
    ``letters before it // volume_letters``; with ``volumes`` that size is the total divided by
    their number, rounded up.  ``names`` is a column of string arrays with further identifiers,
    which several records may share.  Ids must be unique and not null, else nothing is written.
    """
    clash = [c for c in _RESERVED if c in records.columns]
    if clash:
        raise ValueError(f"columns named {', '.join(clash)} are written by the collection: rename them")
    spark, order = records.sparkSession, list(order or [id_column])
    columns = dict.fromkeys([id_column, *order])
    narrow = materialize(
        records.select(*columns, F.greatest(letter_count(text), F.lit(0)).cast("long").alias("letters")), "letters"
    )
    if narrow.where(F.col(id_column).isNull()).limit(1).count():
        raise ValueError(f"null values in {id_column}")
    if narrow.groupBy(id_column).count().where("count > 1").limit(1).count():
        raise ValueError(f"duplicate values in {id_column}")
    total = narrow.agg(F.sum("letters")).first()[0] or 0
    if volumes is not None:
        volume_letters = max(1, math.ceil(total / volumes))
    if buckets is None:
        buckets = min(_MAX_BUCKETS, max(8, math.ceil(total / BUCKET_LETTERS)))
    placed = running(
        dense_positions(narrow, order, "position"), "position", [Running("before", F.col("letters"), exclusive=True)]
    )
    volume = F.floor(F.coalesce("before", F.lit(0)) / F.lit(volume_letters).cast("decimal(20,0)")).cast("int")
    placed = placed.select(id_column, "position", "letters", volume.alias("volume"))
    # Both sides are dealt as the buckets are, so the texts move once.
    joined = records.repartition(buckets, id_column).join(placed.repartition(buckets, id_column), id_column)
    collection = Collection(spark, path, id_column)
    collection._store(joined, "records", id_column, buckets, volumes=True)
    stored = collection.records
    stored.groupBy("volume").agg(
        F.count("*").alias("records"),
        F.sum("letters").alias("letters"),
        F.max("letters").alias("longest"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
    ).coalesce(1).write.parquet(f"{path}/volumes")  # one row per volume
    if names is not None:
        one = stored.select(F.explode(F.array_distinct(names)).alias("name"), F.col(id_column)).where("name IS NOT NULL")
        slot = _name_slot("name", F.pmod(F.xxhash64(id_column), F.lit(NAME_PARTS)))
        collection._store(one.withColumn("slot", slot).repartition(buckets, "slot"), "names", "slot", buckets)
    return collection


def _name_slot(name: str, part: Column) -> Column:
    return F.crc32(F.encode(name, "UTF-8")) * NAME_PARTS + part


@dataclass(frozen=True)
class Collection:
    """A stored collection; see :func:`write_collection`."""

    spark: SparkSession
    path: str
    id_column: str

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        """Register the tables of a collection, written by this or another session."""
        specs = spark.read.parquet(f"{path}/tables").collect()  # one row per table
        collection = cls(spark, path, next(r["key"] for r in specs if r["part"] == "records"))
        for spec in specs:
            collection._register(spec)
        return collection

    @property
    def records(self) -> DataFrame:
        return self._table("records")

    @property
    def volumes(self) -> DataFrame:
        """(volume, records, letters, longest, first_position, last_position)."""
        return self.spark.read.parquet(f"{self.path}/volumes")

    def fetch(self, ids: DataFrame | Sequence, alias: str | None = None) -> DataFrame:
        """Records whose id is in a list, or in the first column of a DataFrame.

        A list opens the buckets of its ids only.  A DataFrame is dealt as the buckets are, and
        joined without moving the collection.
        """
        held = self.records if alias is None else self.alias(alias)
        if not isinstance(ids, DataFrame):
            return held.where(F.col(self.id_column).isin(list(ids)))
        wanted = ids.select(F.col(ids.columns[0]).cast(held.schema[self.id_column].dataType).alias(self.id_column))
        return held.join(wanted.repartition(self._buckets(), self.id_column), self.id_column, "left_semi")

    def lookup(self, names: Sequence[str]) -> DataFrame:
        """(name, id): the records of each name, from the buckets of these names only."""
        slots = [zlib.crc32(n.encode()) * NAME_PARTS + part for n in names for part in range(NAME_PARTS)]
        held = self._table("names").where(F.col("slot").isin(slots) & F.col("name").isin(list(names)))
        return held.select("name", self.id_column)

    def write_alias(
        self, name: str, members: Sequence[int | str], *, ids: DataFrame | None = None, title: str = ""
    ) -> None:
        """Name a part of the collection: volumes and other aliases, optionally only listed ids.

        A member may be restricted by an id list of its own; the alias holds the union of its
        members, restricted by its own list.  ``ids`` gives the list as its first column.
        """
        known = self._aliases()
        if name in known:
            raise ValueError(f"there is an alias {name!r}")
        for member in members:
            if isinstance(member, str) and member not in known:
                raise ValueError(f"no alias {member!r}")
        stored = None
        if ids is not None:
            kind = self.records.schema[self.id_column].dataType
            listed = ids.select(F.col(ids.columns[0]).cast(kind).alias(self.id_column)).dropna().distinct()
            buckets, stored = self._buckets(), f"alias_ids_{len(known)}"
            self._store(listed.repartition(buckets, self.id_column), stored, self.id_column, buckets)
        rows = [(name, title, m if isinstance(m, int) else None, m if isinstance(m, str) else None, stored) for m in members]
        rows = rows or [(name, title, None, None, stored)]
        schema = "alias STRING, title STRING, volume INT, member STRING, ids STRING"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/aliases")

    def alias(self, name: str) -> DataFrame:
        """The records of an alias.

        Only its volumes are read.  Id lists lie in the same buckets as the records and are
        joined in place, so nothing is shuffled.
        """
        known = self._aliases()
        if name not in known:
            raise ValueError(f"no alias {name!r}")
        lists: dict[str, str] = {}
        reached: set[int] = set()

        def inside(alias: str) -> Column:
            part = F.lit(False)
            for row in known[alias]:
                if row["member"] is not None:
                    part = part | inside(row["member"])
                elif row["volume"] is not None:
                    reached.add(row["volume"])
                    part = part | (F.col("volume") == row["volume"])
            stored = known[alias][0]["ids"]
            if stored is not None:
                part = part & F.col(lists.setdefault(stored, f"__{stored}")).isNotNull()
            return part

        keep = inside(name)
        held = self.records
        columns = held.columns
        held = held.where(F.col("volume").isin(sorted(reached)))
        for stored, flag in lists.items():
            held = held.join(self._table(stored).withColumn(flag, F.lit(1)), self.id_column, "left")
        return held.where(keep).select(*columns)

    def add_mask(self, name: str, masks: DataFrame) -> None:
        """Keep (id, start, stop) mask intervals, 0-based and half-open, beside the records."""
        buckets = self._buckets()
        kept = masks.select(F.col("id").alias(self.id_column), "start", "stop")
        self._store(kept.repartition(buckets, self.id_column), f"mask_{name}", self.id_column, buckets)

    def masks(self, *names: str) -> DataFrame:
        """(id, start, stop): the intervals of the named masks."""
        parts = [self._table(f"mask_{n}").select(F.col(self.id_column).alias("id"), "start", "stop") for n in names]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _aliases(self) -> dict[str, list]:
        if "aliases" not in self._listing():
            return {}
        found: dict[str, list] = {}
        for row in self.spark.read.parquet(f"{self.path}/aliases").collect():  # a few rows per alias
            found.setdefault(row["alias"], []).append(row)
        return found

    def _listing(self) -> set[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {status.getPath().getName() for status in system.listStatus(hadoop)}

    def _name(self, part: str) -> str:
        if not re.fullmatch(r"\w+", part):
            raise ValueError(f"not a name: {part!r}")
        return f"collection_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{part}"

    def _table(self, part: str) -> DataFrame:
        return self.spark.table(self._name(part))

    def _buckets(self) -> int:
        rows = self.spark.read.parquet(f"{self.path}/tables").where(F.col("part") == "records").collect()
        return rows[0]["buckets"]

    def _store(self, rows: DataFrame, part: str, key: str, buckets: int, volumes: bool = False) -> None:
        writer = rows.write.format("parquet").option("path", f"{self.path}/{part}").mode("errorifexists")
        if volumes:
            writer = writer.partitionBy("volume")
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(self._name(part))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._table(part).schema)
        spec = [(part, key, buckets, columns, volumes)]
        schema = "part STRING, key STRING, buckets INT, columns STRING, volumes BOOLEAN"
        self.spark.createDataFrame(spec, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/tables")

    def _register(self, spec) -> None:
        name, key = self._name(spec["part"]), spec["key"]
        if self.spark.catalog.tableExists(name):
            return
        by_volume = "PARTITIONED BY (volume)" if spec["volumes"] else ""
        self.spark.sql(
            f"CREATE TABLE {name} ({spec['columns']}) USING parquet {by_volume} CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {spec['buckets']} BUCKETS LOCATION '{self.path}/{spec['part']}'"
        )
        if spec["volumes"]:
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
