"""The project table: listing, search, upsert and deletion over DataFrames, and a store of versioned Parquet folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlane.sources.shared import drop_path, written

_TEXT = ("id", "name", "description", "created_at", "updated_at", "created_at_formatted", "updated_at_formatted", "source_type", "location_name", "year_t1", "year_t2", "thumbnail_url", "coords", "stats", "results_data")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in _TEXT] + [T.StructField("is_shared", T.BooleanType()), T.StructField("zoom", T.IntegerType())])
#: What keeps its first value when a project is saved again.
FIRST_ONLY = ("created_at", "created_at_formatted")
#: Keywords of the listing's scopes, over name, place and collection.
SCOPES = {
    "kentsel": ("kentsel", "dönüşüm", "fikirtepe", "kadıköy", "mamak", "örnekköy"),
    "konut": ("konut", "başakşehir", "kayaşehir", "incek", "müstakil", "teksas"),
    "sanayi": ("sanayi", "austin", "giga", "dubai", "fabrika", "lojistik"),
}


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with `place`, 1-based in a global order. Rows are range-sorted; a partition's offset is the sum of the counts before
    it, so that no task sees more than its own rows."""
    at = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id() % (1 << 33)})
    at, _ = written(at, "ranked")
    counts, offsets, total = at.groupBy("_part").agg(F.max("_row").alias("last")).orderBy("_part").collect(), [], 0
    for r in counts:  # one row a partition
        offsets.append((r["_part"], total))
        total += r["last"] + 1
    offset = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return at.join(F.broadcast(offset), "_part").withColumn("place", F.col("_row") + F.col("_offset") + 1).drop("_part", "_row", "_offset")


def newest_first() -> list[Column]:
    return [F.col("updated_at").desc(), F.col("created_at").desc(), F.col("id").asc()]


def listed(projects: DataFrame) -> DataFrame:
    """Without the results, with each project's place."""
    return ranked(projects.drop("results_data"), *newest_first())


def search(projects: DataFrame, text: str | None) -> DataFrame:
    """Name or description holds the text, in any case."""
    if not text:
        return projects
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(F.lower(F.lit(text)))
    return projects.where(has("name") | has("description"))


def in_scope(projects: DataFrame, words: tuple[str, ...]) -> DataFrame:
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("name", "location_name", "collection") if c in projects.columns]
    text = F.lower(F.concat_ws(" ", *fields))
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return projects.where(hit)


def sorted_by(projects: DataFrame, mode: str) -> DataFrame:
    """name (Turkish order), area (largest first, none as 0), created or updated (newest first)."""
    order = {"name": F.collate(F.col("name"), "tr").asc(), "area": F.coalesce(F.get_json_object("stats", "$.total_changed_m2").cast("double"), F.lit(0.0)).desc(), "created": F.col("created_at").desc(), "updated": F.col("updated_at").desc()}
    return projects.orderBy(order[mode], "id")


def recent(projects: DataFrame, n: int = 5) -> DataFrame:
    """The newest; a limit is what is asked for."""
    return projects.orderBy(*newest_first()).limit(n)


def upserted(base: DataFrame, new: DataFrame, first_only: tuple[str, ...] = FIRST_ONLY) -> DataFrame:
    """base with the rows of new put in or over the ones of their id; columns of first_only stay as they were. Ids are unique in each."""
    b, n = base.alias("b"), new.select("*", F.lit(True).alias("_new")).alias("n")
    pick = lambda c: F.col(f"b.{c}") if c in first_only else F.col(f"n.{c}")
    both = b.join(n, F.col("b.id") == F.col("n.id"), "full_outer")
    put = lambda c: F.when(F.col("n._new").isNull(), F.col(f"b.{c}")).when(F.col("b.id").isNull(), F.col(f"n.{c}")).otherwise(pick(c)).alias(c)
    return both.select(*[put(c) for c in base.columns])


def deleted(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("id").distinct(), "id", "left_anti")


def result_dirs(rows: DataFrame, *url_columns: str) -> DataFrame:
    """Names of the result folders that urls point to."""
    url = F.explode(F.array(*[F.col(c) for c in url_columns])).alias("url")
    return rows.select(url).select(F.regexp_extract("url", r"^/static/results/([0-9a-f]{12})/", 1).alias("dir")).where("dir <> ''").distinct()


def prepared(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows as the store keeps them: ids and first dates for new ones, defaults, times, a thumbnail out of the results."""
    now = F.current_timestamp() if now is None else now
    iso, shown = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.date_format(now, "dd.MM.yyyy, HH:mm")
    have = set(rows.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    text = lambda c, default: F.coalesce(col(c).cast("string"), F.lit(default)).alias(c)
    given = F.nullif(col("id").cast("string"), F.lit(""))
    made = F.concat(F.lit("proj_"), F.unix_timestamp(now).cast("string"), F.lit("_"), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 6))
    first = lambda c, value: F.when(given.isNull(), value).otherwise(col(c).cast("string")).alias(c)
    overlay = lambda k: F.nullif(F.get_json_object(col("results_data").cast("string"), f"$.overlays.{k}"), F.lit(""))
    thumb = F.coalesce(F.nullif(col("thumbnail_url").cast("string"), F.lit("")), overlay("t2_png_base64"), overlay("t1_png_base64"), F.lit("")).alias("thumbnail_url")
    out = {
        "id": F.coalesce(given, made), "name": text("name", "İsimsiz Proje"), "created_at": first("created_at", iso), "created_at_formatted": first("created_at_formatted", shown), "updated_at": iso, "updated_at_formatted": shown, "source_type": text("source_type", "live-hotspot"),
        "thumbnail_url": thumb, "coords": text("coords", "[0, 0]"), "stats": text("stats", "{}"), "results_data": text("results_data", "{}"), "is_shared": F.coalesce(col("is_shared").cast("boolean"), F.lit(False)), "zoom": F.coalesce(col("zoom").cast("int"), F.lit(17)),
    }
    return rows.select(*[out.get(f.name, text(f.name, "")).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])


JSON_COLUMNS = ("coords", "stats", "results_data")


def with_valid_json(rows: DataFrame) -> DataFrame:
    """Rows whose JSON columns are null where their text cannot be parsed; empty texts stay."""
    return rows.withColumns({c: F.when((F.col(c) == "") | F.try_parse_json(c).isNotNull(), F.col(c)) for c in JSON_COLUMNS if c in rows.columns})


class Conflict(RuntimeError):
    """Others have changed the store each time that a change was tried."""


class ProjectStore:
    """Versions of the table in a folder. A change writes a data folder of its own and then the next commit file, which names it and
    which only one writer can make; who comes late applies the change to what is new. Readers take the last commit, so a write
    that breaks off leaves nothing but a folder that `clean` removes."""

    def __init__(self, spark: SparkSession, path: str, tries: int = 5):
        self.spark, self.path, self.tries = spark, path.rstrip("/"), tries
        self._file = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._file(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commits(self) -> dict[int, str]:
        """Data folder of each version; a commit file that is still empty does not count. Folders v1, v2, ... are of stores without
        commit files."""
        out = {int(n[1:]): n for n in self._names(self.path) if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._file(f"{self.path}/{n}/_SUCCESS"))}
        for n in self._names(f"{self.path}/_commits"):
            if n.isdigit():
                stream = self._fs.open(self._file(f"{self.path}/_commits/{n}"))
                try:
                    name = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
                if name.endswith("\n"):
                    out[int(n)] = name.strip()
        return out

    def _read(self, commits: dict[int, str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{commits[max(commits)]}") if commits else self.spark.createDataFrame([], SCHEMA)

    def all(self) -> DataFrame:
        return self._read(self._commits())

    def _committed(self, version: int, name: str) -> bool:
        """Whether the commit file could be made."""
        at = self._file(f"{self.path}/_commits/{version:012d}")
        if self._fs.exists(at):
            return False
        try:
            stream = self._fs.create(at, False)
        except Exception as e:  # another writer was faster
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(f"{name}\n".encode()))
        stream.close()
        return True

    def _change(self, of: Callable[[DataFrame], DataFrame]) -> None:
        """The next version is what `of` makes of the last."""
        for _ in range(self.tries):
            commits = self._commits()
            name = f"data-{uuid.uuid4().hex}"
            of(self._read(commits)).write.parquet(f"{self.path}/{name}")
            if self._committed(max(commits, default=0) + 1, name):
                return
            drop_path(self.spark, f"{self.path}/{name}")
        raise Conflict(f"{self.tries} tries")

    def clean(self, keep: int = 10) -> None:
        """Removes all versions but the last `keep`, and data without a commit. No change may be under way."""
        commits = self._commits()
        kept = set(sorted(commits)[-keep:])
        names = {commits[v] for v in kept}
        for n in self._names(self.path):
            if (n.startswith("data-") or n[:1] == "v" and n[1:].isdigit()) and n not in names:
                drop_path(self.spark, f"{self.path}/{n}")
        for n in self._names(f"{self.path}/_commits"):
            if n.isdigit() and int(n) not in kept:
                drop_path(self.spark, f"{self.path}/_commits/{n}")

    def save(self, rows: DataFrame) -> None:
        fresh, path = written(prepared(rows), "projects")  # ids are drawn once
        self._change(lambda now: upserted(now, fresh))
        drop_path(self.spark, path)

    def delete(self, id_: str) -> bool:
        """Whether there was one."""
        found = not self.get(id_).isEmpty()
        if found:
            self._change(lambda now: now.where(F.col("id") != id_))
        return found

    def clear(self) -> None:
        self._change(lambda now: now.where(F.lit(False)))

    def get(self, id_: str) -> DataFrame:
        return with_valid_json(self.all().where(F.col("id") == id_))

    def list(self, text: str | None = None) -> DataFrame:
        return with_valid_json(search(self.all().drop("results_data"), text)).orderBy(*newest_first())
