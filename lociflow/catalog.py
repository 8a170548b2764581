"""Named domain tables with health, version and the session-wide search terms."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import __version__
from .operators.rollups import counts_of, counts_of_kind, state_of
from .schemas import SCHEMAS, normalise
from .sources import bed
from .sources.envelopes import read_envelopes
from .storage import fresh_path


TARGETS = ("production", "dev")


class Catalog:
    """Domain tables by name; every table is lazy and normalised to its canonical schema."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], version: str = __version__, root: str = "", normal: Collection[str] = (), copies: dict[str, list[str]] | None = None, whole: Callable[[], str] | None = None, derived: Callable[[str], DataFrame] | None = None, counts: Callable[[str], DataFrame] | None = None, keys: Callable[[str, Collection[str]], DataFrame] | None = None, stored: Callable[[str], bool] | None = None):
        self.spark, self._tables, self.version, self._folder, self._normal, self._copies, self._whole = spark, tables, version, root, normal, copies or {}, whole
        self._derived, self._counts, self._keys, self._stored = derived, counts, keys, stored

    @property
    def root(self) -> str:
        """The folder of all tables, which are written now if some are not there yet."""
        return self._whole() if self._whole else self._folder

    @classmethod
    def from_bed(cls, spark: SparkSession, sf_dir: str) -> Catalog:
        """The bed's tables, each stored in the shared folder when it is first asked for in a session; `root` is the folder, made whole."""
        shelf = bed.shelf(spark, sf_dir, __version__)

        def read(name: str) -> DataFrame:
            path, buckets, schema = shelf.path(name), shelf.buckets(name), shelf.schema(name)
            return bed.open_buckets(spark, path, schema, *buckets) if buckets else spark.read.schema(schema).parquet(path).select(schema.names)

        def counts(kind: str) -> DataFrame:
            path = shelf.counts_path(kind)
            found = spark.read.parquet(path).select(F.lit(kind).alias("kind"), *SCHEMAS["rollups"].names[1:])
            return found.hint("merge") if shelf.is_large(path) else found

        return cls(spark, _Lazy(read), __version__, shelf.folder, frozenset(SCHEMAS), {t: sorted(c) for t, c in bed.COPIES.items()}, shelf.whole, shelf.derived, counts, shelf.keys, shelf.has)

    @classmethod
    def target(cls, spark: SparkSession, name: str = "production") -> Catalog:
        """The catalog of a named target, whose folder is the session's setting `spark.lociflow.<name>`; ValueError for any other name."""
        if name not in TARGETS:
            raise ValueError(f"target is one of {TARGETS}")
        root = spark.conf.get(f"spark.lociflow.{name}", None)
        if not root:
            raise ValueError(f"spark.lociflow.{name} must name the folder of the tables")
        return cls.open(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Catalog:
        """Parquet tables under `root` with a `manifest.json` whose version must be this package's; it may hold the tables' schemas.

        {"version": "...", "tables": {"traits": <schema as Spark's JSON>, ...}, "normal": ["traits", ...], "copies": {"associations":
        ["variant_id"], ...}, "buckets": {"coloc_groups": ["coloc_group_id", 8], ...}}; a table that it does not name is asked for its
        schema, and one that it does not call normal is normalised, which keeps filters on its doubles from the files. Copies are tables
        in another order (`<table>_by_<column>.parquet`); tables in buckets are read with them.
        """
        text = "\n".join(r.value for r in spark.read.text(f"{root}/manifest.json").limit(1000).collect())  # a few lines
        manifest = json.loads(text)
        version, schemas = manifest["version"], manifest.get("tables", {})
        if version != __version__:
            raise ValueError(f"data of version {version}, package of version {__version__}: update the package")
        reader = lambda name: spark.read.schema(T.StructType.fromJson(schemas[name])) if name in schemas else spark.read
        whole = lambda name, df: df.select(T.StructType.fromJson(schemas[name]).names) if name in schemas else df  # noqa: E731  # folders' columns in their place
        copies, buckets = manifest.get("copies", {}), manifest.get("buckets", {})
        schemas |= {f"{t}_by_{c}": schemas[t] for t in copies for c in copies[t] if t in schemas}

        def read(name: str) -> DataFrame:
            path = f"{root}/{name}.parquet"
            return bed.open_buckets(spark, path, T.StructType.fromJson(schemas[name]), *buckets[name]) if name in buckets else whole(name, reader(name).parquet(path))

        return cls(spark, _Lazy(read), version, root, frozenset(manifest.get("normal", ())), copies)

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> tuple[Catalog, DataFrame]:
        """The domain tables that JSON documents hold, each read once, and the documents that do not fit (see `sources.envelopes`)."""
        found = read_envelopes(spark, path, SCHEMAS)
        return cls(spark, found.tables), found.bad

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self._tables[name] if name in self._normal else normalise(self._tables[name], name)

    def by(self, name: str, column: str) -> DataFrame:
        """The table, in the copy that is in the order of the column if there is one, so that a filter on it skips files and row groups."""
        if column not in self._copies.get(name, ()):
            return getattr(self, name)
        copy = self._tables[f"{name}_by_{column}"]
        return copy if name in self._normal else normalise(copy, name)

    def narrow(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table for a plan that reads few of them: the bed's tables are not stored for it, with columns that nobody reads."""
        return (self._derived(name) if self._derived else getattr(self, name)).select(*columns)

    def keys(self, name: str, *columns: str, by: str | None = None) -> DataFrame:
        """Columns of a fact table for a semi-join or a set: a row may be there more or fewer times than in the table, but is there if it is
        in the table. The bed reads them from its stored rows and joins no table whose columns are not asked for; other catalogs read the
        table, in the copy that is in the order of `by`."""
        return (self._keys(name, columns) if self._keys else self.by(name, by) if by else getattr(self, name)).select(*columns)

    def is_stored(self, name: str) -> bool:
        """Whether reading the table derives nothing."""
        return self._stored is None or self._stored(name)

    def settled(self, df: DataFrame) -> DataFrame:
        """The frame written to the shared folder and read from it: it is derived once, however often it is read, and Spark knows its size."""
        path = fresh_path(self.spark, "settled")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counts_for(self, kind: str) -> DataFrame:
        """Counts of one kind of subjects, `trait`, `gene` or `symbol`; where they can be stored apart, the others are not."""
        if self._counts:
            return self._counts(kind)
        if "rollups" in self._normal:
            return self.rollups.filter(F.col("kind") == kind)
        return counts_of_kind(kind, {t: getattr(self, t) for t in ("study_extractions", "coloc_groups", "rare_results")})

    @property
    def counts(self) -> DataFrame:
        """Counts of different values by subject: the stored ones, else counted now."""
        if "rollups" in self._normal:
            return self.rollups
        return counts_of(state_of({t: getattr(self, t) for t in ("study_extractions", "coloc_groups", "rare_results")}))

    @property
    def has_postings(self) -> bool:
        """Whether the catalog has posting lists of the groups, by which closures find a subject's groups."""
        return "postings" in self._normal

    @property
    def cached_search_terms(self) -> DataFrame:
        """Search terms with lower-cased columns, persisted once for the session and the catalog's root."""
        key = (self.spark.sparkContext.applicationId, self._folder or id(self))
        if key not in _TERMS:
            t = self.search_terms
            _TERMS[key] = t.withColumns({"name_lower": F.lower("name"), "alt_name_lower": F.lower("alt_name")}).persist()
        return _TERMS[key]

    def health(self, names: tuple[str, ...] = ("traits", "genes", "variants", "study_extractions", "coloc_groups")) -> DataFrame:
        """One row: healthy if every table can be read and has a row."""
        probes = [getattr(self, n).select(F.lit(n).alias("t")).limit(1) for n in names]
        out = probes[0]
        for p in probes[1:]:
            out = out.unionAll(p)
        return out.agg(F.when(F.countDistinct("t") == len(names), "healthy").otherwise("unhealthy").alias("status"))


_TERMS: dict[tuple, DataFrame] = {}


class _Lazy(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, name):
        self[name] = self.make(name)
        return self[name]
