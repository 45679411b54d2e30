"""Scans: explicit schemas, pruned columns, guards before a scan, incremental top-up."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import facts, routing

PUBLICATIONS = "application_number string, assignee_name string, country_code string, filing_date int, publication_date int, grant_date int, priority_date int"
NESTED_PUBLICATIONS = "application_number string, assignee_harmonized array<struct<name: string, country_code: string>>, country_code string, filing_date int, publication_date int, grant_date int, priority_date int"


class Source(Protocol):
    """A source gives a DataFrame of a stated schema; nothing is inferred."""

    def read(self, spark: SparkSession) -> DataFrame: ...


class TooLarge(RuntimeError):
    pass


def estimated_bytes(df: DataFrame) -> int:
    """Size of a plan's scans as the optimizer sees it, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def guarded(df: DataFrame, max_bytes: int) -> DataFrame:
    """The DataFrame, or an error if its estimated size is beyond the cap."""
    if (n := estimated_bytes(df)) > max_bytes:
        raise TooLarge(f"the plan reads about {n} bytes, more than {max_bytes}")
    return df


class PublicationScan:
    """One consolidated scan of nested publication rows for all entities.

    Seven columns, one office, one row per publication and assignee. With ``prefixes``
    (a stated list of rules) only publications are read of which some assignee's name
    begins with one of them, and only such assignees come out; the office is pushed
    down to the file.
    """

    def __init__(self, path: str, country: str = "US", prefixes: list[str] | None = None) -> None:
        self.path, self.country = path, country
        self.prefixes = None if prefixes is None else sorted({p.rstrip("%").upper() for p in prefixes})

    def _wanted(self, name: Column) -> Column:
        hit = F.lit(False)
        for p in self.prefixes or []:
            hit = hit | F.upper(name).startswith(p)
        return F.coalesce(hit, F.lit(False))

    def read(self, spark: SparkSession) -> DataFrame:
        raw = spark.read.schema(NESTED_PUBLICATIONS).parquet(self.path).where(F.col("country_code") == self.country)
        named = F.col("assignee_harmonized") if self.prefixes is None else F.filter("assignee_harmonized", lambda a: self._wanted(a["name"]))
        return raw.select("application_number", F.explode(named).alias("a"), "country_code", "filing_date", "publication_date", "grant_date", "priority_date").select(
            "application_number", F.col("a.name").alias("assignee_name"), "country_code", "filing_date", "publication_date", "grant_date", "priority_date"
        )


class CsvStore:
    """Raw publication rows as CSV with a stated schema, header first."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, df: DataFrame) -> None:
        df.select(*[c.split(" ")[0] for c in PUBLICATIONS.split(", ")]).write.mode("overwrite").option("header", True).csv(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(PUBLICATIONS).option("header", True).option("mode", "PERMISSIVE").csv(self.path)


class CompanyFacts:
    """Nested filings documents, one JSON file each; files that are no such document are skipped.

    Facts of several registrants of a company are united by a (cik, ticker) table; if
    none of a company's registrants is there, ``require`` raises.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, spark: SparkSession) -> DataFrame:
        return facts.parse_companyfacts(spark.read.text(self.path, wholetext=True))

    def for_companies(self, spark: SparkSession, registrants: DataFrame, require: bool = True) -> DataFrame:
        got = self.read(spark).join(registrants, "cik")
        if require:
            missing = [r[0] for r in registrants.select("ticker").distinct().join(got.select("ticker").distinct(), "ticker", "left_anti").limit(20).collect()]
            if missing:
                raise LookupError(f"no registrant available for {missing}")
        return got


class WideStatement:
    """A second source's statements: items as rows, period ends as columns, to long form without missing values."""

    def __init__(self, path: str, items: dict[str, str]) -> None:
        self.path, self.items = path, items

    def read(self, spark: SparkSession) -> DataFrame:
        wide = spark.read.option("header", True).csv(self.path)
        ends = [c for c in wide.columns if c not in ("ticker", "item")]
        long = wide.unpivot(["ticker", "item"], ends, "end", "text")
        concept = F.create_map(*[F.lit(x) for kv in self.items.items() for x in kv])[F.col("item")]
        value = F.col("text").try_cast("double")
        return long.select("ticker", concept.alias("concept"), F.col("end").try_cast("date").alias("end"), value.alias("value")).where("concept is not null and end is not null and value is not null and not isnan(value)")


def first_of(column: str, path: str):
    """A nested value by a dotted path, the first element of any list on the way, NULL where there is none."""
    parts = path.split(".")
    c = F.col(column)
    for p in parts:
        c = F.try_element_at(c, F.lit(1)) if p == "[0]" else c[p]
    return c


def low_counts(apps: DataFrame, expected: DataFrame) -> DataFrame:
    """Entities with fewer applications than their stated least number (none at all counts as zero)."""
    n = apps.groupBy("ticker").agg(F.count("*").alias("n"))
    return expected.join(n, "ticker", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < expect_min")


def missing_entities(cached: DataFrame, rules: DataFrame) -> DataFrame:
    """Entities none of whose prefixes begins a cached name: what an incremental fetch has to add."""
    hit = routing.prefix_hits(cached.select(F.col("assignee_name").alias("name")).where("name is not null").distinct(), rules.where("kind = 'match'"))
    return rules.where("kind = 'match'").select("ticker").distinct().join(hit.select("ticker").distinct(), "ticker", "left_anti")


def top_up(cached: DataFrame, fetched: DataFrame, rules: DataFrame) -> DataFrame:
    """The cache with the rows of missing entities; rules are applied anew after every read."""
    want = rules.join(missing_entities(cached, rules), "ticker", "left_semi")
    names = fetched.select(F.col("assignee_name").alias("name")).where("name is not null").distinct()
    new = routing.prefix_hits(names, want).select(F.col("name").alias("assignee_name")).distinct()
    return cached.unionByName(fetched.join(new, "assignee_name", "left_semi").select(*cached.columns))
