"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a function of training time, piecewise linear between knots.
Its integral is the source's cumulative token demand; documents stand in a fixed
pseudo-random order within their source, each copy covering an interval of the
source's tokens, and the inverse of the demand gives the training position at which
that interval begins. Sorting by position range-partitions the mixture.

A source repeats as often as its demand needs, but at most ``max_repeats`` times;
where that is not enough its supply runs out before the end, which the report shows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.text import spread
from panelforge.plans.lineage import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The usual splitting pattern of byte-level BPE of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
KNOTS = 64
DOCS_PER_BUCKET = 20_000


def source_key(c: Column | str) -> Column:
    """A source's spellings come together: lower case, one ``_`` for what stands between words."""
    c = F.col(c) if isinstance(c, str) else c
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(key != "", key)


def with_tokens(docs: DataFrame, keep: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``tokens BIGINT``, the size of the whole text (0 for null)."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            pdf["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf.pop("__text")]
            yield pdf

    return spread(docs.select(*keep, F.col(text).alias("__text"))).mapInPandas(count, schema + ", tokens bigint")


@dataclass
class Curriculum:
    """Cumulative demand of one source at KNOTS + 1 even times from 0 to 1."""

    demand: np.ndarray  # tokens
    supply: float  # tokens, all repeats together

    def time_of(self, tokens: np.ndarray) -> np.ndarray:
        """Time at which the cumulative demand reaches a number of tokens; beyond the last, 1."""
        t = np.linspace(0, 1, len(self.demand))
        d, first = np.unique(self.demand, return_index=True)
        return np.interp(tokens, d, t[first], right=1.0) if len(d) > 1 else np.ones_like(tokens, dtype=float)

    @property
    def ends(self) -> float:
        """Time at which the cumulative demand reaches the supply; 1 if it lasts to the end."""
        return float(self.time_of(np.array([self.supply]))[0])

    @property
    def reached(self) -> float:
        return float(min(self.supply, self.demand[-1]))


def schedule(shares: dict[str, float], tilt: dict[str, float] | None = None) -> dict[str, np.ndarray]:
    """Cumulative weight of each source over time; at the end it is the source's share.

    ``tilt`` in [-1, 1] moves a source towards the end (positive) or the beginning of
    training: its weight runs linearly from ``1 - tilt`` to ``1 + tilt`` times its share.
    """
    t = np.linspace(0, 1, KNOTS + 1)
    return {s: share * ((1 - (k := (tilt or {}).get(s, 0.0))) * t + k * t * t) for s, share in shares.items()}


def curricula(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int, tilt: dict[str, float] | None = None) -> dict[str, Curriculum]:
    weights = schedule({s: share for s, (share, _) in targets.items()}, tilt)
    return {s: Curriculum(w * total, float(sizes.get(s, 0)) * targets[s][1]) for s, w in weights.items()}


def plan(sized: DataFrame, targets: DataFrame, tilt: dict[str, float] | None = None) -> tuple[dict[str, Curriculum], dict[str, int], dict[str, tuple[float, int]], int]:
    """Curricula for a mixture as large as all documents together.

    Only the targets (a stated, small table: one row per source) and one total per
    source come to the driver.
    """
    wanted = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in targets.select(source_key("source"), "target_share", "max_repeats").collect() if r[0] is not None}
    sums = sized.groupBy("src").agg(F.sum("tokens").alias("t"))
    total = sums.agg(F.sum("t")).first()[0] or 0
    sizes = {r[0]: int(r[1]) for r in sums.where(F.col("src").isin(*wanted)).collect()}
    return curricula(sizes, wanted, int(total), tilt), sizes, wanted, int(total)


def report(spark, curs: dict[str, Curriculum], sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> DataFrame:
    """Per source: target and reached share, tokens, uses, and the time its supply ends."""
    rows = [
        (s, t[0], c.reached / total if total else 0.0, sizes.get(s, 0), c.reached / sizes[s] if sizes.get(s) else 0.0, c.ends, c.ends < 1.0)
        for s, t in targets.items() for c in [curs[s]]
    ]
    return spark.createDataFrame(rows, "source string, target_share double, reached_share double, source_tokens bigint, uses double, supply_ends double, short boolean")


def mixture(sized: DataFrame, curs: dict[str, Curriculum], sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int, doc_id: str = "doc_id", seed: int = 5) -> DataFrame:
    """Documents of the mixture with their training positions, sorted by position.

    Returns ``position (tokens from the start), doc_id, source, copy, tokens``. A
    document is in the mixture as often as its token intervals begin before the
    source's demand or supply is used up. Running sums are taken in two levels,
    buckets and documents in a bucket, so a source with most of the rows is spread.
    """
    spark = sized.sparkSession
    docs = sized.where(F.col("tokens") > 0).where(F.col("src").isin(*targets)).withColumn("h", F.xxhash64(doc_id, F.lit(seed)))
    n = docs.count()
    buckets = max(1, -(-n // DOCS_PER_BUCKET))
    # buckets are ranges of h: the order of documents does not depend on how many there are
    docs = cut(docs.withColumn("b", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets).cast("int")))
    ahead = docs.groupBy("src", "b").agg(F.sum("tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    w = Window.partitionBy("src", "b").orderBy("h", doc_id, "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inner", F.coalesce(F.sum("tokens").over(w), F.lit(0))).join(ahead, ["src", "b"]).withColumn("at", F.col("inner") + F.col("before"))
    limit = spark.createDataFrame([(s, float(curs[s].reached), int(sizes.get(s, 0))) for s in targets], "src string, reach double, size bigint")
    copies = placed.join(F.broadcast(limit), "src").where("at < reach").withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("reach") - F.col("at")) / F.col("size")).cast("int") - 1))))
    copies = copies.withColumn("from", F.col("at") + F.col("copy") * F.col("size")).where("from < reach")

    @F.pandas_udf("double")
    def position(src: pd.Series, start: pd.Series) -> pd.Series:
        out = np.zeros(len(src))
        for s in src.unique():
            m = (src == s).to_numpy()
            out[m] = curs[s].time_of(start.to_numpy(dtype=float)[m]) * total
        return pd.Series(out)

    mixed = copies.select(position("src", "from").alias("position"), F.col(doc_id).alias("doc_id"), F.col("src").alias("source"), F.col("copy").cast("int").alias("copy"), "tokens")
    return mixed.orderBy("position", "doc_id", "copy")
