"""Filed facts to bitemporal observations: period matching, restatements, fourth quarters, cross-checks."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.lineage import cut

TOLERANCE_DAYS = 5
DAY_SLACK = 10


def duration_class(start: str, end: str) -> Column:
    days = F.datediff(end, start)
    return F.when(days.between(70, 100), "quarter").when(days.between(340, 380), "annual")


def valid_facts(facts: DataFrame) -> DataFrame:
    """Facts with both ends and a value, of quarter or year length, with their ``kind``."""
    f = facts.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("val").isNotNull() & ~F.isnan("val"))
    return f.withColumn("kind", duration_class("start", "end")).where("kind is not null")


def filings_by_period(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Facts brought down to one row per period (as written) and tag, before anything is joined.

    ``a``/``z``: first and last filing with ``a_at``/``z_at`` (date, then accession); ``days``:
    the distinct dates of filing (calendar-bounded). A group with very many facts
    costs one partial aggregate per task.
    """
    at = F.struct("filed", "accn")
    return facts.groupBy(*keys, "start", "end", "tag_idx").agg(
        F.min_by(F.struct("val", "filed", "form", "fiscal_label", "tag", "start", "end"), at).alias("a"), F.min(at).alias("a_at"),
        F.max_by(F.struct("val", "filed"), at).alias("z"), F.max(at).alias("z_at"), F.collect_set("filed").alias("days"),
    )


def cluster_periods(filings: DataFrame, keys: list[str], tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """Rows of :func:`filings_by_period` with ``cluster``: periods whose ends lie within the tolerance of their neighbour's.

    Distinct ends are clustered, not facts, so a group brings at most one row per
    calendar day to the window. Clusters whose starts or ends spread beyond the
    tolerance depend on the order of arrival; they are resolved exactly by an ordered
    fold over the cluster's distinct periods (a handful), in which a period joins the
    first earlier one within the tolerance at both ends.
    """
    periods = filings.groupBy(*keys, "start", "end").agg(F.min(F.struct("tag_idx", F.col("a_at.filed").alias("filed"), F.col("a_at.accn").alias("accn"))).alias("first_seen"))
    ends = periods.select(*keys, "end").distinct()
    w = Window.partitionBy(*keys).orderBy("end")
    gap = F.coalesce(F.datediff("end", F.lag("end").over(w)) > tolerance, F.lit(True))
    islands = ends.withColumn("g", gap.cast("int")).withColumn("island", F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("g")
    placed = periods.join(islands, [*keys, "end"])
    per = placed.groupBy(*keys, "island").agg(
        (F.datediff(F.max("start"), F.min("start")) <= tolerance).alias("tight_s"), (F.datediff(F.max("end"), F.min("end")) <= tolerance).alias("tight_e"),
        F.sort_array(F.collect_list(F.struct("first_seen", "start", "end"))).alias("ps"),  # distinct periods around one boundary
    )

    @F.pandas_udf("array<int>")
    def fold(starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for ss, ee in zip(starts, ends):
            firsts: list[tuple] = []
            got = []
            for s, e in zip(ss, ee):
                at = next((k for k, (a, b) in enumerate(firsts) if abs((a - s).days) <= tolerance and abs((b - e).days) <= tolerance), None)
                if at is None:
                    firsts.append((s, e))
                    at = len(firsts) - 1
                got.append(at)
            out.append(got)
        return pd.Series(out)

    tight = per.where("tight_s and tight_e").select(*keys, "island", "ps", F.transform("ps", lambda x: F.lit(0)).alias("part"))
    loose = per.where("not (tight_s and tight_e)").select(*keys, "island", "ps", fold(F.transform("ps", lambda x: x["start"]), F.transform("ps", lambda x: x["end"])).alias("part"))
    parts = tight.unionByName(loose).select(*keys, "island", F.explode(F.arrays_zip("ps", "part")).alias("x")).select(*keys, F.col("x.ps.start").alias("start"), F.col("x.ps.end").alias("end"), F.concat_ws("-", "island", "x.part").alias("cluster"))
    return filings.join(parts, [*keys, "start", "end"])


def collapse_filings(filings: DataFrame, keys: list[str]) -> DataFrame:
    """One observation per period cluster: the tag of highest priority, first and latest filing.

    ``filings`` come from :func:`cluster_periods`. The first filing (by date, then
    accession) gives value, form and label, the last one the latest value; dates of
    filing are counted once. The period's ends are those of the first fact seen.
    """
    tags = filings.groupBy(*keys, "cluster", "tag_idx").agg(
        F.min_by("a", "a_at").alias("a"), F.max_by("z", "z_at").alias("z"), F.size(F.array_distinct(F.flatten(F.collect_list("days")))).cast("bigint").alias("n_filings")
    )
    g = tags.groupBy(*keys, "cluster").agg(F.min_by(F.struct("a", "z", "n_filings"), "tag_idx").alias("b")).select(*keys, "b.*")
    return g.select(
        *keys, F.col("a.tag").alias("tag"), F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.col("a.val").alias("value"), F.col("a.filed").alias("filed"),
        F.col("z.val").alias("value_latest"), F.col("z.filed").alias("filed_latest"), "n_filings", F.col("a.form").alias("form"), F.col("a.fiscal_label").alias("fiscal_label"),
    )


def extract_observations(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Quarterly and annual observations of all entities and concepts in one pass."""
    f = valid_facts(facts)
    k = [*keys, "kind"]
    return collapse_filings(cluster_periods(cut(filings_by_period(f, k)), k), k)


def tag_provenance(observations: DataFrame, keys: list[str]) -> DataFrame:
    return observations.groupBy(*keys, "tag").agg(F.count("*").alias("n_periods"), F.min("end").alias("first_end"), F.max("end").alias("last_end"))


def derive_q4(observations: DataFrame, keys: list[str], nonnegative: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Fourth quarters as the year less three quarters: (series with derived quarters, checks).

    Quarters lie inside the year with ten days of slack; one that ends with the year
    is a directly filed fourth quarter. With exactly three others the quarter is
    derived, known when the last component is, and replaces the direct one, which
    only serves as a check; otherwise a direct one stays. ``nonnegative`` says for
    which rows a negative result is implausible.
    """
    years = observations.where("kind = 'annual'").select(*keys, F.struct("start", "end", "value", "value_latest", "filed", "filed_latest", "n_filings", "form", "fiscal_label", "tag").alias("y"))
    quarters = observations.where("kind = 'quarter'").select(*keys, F.struct("start", "end", "value", "value_latest", "filed", "filed_latest").alias("q"))
    # an equi key on the calendar year a period may lie in keeps the range join from meeting all pairs
    y = years.withColumn("yr", F.explode(F.sequence(F.year(F.date_sub("y.start", DAY_SLACK)), F.year(F.date_add("y.end", DAY_SLACK)))))
    inside = y.join(quarters.withColumn("yr", F.year("q.end")), [*keys, "yr"]).where((F.col("q.start") >= F.date_sub("y.start", DAY_SLACK)) & (F.col("q.end") <= F.date_add("y.end", DAY_SLACK)))
    found = inside.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct(F.col("q.end").alias("e"), "q"))).alias("qs"))  # quarters of one year: a few
    none = f"array<{found.schema['qs'].dataType.elementType['q'].dataType.simpleString()}>"
    base = years.join(found, [*keys, "y"], "left").withColumn("qs", F.coalesce(F.transform("qs", lambda x: x["q"]), F.array().cast(none)))
    last = F.try_element_at("qs", F.lit(-1))
    direct = F.coalesce(F.abs(F.datediff(last["end"], F.col("y.end"))) <= TOLERANCE_DAYS, F.lit(False))
    base = base.withColumn("direct", F.when(direct, last)).withColumn("early", F.when(direct, F.slice("qs", 1, F.greatest(F.size("qs") - 1, F.lit(0)))).otherwise(F.col("qs")))
    ok = F.size("early") == 3

    def total(field: str) -> Column:
        return F.aggregate("early", F.lit(0.0), lambda a, x: a + x[field])

    def latest(field: str) -> Column:
        return F.greatest(F.col(f"y.{field}"), F.array_max(F.transform("early", lambda x: x[field])))

    d = base.withColumn("value", F.when(ok, F.col("y.value") - total("value"))).withColumn("value_latest", F.when(ok, F.col("y.value_latest") - total("value_latest")))
    siblings = F.array_max(F.transform("early", lambda x: F.abs(x["value"])))
    deviation = F.when(F.col("direct").isNotNull() & (F.col("value_latest") != 0), 100.0 * (F.col("direct.value_latest") - F.col("value_latest")) / F.abs("value_latest"))
    negative = (nonnegative if nonnegative is not None else F.lit(False)) & (F.col("value") < 0)
    status = (
        F.when(~ok, F.concat(F.lit("cannot derive: "), F.size("early").cast("string"), F.lit(" early quarters"), F.when(F.col("direct").isNotNull(), ", direct quarter kept").otherwise("")))
        .when(negative, "derived quarter is negative").when((siblings > 0) & (F.abs("value") > 3 * siblings), "derived quarter is implausibly large")
        .when(F.abs(deviation) > 0.5, "direct quarter deviates").otherwise("ok")
    )
    checks = d.select(*keys, F.col("y.start").alias("fy_start"), F.col("y.end").alias("fy_end"), F.col("y.value").alias("fy_value"), F.size("qs").alias("n_quarters_found"), ok.alias("derived"), F.when(ok, deviation).alias("deviation_pct"), status.alias("status"))
    derived = d.where(ok).select(
        *keys, F.lit("quarter").alias("kind"), F.col("y.tag").alias("tag"), F.date_add(F.try_element_at("early", F.lit(3))["end"], 1).alias("start"), F.col("y.end").alias("end"), "value", latest("filed").alias("filed"),
        "value_latest", latest("filed_latest").alias("filed_latest"), F.col("y.n_filings").alias("n_filings"), F.concat(F.lit("derived("), F.col("y.form"), F.lit(")")).alias("form"), F.col("y.fiscal_label").alias("fiscal_label"), F.lit(True).alias("derived_q4"),
    )
    replaced = d.where(ok & F.col("direct").isNotNull()).select(*keys, F.col("direct.start").alias("start"), F.col("direct.end").alias("end"))
    kept = observations.where("kind = 'quarter'").join(replaced, [*keys, "start", "end"], "left_anti").withColumn("derived_q4", F.lit(False))
    return kept.unionByName(derived), checks


def nearest_period_check(ours: DataFrame, theirs: DataFrame, keys: list[str], tolerance_pct: float = 2.0, match_days: int = 7) -> DataFrame:
    """Second-source values against our latest ones, by the nearest period end within ``match_days``.

    Ties go to the earlier end. Ends are looked up through two-week bins, so the
    nearest-match join stays an equi-join. Rows of the second source without a match
    are kept with a status; entities we do not hold at all are left aside.
    """
    width = 2 * match_days
    bin_of = F.floor(F.datediff("end", F.lit("1970-01-01").cast("date")) / width)
    o = ours.select(*keys, F.col("end").alias("our_end"), "value_latest", bin_of.alias("bin"))
    t = theirs.select(*keys, F.col("end").alias("their_end"), F.col("value").alias("their_value"), bin_of.alias("b")).withColumn("row", F.struct(*keys, "their_end", "their_value"))
    near = t.withColumn("bin", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).join(o, [*keys, "bin"]).withColumn("gap", F.abs(F.datediff("our_end", "their_end"))).where(F.col("gap") <= match_days)
    best = near.groupBy("row").agg(F.min(F.struct("gap", "our_end", "value_latest")).alias("m"))
    held = t.join(ours.select(*keys).distinct(), keys, "left_semi")
    j = held.join(best, "row", "left").select(*keys, "their_end", "their_value", F.col("m.our_end").alias("our_end"), F.col("m.value_latest").alias("our_value"))
    pct = F.when(F.col("our_value") != 0, 100.0 * (F.col("their_value") - F.col("our_value")) / F.col("our_value"))
    status = F.when(F.col("our_end").isNull(), "no quarter within the window").when(F.abs(pct) <= tolerance_pct, "ok").otherwise("MISMATCH")
    return j.withColumn("pct_diff", pct).withColumn("status", status)


def parse_companyfacts(files: DataFrame, text: str = "value") -> DataFrame:
    """Facts of nested filings documents (one JSON text per row) as flat rows, malformed ones skipped."""
    fact = "struct<start:string,end:string,val:double,filed:string,form:string,fy:int,fp:string,accn:string>"
    doc = F.from_json(text, f"struct<cik:bigint,facts:map<string,map<string,struct<units:map<string,array<{fact}>>>>>>")
    d = files.select(doc.alias("d")).where("d.facts is not null")
    tags = d.select(F.col("d.cik").alias("cik"), F.explode("d.facts").alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "body"))
    units = tags.select("cik", "taxonomy", "tag", F.explode("body.units").alias("unit", "entries"))
    return units.select("cik", "taxonomy", "tag", "unit", F.explode("entries").alias("f")).select("cik", "taxonomy", "tag", "unit", "f.*")


def candidate_tags(facts: DataFrame) -> DataFrame:
    """Tags that may carry revenue where the mapped ones do not."""
    t = F.upper("tag")
    return facts.where(t.contains("REVENUE") | t.startswith("SALES")).select("cik", "tag").distinct()


__all__ = ["duration_class", "valid_facts", "cluster_periods", "collapse_filings", "extract_observations", "tag_provenance", "derive_q4", "nearest_period_check", "parse_companyfacts", "candidate_tags"]
