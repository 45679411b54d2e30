"""Names to entities by ordered prefix rules; audits; moves between entities.

Rules are rows ``ord INT, ticker, kind (match, exclude, include), prefix, reason``; a
trailing ``%`` of a prefix is ignored and letter case does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


RULES = "ord int, ticker string, kind string, prefix string, reason string"
MOVES = "rule int, from_ticker string, to_ticker string, effective date, prefix string, reason string"


def _clean(rules: DataFrame) -> DataFrame:
    return rules.withColumn("prefix", F.upper(F.rtrim(F.col("prefix"), F.lit("%"))))


def prefix_hits(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (name, rule) whose prefix begins the name: an equi-join on the prefix per length.

    The number of different prefix lengths is at most the longest prefix, so a name
    is repeated a few times instead of being compared with every rule.
    """
    r = _clean(rules).withColumn("len", F.length("prefix"))
    lengths = [x[0] for x in r.select("len").distinct().orderBy("len").collect()]  # at most one row per length of a prefix
    n = names.withColumn("len", F.explode(F.array(*[F.lit(x) for x in lengths]) if lengths else F.array().cast("array<int>")))
    n = n.where(F.length("name") >= F.col("len")).withColumn("prefix", F.upper(F.expr("substr(name, 1, len)")))
    return n.join(r, ["len", "prefix"]).drop("len")


def route(names: DataFrame, rules: DataFrame) -> DataFrame:
    """``name, ticker, excluded, reason`` of distinct names.

    The first matching entity in rule order wins; its exclusions, and its list of
    allowed prefixes if it has one, are then applied to it alone: an excluded name
    goes to no later entity. Names without a match come out with a NULL ticker; null
    names are left aside.
    """
    distinct = names.where("name is not null").select("name").distinct()
    hits = prefix_hits(distinct, rules)
    won = hits.where("kind = 'match'").groupBy("name").agg(F.min_by("ticker", "ord").alias("ticker"))
    side = hits.where("kind <> 'match'").select("name", "ticker", "kind", "ord", "prefix", "reason")
    ruled = won.join(side, ["name", "ticker"], "left").groupBy("name", "ticker").agg(
        F.min_by(F.concat(F.lit("excluded by "), F.col("prefix"), F.lit(": "), F.col("reason")), F.when(F.col("kind") == "exclude", F.col("ord"))).alias("why"),
        F.max(F.coalesce(F.col("kind") == "exclude", F.lit(False))).alias("hit_exclude"), F.max(F.coalesce(F.col("kind") == "include", F.lit(False))).alias("hit_include"),
    )
    listed = rules.where("kind = 'include'").select("ticker").distinct().withColumn("has_list", F.lit(True))
    out = ruled.join(listed, "ticker", "left")
    not_allowed = F.coalesce("has_list", F.lit(False)) & ~F.col("hit_include")
    out = out.select("name", "ticker", (F.col("hit_exclude") | not_allowed).alias("excluded"), F.when(F.col("hit_exclude"), F.col("why")).when(not_allowed, "not in entity allowlist").otherwise("").alias("reason"))
    return distinct.join(out, "name", "left").select("name", "ticker", F.coalesce("excluded", F.lit(False)).alias("excluded"), F.coalesce("reason", F.lit("")).alias("reason"))


def assign(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with ``ticker`` (NULL if none or excluded) and ``excluded_ticker``; names are classified once each."""
    r = route(events, rules)
    return events.drop("ticker").join(r, "name", "left").withColumn("excluded_ticker", F.when(F.col("excluded"), F.col("ticker"))).withColumn("ticker", F.when(~F.col("excluded"), F.col("ticker"))).drop("excluded")


def audit(assigned: DataFrame, review_at: int = 20) -> DataFrame:
    """Distinct applications per section, ticker and name; large matched names are to be reviewed."""
    section = F.when(F.col("ticker").isNotNull(), "matched").when(F.col("excluded_ticker").isNotNull(), "excluded")
    g = assigned.where(section.isNotNull()).groupBy(section.alias("section"), F.coalesce("ticker", "excluded_ticker").alias("ticker"), F.col("name").alias("harmonized_name"), "reason").agg(F.countDistinct("application").alias("application_count"))
    return g.withColumn("review_status", F.when((F.col("section") == "matched") & (F.col("application_count") >= review_at), "REVIEW").otherwise(""))


def reattribute(events: DataFrame, moves: DataFrame, filing: str = "filing") -> DataFrame:
    """Events after all moves, with ``moved``: the rules that moved each, in order.

    Rules run by effective date on the ticker as it then stands, so chains compose;
    a NULL target drops the event. The rules are a stated list, folded into one
    expression: no join, no shuffle. Events without a filing date never move.
    """
    rules = [r.asDict() for r in moves.orderBy("effective", "rule").collect()]  # the rule list itself
    ticker, gone, moved = F.col("ticker"), F.lit(False), F.array().cast("array<int>")
    out = events.withColumn("__t", ticker).withColumn("__gone", gone).withColumn("moved", moved)
    for r in rules:
        hit = (F.col("__t") == r["from_ticker"]) & ~F.col("__gone") & (F.col(filing) >= F.lit(r["effective"]))
        if r["prefix"]:
            hit = hit & F.upper(F.coalesce("name", F.lit(""))).startswith(r["prefix"].rstrip("%").upper())
        hit = F.coalesce(hit, F.lit(False))
        out = out.select(
            *[c for c in out.columns if c not in ("__t", "__gone", "moved")],
            F.when(hit & F.lit(r["to_ticker"] is not None), F.lit(r["to_ticker"])).otherwise(F.col("__t")).alias("__t"),
            (F.col("__gone") | (hit & F.lit(r["to_ticker"] is None))).alias("__gone"),
            F.when(hit, F.array_append("moved", F.lit(r["rule"]))).otherwise(F.col("moved")).alias("moved"),
        )
    return out.withColumn("ticker", F.col("__t")).withColumn("dropped", F.col("__gone")).drop("__t", "__gone")


def move_log(reattributed: DataFrame, moves: DataFrame) -> DataFrame:
    """Distinct applications moved (or dropped) per rule, rules without any included."""
    n = reattributed.select("application", F.explode("moved").alias("rule")).groupBy("rule").agg(F.countDistinct("application").alias("applications_moved"))
    return moves.join(n, "rule", "left").select("rule", "from_ticker", F.coalesce("to_ticker", F.lit("DROPPED")).alias("to_ticker"), "effective", F.coalesce("applications_moved", F.lit(0)).alias("applications_moved"), "reason")


def override(rows: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with ``fields`` replaced where an override of the same key has them, and ``overridden``.

    Several overrides of a key: the greatest non-null value per field. A null key is
    never overridden.
    """
    o = overrides.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(f).alias(f"__{f}") for f in fields]).withColumn("__hit", F.lit(True))
    j = rows.join(o, key, "left")
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns]
    return j.select(*kept, F.coalesce("__hit", F.lit(False)).alias("overridden"))


__all__ = ["RULES", "MOVES", "override", "prefix_hits", "route", "assign", "audit", "reattribute", "move_log"]
