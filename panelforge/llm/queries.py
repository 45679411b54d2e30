"""Queries of the training-data problems (1, 5, 8, 9, 10) and their check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.dates import is_filled, parse_date
from panelforge.llm import leakage, mixing, names, spam, survivor
from panelforge.operators.components import components
from panelforge.plans.lineage import cut
from panelforge.plans.oracle_text import sql_date, sql_filled
from panelforge.session import table

# ------------------------------------------------------- 1: surviving records

PATENT_FIELDS = ["assignee_org", "publication_date", "grant_date", "priority_date"]
REGISTRY_FIELDS = ["label", "delisted", "first_fin_quarter", "last_fin_quarter"]
DATE_FIELDS = {"publication_date", "grant_date", "priority_date"}


def patent_key(patent_id: str, country: str) -> Column:
    """Office, series and number of a patent number in any writing; NULL without a number."""
    plain = F.translate(F.upper(F.col(patent_id)), " -/,.", "")  # the usual separators cost no pattern
    s = F.when(plain.rlike("[^A-Z0-9]"), F.regexp_replace(plain, "[^A-Z0-9]", "")).otherwise(plain)
    office = F.upper(F.trim(F.col(country)))
    office = F.coalesce(F.when(office != "", office), F.when(s.rlike("^(US|EP|KR|WO|JP|CN|DE|FR|GB|TW|CA|AU)"), F.substring(s, 1, 2)), F.lit("?"))
    rest = F.when(s.startswith(office), F.substr(s, F.length(office) + 1)).otherwise(s)
    key = F.concat_ws("|", office, F.regexp_replace(rest, r"^([A-Z]*)0*([0-9]+)(?:[A-Z][0-9]{0,2})?$", "$1|$2"))
    return F.when(is_filled(patent_id) & (s != ""), key)


def ciks_of(c: Column | str) -> Column:
    """Numbers of a list in any writing, fillers of one repeated digit left out."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract_all(F.regexp_replace(c, r"(\d)\.0+(?!\d)", "$1"), F.lit(r"(\d+)"), F.lit(1))
    bare = F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.array_distinct(F.filter(bare, lambda x: ~x.rlike(r"^(\d)\1*$")))


def registry_groups(registry: DataFrame) -> DataFrame:
    """``registry_id, company``: rows that share a CIK, directly or through other rows.

    Rows and CIKs are the two kinds of nodes, so a CIK shared by many rows brings one
    edge per row and no pairs.
    """
    rows = registry.select("registry_id", ciks_of("ciks").alias("cs"))
    row_node = F.col("registry_id") * 2
    # a number of any length is a node by itself; beyond seventeen digits by its 62-bit hash
    number = F.coalesce(F.when(F.length("c") <= 17, F.col("c").try_cast("bigint")), F.bitwise_not(F.shiftrightunsigned(F.xxhash64("c"), 2)))
    edges = rows.select(row_node.alias("a"), F.explode("cs").alias("c")).select("a", (number * 2 + 1).alias("b"))
    edges = edges.unionByName(rows.select(row_node.alias("a"), row_node.alias("b")))
    return components(edges, "a", "b").where("node % 2 = 0").select((F.col("node") / 2).cast("bigint").alias("registry_id"), F.col("component").alias("company"))


def _filled(field: str) -> Column:
    ok = is_filled(field) & (parse_date(field).isNotNull() if field in DATE_FIELDS else F.lit(True))
    return F.when(ok, F.col(field))


def _ranked(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows with ``rank``, the trust rank of their provider; unknown providers are trusted least."""
    r = ranks.groupBy(F.lower(F.trim("provider")).alias("__p")).agg(F.min("trust_rank").alias("__r"))
    return rows.join(r, F.lower(F.trim("provider")) == F.col("__p"), "left").withColumn("rank", F.coalesce("__r", F.lit(1000))).drop("__p", "__r")


def _survivors(spark: SparkSession, d: str, which: str, lead: bool) -> DataFrame:
    ranks = table(spark, d, "provider_rank")
    if which == "patent_records":
        rows, key, fields = table(spark, d, which).withColumn("grp", patent_key("patent_id", "country_code")), "record_id", PATENT_FIELDS
    else:
        r = table(spark, d, which)
        wanted = r.select("registry_id", "provider", "retrieved_at", *REGISTRY_FIELDS)
        rows, key, fields = wanted.join(registry_groups(r), "registry_id").withColumn("grp", F.col("company").cast("string")), "registry_id", REGISTRY_FIELDS
    rows = _ranked(rows, ranks)
    priority = [(-F.col("rank")).alias("trust"), F.col("retrieved_at")]
    # where trust leads only rows are asked for: that a field is filled is all that need travel
    values = {f: F.when(_filled(f).isNotNull(), F.lit("")) if lead else _filled(f) for f in fields}
    got = survivor.survivors(rows, "grp", key, values, priority, 1.0 / F.col("rank"), lead)
    return got.withColumn("source_table", F.lit(which)).withColumnRenamed("row_id", "record_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Survivors by trust, then recency, which leave a consensus nothing to decide: none is sought here, but in p1_consensus."""
    both = _survivors(spark, d, "patent_records", True).unionByName(_survivors(spark, d, "universe_registry", True))
    return both.select("source_table", "field_name", "record_id")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Survivors by weighted majority: a row's vote is the inverse of its provider's rank."""
    both = _survivors(spark, d, "patent_records", False).unionByName(_survivors(spark, d, "universe_registry", False))
    return both.select("source_table", "field_name", "record_id", "value", "n_values")


def _p1_sql() -> str:
    s = "upper(regexp_replace(patent_id, '[^A-Za-z0-9]', '', 'g'))"
    rest = f"CASE WHEN starts_with({s}, country_code) THEN substr({s}, length(country_code) + 1) ELSE {s} END"

    def pick(source: str, key: str, field: str) -> str:
        ok = sql_filled(field) + (f" AND {sql_date(field)} IS NOT NULL" if field in DATE_FIELDS else "")
        return f"""SELECT '{source}' AS source_table, '{field}' AS field_name, {key} AS record_id FROM (
SELECT {key}, row_number() OVER (PARTITION BY g ORDER BY trust_rank, retrieved_at DESC, {key}) AS k FROM {'pg' if source == 'patent_records' else 'rg'}
WHERE g IN (SELECT g FROM {'pg' if source == 'patent_records' else 'rg'} GROUP BY g HAVING count(*) > 1) AND {ok}) WHERE k = 1"""

    parts = [pick("patent_records", "record_id", f) for f in PATENT_FIELDS] + [pick("universe_registry", "registry_id", f) for f in REGISTRY_FIELDS]
    return f"""
WITH RECURSIVE pg AS (SELECT p.*, r.trust_rank, country_code || '|' || regexp_replace({rest}, '^([A-Z]*)0*([0-9]+)([A-Z][0-9]{{0,2}})?$', '\\1|\\2') AS g
  FROM patent_records p LEFT JOIN provider_rank r ON r.provider = p.provider WHERE {sql_filled('patent_id')}),
c AS (SELECT registry_id, unnest(list_transform(regexp_extract_all(regexp_replace(ciks, '\\.0+([^0-9]|$)', '\\1', 'g'), '[0-9]+'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR))) AS cik FROM universe_registry),
e AS (SELECT DISTINCT * FROM c WHERE length(replace(cik, cik[1], '')) > 0),
n AS (SELECT DISTINCT a.registry_id AS a, b.registry_id AS b FROM e a JOIN e b USING (cik)),
w(a, b) AS (SELECT registry_id, registry_id FROM universe_registry UNION SELECT w.a, n.b FROM w JOIN n ON n.a = w.b),
m AS (SELECT a AS registry_id, min(b) AS g FROM w GROUP BY a),
rg AS (SELECT u.*, m.g, r.trust_rank FROM universe_registry u JOIN m USING (registry_id) LEFT JOIN provider_rank r ON r.provider = u.provider)
""" + "\nUNION ALL ".join(parts)


# ----------------------------------------------------------- 5: names as typed


def name_guide(registry: DataFrame) -> DataFrame:
    """``company, prefix`` of the registry, its labels being names too; excluded names carry an id of their own."""

    def listed(col: str) -> Column:
        return F.explode(F.split(F.col(col), ";"))

    groups = cut(registry_groups(registry))
    own = registry.select("registry_id", "assignee_prefixes", "label").join(groups, "registry_id")
    own = own.select("company", listed("assignee_prefixes").alias("prefix")).unionByName(own.select("company", F.col("label").alias("prefix")))
    other = registry.select(listed("exclusions").alias("prefix"))
    rows = own.unionByName(other.select((-F.abs(F.xxhash64(F.upper(F.trim("prefix"))) / 2).cast("bigint") - 1).alias("company"), "prefix"))
    return rows.select("company", F.regexp_replace("prefix", "%", "").alias("prefix")).where(is_filled("prefix")).distinct()


def audit_entities(spark: SparkSession, d: str) -> DataFrame:
    audit = table(spark, d, "assignee_match_audit")
    classes = names.attribute(audit, "harmonized_name", name_guide(table(spark, d, "universe_registry")))
    return cut(audit.select("audit_id", F.upper(F.trim("harmonized_name")).alias("spelling")).join(classes, "spelling").select("audit_id", "entity"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs asked for; the classes themselves are p5_classes."""
    e = audit_entities(spark, d)
    a, b = e.select(F.col("audit_id").alias("audit_id_a"), "entity"), e.select(F.col("audit_id").alias("audit_id_b"), "entity")
    return a.join(b, "entity").where("audit_id_a < audit_id_b").select("audit_id_a", "audit_id_b")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per row of the table: its class (the class's smallest row id); rows without a name are their own."""
    e = audit_entities(spark, d)
    classes = e.join(e.groupBy("entity").agg(F.min("audit_id").alias("class_id")), "entity").select("audit_id", "class_id")
    return table(spark, d, "assignee_match_audit").select("audit_id").join(classes, "audit_id", "left").select("audit_id", F.coalesce("class_id", "audit_id").alias("class_id"))


# ---------------------------------------------------------------- 8: leakage


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Items leaked: number of documents and the largest share found."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("share"), 6).alias("largest_share"))


# ----------------------------------------------------------------- 9: mixing


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", mixing.source_key("source").alias("src"))
    return cut(mixing.with_tokens(docs, ["doc_id", "src"], "text"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    curs, sizes, targets, total = mixing.plan(_sized(spark, d), table(spark, d, "mix_targets"))
    return mixing.report(spark, curs, sizes, targets, total)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).where("short").select("source")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: every copy of a document with its training position."""
    sized = _sized(spark, d)
    curs, sizes, targets, total = mixing.plan(sized, table(spark, d, "mix_targets"), TILT)
    return mixing.mixture(sized, curs, sizes, targets, total)


# Web pages fade out and filings and memos come in towards the end of training.
TILT = {"crawl_page": -0.5, "filing_note": 0.4, "research_memo": 0.3}

# ------------------------------------------------------------------ 10: spam


def p10_pages(spark: SparkSession, d: str) -> DataFrame:
    got = spam.label_pages(table(spark, d, "documents"))
    return got.select("doc_id", "n_words", F.round("non_prose_share", 6).alias("non_prose_share"), "kind", "flagged")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.label_pages(table(spark, d, "documents")).where("flagged").select("doc_id").distinct()


QUERIES = {q.__name__: q for q in (p1_found, p1_consensus, p5_found, p5_classes, p8_found, p8_items, p9_found, p9_report, p9_mixture, p10_found, p10_pages)}
ORACLE = {"p1_found": _p1_sql()}
