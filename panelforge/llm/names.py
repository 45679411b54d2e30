"""Variant spellings of names typed by people: noisy-channel attribution.

What the channel does is learned from the table itself; only legal forms are a stated
list. Words that stand beside many different rare words are common words; what is
left of a name without its legal form and its common words is its core (all words, if
nothing would be left). A common word that often takes the place of a more frequent one
on the same core, the other words being equal, is another writing of that one; less
often will do where it abbreviates it letter by letter. Of a name's common words,
those that come and go on the same core while the others stay are additions (regions,
units); the others are its trade. Whole trades are compared like words once more.

Spellings are thus reduced to units (core, trade) and counted before anything else.
Frequent units, and those a registry names, are the candidate canonical forms: their
logarithmic frequency is the prior. A unit is drawn from a canonical one by typing
errors in the core, at a rate estimated from the table, and by leaving out the trade;
it is attached to the canonical form of greatest posterior, if that beats the
hypothesis of a name of its own. The channel makes at most two errors (one in a core
under eight letters); pairs so near are all found, as they share a core with so many
letters left out, and no others ever meet.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import LOOKALIKES, strip_marks
from panelforge.operators.components import components
from panelforge.plans.lineage import cut

# Words that say nothing about which company it is.
LEGAL = frozenset(
    "INC INCORPORATED CORP CORPORATION CORPN CO COMPANY LTD LIMITED LLC LLP LP GMBH MBH GESELLSCHAFT BV NV KK AG OY OYJ AB AS APS SARL SAS SA SPA SRL PLC PTE PRIVATE PVT PTY KG KGAA SE ULC THE".split()
)
_DIGITS = str.maketrans("0158", "OISB")
MIN_CORE = 6

LEXICON_SHARE = 0.001  # a common word stands beside at least this share of the spellings as different rare words (and beside three)
LEAST_HEADS = 3
KNOWN = 1000  # what the registry's word counts for, in names seen
ADDED = 0.1  # share of its places from which an addition can be taken away
DOUBT = 5  # cores of contrary evidence that a word or trade brings along, as being one of its own
SAME, SAME_SHORT = 0.4, 0.1  # share of evidence from which one is another writing of another; if it abbreviates it letter by letter

EDIT_RATE = 0.01  # typing errors per name to begin with
LOG_OWN = math.log(1e-7)  # a new company whose core lands within reach of another's
TAIL = 5  # a name without a trade must keep the last letters of its core


def letters(name: str) -> list[str]:
    """Upper-case words: no accents, digits read as the letters they stand for, dotted and spaced forms joined."""
    s = strip_marks(name.translate(LOOKALIKES)).upper()
    s = re.sub(r"[.'’`/&-]", "", s)
    s = re.sub(r"[^A-Z0-9,]+", " ", s)
    if "," in s:
        parts = [p.split() for p in s.split(",")]
        named = [p for p in parts if any(w not in LEGAL for w in p)]
        if len(named) > 1:  # surname-first: what follows the comma comes first
            named = named[1:] + named[:1]
        ws = [w for p in named for w in p] + [w for p in parts if p not in named for w in p]
    else:
        ws = s.split()
    out: list[str] = []
    run = ""
    for w in [*ws, ""]:
        if len(w) == 1 and w.isalpha():
            run += w
            continue
        if run:
            out.append(run)
            run = ""
        if w:
            out.append(w.translate(_DIGITS) if not w.isdigit() else w)
    return out


def words_of(name: str) -> list[str]:
    """Words of a name without its legal form; all of them, if it has no others."""
    ws = letters(name)
    return [w for w in ws if w not in LEGAL] or ws


def readings_of(ws: list[str], common: frozenset[str] | set[str]) -> list[tuple[str, list[str]]]:
    """Readings of a name's words as (core, common words), the likeliest first.

    A name of common words only is its own core. Where words are run together, common
    words are taken off the core's two ends in every way.
    """
    if not ws:
        return []
    core, rest = "".join(w for w in ws if w not in common), [w for w in ws if w in common]
    if not core:
        return [("".join(ws), [])]
    out = [(core, rest)]
    fronts = [(core, [])] + [(core[k:], [core[:k]]) for k in range(3, len(core) - MIN_CORE + 1) if core[:k] in common]
    for c, front in fronts:
        if front:
            out.append((c, front + rest))
        level = [(c, [])] if not rest else []
        while level:
            level = [(x[:k], [x[k:], *tail]) for x, tail in level for k in range(max(MIN_CORE, len(x) - 20), len(x) - 1) if x[k:] in common]
            out += [(x, front + tail) for x, tail in level]
    return out


def abbreviates(short: str, long: str) -> bool:
    """Letters of ``long`` left out, the first one kept."""
    if not short or len(short) >= len(long) or short[0] != long[0]:
        return False
    at = iter(long)
    return all(c in at for c in short)


def deletions(core: str, upto: int = 2) -> set[str]:
    """The core and all strings left when up to ``upto`` letters are taken out (one, if it is short)."""
    k = upto if len(core) >= 8 else 1
    return {"".join(c for i, c in enumerate(core) if i not in gone) for n in range(k + 1) for gone in combinations(range(len(core)), n)}


def edits(a: str, b: str) -> int:
    """Edit distance with transpositions (optimal string alignment)."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
    return row[-1]


def log_likelihood(core: str, trade: str, of_core: str, of_trade: str, n: int, log_edit: float, log_dropped: float) -> float:
    """log P(unit | canonical unit) at ``n`` typing errors; -inf where the channel cannot make one of the other."""
    if trade and of_trade and trade != of_trade:
        return -math.inf
    if n > 2 or (n == 2 and min(len(core), len(of_core)) < 8):
        return -math.inf
    if n and not (trade and of_trade) and core[-TAIL:] != of_core[-TAIL:]:
        return -math.inf
    return n * log_edit + (log_dropped if trade != of_trade else 0.0)


def spelled(names: DataFrame, name: str) -> DataFrame:
    """``spelling, n, ws``: distinct spellings (upper case, trimmed), counted, with their words."""
    counted = names.where(F.col(name).isNotNull()).groupBy(F.upper(F.trim(name)).alias("spelling")).agg(F.count("*").alias("n"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(ws=[words_of(s) for s in pdf["spelling"]])

    return counted.mapInPandas(read, "spelling string, n bigint, ws array<string>")


def common_words(spellings: DataFrame, guide: DataFrame) -> set[str]:
    """Words that stand beside many different rare words.

    The rare word of a name is one that the registry's names have as theirs, else its
    least frequent (of several the longest). A registry's word counts as three. A word
    must reach ``LEXICON_SHARE`` of the spellings, so there are at most a few thousand
    common words at any size of the table (three times a name's words, divided by the
    share), and they may come to the driver.
    """
    both = cut(spellings.select("spelling", "ws", F.lit(0).alias("g")).unionByName(guide.select("spelling", "ws", F.lit(1).alias("g"))))
    words = both.select("spelling", "g", F.explode(F.array_distinct("ws")).alias("w"))
    df = cut(words.groupBy("w").agg(F.count("*").alias("df")))
    placed = cut(words.join(df, "w"))
    rare = F.struct((-F.col("df")).alias("f"), F.length("w").alias("l"), "w")
    known = placed.where("g = 1").groupBy("spelling").agg(F.max(rare)["w"].alias("w")).select("w").distinct().withColumn("known", F.lit(1))
    named = placed.where("g = 0").join(known, "w", "left").select("spelling", "w", "df", F.coalesce("known", F.lit(0)).alias("known"))
    head = F.max(F.struct("known", rare.alias("r")))
    heads = named.groupBy("spelling").agg(head.alias("h")).select("spelling", F.col("h.r.w").alias("head"), F.col("h.known").alias("head_known"))
    beside = named.where("known = 0").join(heads, "spelling").where("w <> head").groupBy("w", "head").agg(F.max("head_known").alias("k"))
    least = max(LEAST_HEADS, math.ceil(LEXICON_SHARE * spellings.count()))
    return {r["w"] for r in beside.groupBy("w").agg(F.sum(1 + 2 * F.col("k")).alias("n")).where(F.col("n") >= least).collect()}


def read_names(spellings: DataFrame, common: set[str]) -> DataFrame:
    """``spelling, n, core, rest, reading``: every reading of every spelling."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, n, c, t, k) for s, n, ws in zip(pdf["spelling"], pdf["n"], pdf["ws"]) for k, (c, t) in enumerate(readings_of(list(ws), common))]
            yield pd.DataFrame(rows, columns=["spelling", "n", "core", "rest", "reading"])

    return spellings.select("spelling", "n", "ws").mapInPandas(read, "spelling string, n bigint, core string, rest array<string>, reading int")


def same_writing(co: int, cores: int, form: bool) -> bool:
    """Whether a word or trade on ``cores`` cores, in the other's place on ``co`` of them, is another writing of it."""
    if form and co:
        return co >= SAME_SHORT * cores
    return (co + DOUBT * form) / (cores + DOUBT) >= (0.5 if form else SAME)


def word_roots(forms: DataFrame) -> dict[str, str]:
    """Common words that are other writings of more frequent ones, with those.

    ``forms``: distinct ``core, rest``, of cores in several spellings. Words meet where
    one takes the other's place on the same core and all other words are equal. The
    result is a part of the (bounded) common words.
    """
    words = cut(forms.select("core", F.explode(F.array_distinct("rest")).alias("w")).groupBy("w").agg(F.countDistinct("core").alias("cores")))
    places = forms.select("core", "rest", F.posexplode("rest").alias("i", "w")).select("core", F.array_join(F.transform("rest", lambda x, j: F.when(j == F.col("i"), "*").otherwise(x)), " ").alias("place"), "w").distinct()
    places = cut(places.join(words, "w"))
    other = places.select("core", "place", F.col("w").alias("root"), F.col("cores").alias("root_cores"))
    above = (F.col("root_cores") > F.col("cores")) | ((F.col("root_cores") == F.col("cores")) & (F.col("root") > F.col("w")))
    together = places.join(other, ["core", "place"]).where("w <> root").where(above).groupBy("w", "root", "cores").agg(F.countDistinct("core").alias("co"))
    found = together.collect()  # pairs of common words
    short = sorted({r["w"] for r in words.collect()})
    cores = {r["w"]: r["cores"] for r in words.collect()}
    co = {(r["w"], r["root"]): r["co"] for r in found}
    for w in short:
        for r in short:
            if abbreviates(w, r) and (cores[r], r) > (cores[w], w):
                co.setdefault((w, r), 0)
    best: dict[str, tuple] = {}
    for (w, r), n in co.items():
        form = abbreviates(w, r)
        if same_writing(n, cores[w], form):
            best[w] = max(best.get(w, (-1,)), (n, cores[r], r))
    roots = {w: x[-1] for w, x in best.items()}
    for w in roots:
        while roots[w] in roots:
            roots[w] = roots[roots[w]]
    return roots


def additions(forms: DataFrame) -> set[str]:
    """Common words that come and go on the same core while its other common words stay.

    ``forms``: distinct ``core, rest``, of cores in several spellings. Each word is taken
    away from each form that has others; the share of forms in which that gives another
    form of the core decides.
    """
    text = F.array_join("rest", " ")
    held = forms.select("core", text.alias("t"), F.lit(1).alias("there")).distinct()
    at = F.posexplode("rest").alias("i", "w")
    less = forms.where(F.size("rest") >= 2).select("core", "rest", at).select("core", "w", F.array_join(F.concat(F.slice("rest", 1, F.col("i")), F.slice("rest", F.col("i") + 2, F.size("rest"))), " ").alias("t"))
    found = less.join(held, ["core", "t"], "left").groupBy("w").agg(F.count("*").alias("n"), F.count("there").alias("k"))
    return {r["w"] for r in found.where(F.col("k") >= F.greatest(F.lit(1), ADDED * F.col("n"))).collect()}  # a part of the common words


def rewritten(rows: DataFrame, roots: dict[str, str], added: set[str] = frozenset()) -> DataFrame:
    """Rows with the words of ``rest`` in their most frequent writing, without additions."""
    schema = rows.schema

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(rest=[[w for w in (roots.get(x, x) for x in rest) if w not in added] for rest in pdf["rest"]])

    return rows.mapInPandas(write, schema)


def trade_roots(forms: DataFrame) -> DataFrame:
    """``trade, root``: of each trade the writing it is a variant of, where that is another one.

    ``forms``: distinct ``core, trade, n`` (spellings). Evidence are cores in several
    spellings: the more of a trade's cores also carry a more frequent trade, the likelier
    it is another writing of it; an abbreviation letter by letter brings evidence with it.
    Candidates for roots are trades on at least half of ``LEXICON_SHARE`` of all cores,
    which bounds their number at any size of the table.
    """
    told = forms.where("trade <> ''")
    several = forms.groupBy("core").agg(F.sum("n").alias("m")).where("m >= 2").select("core")
    heads = cut(told.groupBy("trade").agg(F.countDistinct("core").alias("heads")))
    least = 0.5 * LEXICON_SHARE * (forms.agg(F.countDistinct("core")).first()[0] or 0)
    roots = heads.where(F.col("heads") >= least)
    seen = told.join(several, "core", "left_semi").select("core", "trade")
    alone = seen.groupBy("trade").agg(F.countDistinct("core").alias("cores"))
    big = seen.join(roots.select("trade"), "trade", "left_semi").select("core", F.col("trade").alias("root"))
    together = seen.join(big, "core").where("trade <> root").groupBy("trade", "root").agg(F.countDistinct("core").alias("co"))
    shipped = sorted((r["trade"], r["heads"]) for r in roots.collect())

    def short_for(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, r) for t in pdf["trade"] for r, _ in shipped if abbreviates(t, r)]
            yield pd.DataFrame(rows, columns=["trade", "root"])

    forms_of = heads.select("trade").mapInPandas(short_for, "trade string, root string").withColumn("form", F.lit(1))
    c = together.join(forms_of, ["trade", "root"], "full").join(alone, "trade", "left").join(heads, "trade").join(roots.select(F.col("trade").alias("root"), F.col("heads").alias("root_heads")), "root")
    count, cores = F.coalesce("co", F.lit(0)), F.coalesce("cores", F.lit(0))
    enough = F.when(F.col("form").isNotNull() & (count > 0), count >= SAME_SHORT * cores).when(F.col("form").isNotNull(), DOUBT / (cores + DOUBT) >= 0.5).otherwise(count / (cores + DOUBT) >= SAME)
    c = c.where(enough & ((F.col("root_heads") > F.col("heads")) | ((F.col("root_heads") == F.col("heads")) & (F.length("root") > F.length("trade")))))
    one = cut(c.groupBy("trade").agg(F.max_by("root", F.struct(F.coalesce("co", F.lit(0)).alias("co"), "root_heads", "root")).alias("root")))
    # a root may itself be a writing of another one; each step leads to a more frequent trade
    for _ in range(3):
        up = one.select(F.col("trade").alias("root"), F.col("root").alias("top"))
        one = cut(one.join(up, "root", "left").select("trade", F.coalesce("top", "root").alias("root")))
    return one


def attribute(names: DataFrame, name: str, guide: DataFrame) -> DataFrame:
    """``spelling, entity``: the class of every distinct spelling (upper case, trimmed).

    ``guide`` has ``company BIGINT, prefix STRING``: names a registry knows for a
    company (names known to belong to another one carry an id of their own); they
    raise the prior of a form, tie a company's brands together and keep forms known
    for different companies apart.
    Null names and names without letters or figures have no entity; an empty table
    gives no rows; repeated rows raise the frequency of a spelling.
    """
    spellings, prefixes = cut(spelled(names, name)), cut(spelled(guide, "prefix"))
    common = common_words(spellings, prefixes)
    readings = cut(read_names(spellings, common))
    told = cut(read_names(prefixes, common).where("reading = 0").join(guide.select(F.upper(F.trim("prefix")).alias("spelling"), "company").where("company is not null"), "spelling").select("core", "rest", "company").distinct())
    # prior: how often a core is read as it stands, and whether the registry has it
    guided = cut(told.groupBy("core").agg(F.min("company").alias("company"), F.lit(KNOWN).alias("known")))
    seen = readings.where("reading = 0").groupBy("core").agg(F.sum("n").alias("n"))
    by_core = seen.join(guided.select("core", "known"), "core", "full").select("core", (F.coalesce("n", F.lit(0)) + F.coalesce("known", F.lit(0))).alias("weight"))
    # a spelling's reading: the one whose core is best known, then the first; of readings nobody else uses, the most reduced one is the likelier
    several = readings.groupBy("spelling").agg(F.max("reading").alias("last"))
    scored = readings.join(several.where("last > 0"), "spelling").join(by_core, "core", "left").withColumn(
        "rank", F.when((F.col("reading") == 0) & (F.col("weight") < KNOWN), F.lit(0)).otherwise(F.coalesce("weight", F.lit(0)))
    )
    best = scored.groupBy("spelling").agg(F.max_by(F.struct("core", "rest"), F.struct("rank", "reading")).alias("u"))
    read = cut(readings.where("reading = 0").join(best, "spelling", "left").select("spelling", F.coalesce("u.core", "core").alias("core"), F.coalesce("u.rest", "rest").alias("rest"), "n"))

    several = cut(read.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core"))
    roots: dict[str, str] = {}
    for _ in range(2):  # forms brought to one writing of a word show more of the next one's
        forms = cut(rewritten(read.join(several, "core", "left_semi").select("core", "rest"), roots).distinct())
        fresh = word_roots(forms)
        roots = {w: fresh.get(r, r) for w, r in roots.items()} | fresh
    forms = rewritten(read.join(several, "core", "left_semi").select("core", "rest"), roots).distinct()
    added = additions(forms)
    trade = F.array_join("rest", "").alias("trade")
    phrased = cut(rewritten(read, roots, added).select("spelling", "core", trade, "n"))
    word, roots = roots, trade_roots(phrased.groupBy("core", "trade").agg(F.count("*").alias("n")))
    unit_of = cut(phrased.join(roots, "trade", "left").select("spelling", "core", F.coalesce("root", "trade").alias("trade"), "n"))
    known = cut(rewritten(told, word, added).select("core", trade, "company").join(roots, "trade", "left").select("core", F.coalesce("root", "trade").alias("trade"), "company").distinct())
    units = unit_of.select("core", "trade", "n").unionByName(known.select("core", "trade").distinct().withColumn("n", F.lit(0).cast("bigint"))).groupBy("core", "trade").agg(F.sum("n").alias("n"))
    units = cut(
        units.join(guided, "core", "left").select("core", "trade", "company", "n", (F.col("n") + F.coalesce("known", F.lit(0))).alias("weight"), F.xxhash64("core", "trade").alias("id"))
    )
    edges = attach(units)
    # brands of one company are one entity: of each of its cores the unit whose trade the registry names, else whose trade the company has on most cores, then most often
    own = units.drop("company").join(known.groupBy("company", "core").agg(F.collect_set("trade").alias("named")), "core")  # names of one company in the registry
    often = own.groupBy("company", "trade").agg(F.struct(F.countDistinct(F.when(F.col("n") > 0, F.col("core"))).alias("cores"), F.sum("n").alias("n")).alias("often"))
    rank = F.struct(((F.col("trade") != "") & F.array_contains("named", F.col("trade"))).alias("told"), (F.col("n") > 0).alias("seen"), "often", "weight", F.length("trade"), "id")
    heads = cut(own.join(often, ["company", "trade"]).groupBy("company", "core").agg(F.max_by("id", rank).alias("head")))
    first = heads.groupBy("company").agg(F.min("head").alias("first"))
    brands = heads.join(first, "company").select(F.col("head").alias("a"), F.col("first").alias("b"))
    # forms that only the registry has stand for their core
    unseen = known.where("trade = ''").join(units.where("n = 0").select("core", "trade", "id"), ["core", "trade"]).join(heads, ["company", "core"]).select(F.col("id").alias("a"), F.col("head").alias("b"))
    brands = brands.unionByName(unseen)
    loops = units.select(F.col("id").alias("a"), F.col("id").alias("b"))
    parts = components(edges.unionByName(brands).unionByName(loops), "a", "b")
    return unit_of.join(units.select("core", "trade", "id"), ["core", "trade"]).join(parts, F.col("id") == F.col("node")).select("spelling", F.col("component").alias("entity"))


def near_cores(units: DataFrame) -> DataFrame:
    """``core, of_core, edits``: all pairs of cores that share a core with letters left out, and each with itself.

    The shortened cores are made once and written; both sides of the join read them.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                rows = [(c, xxhash.xxh3_64_intdigest(d) - 2**63) for c in pdf["core"].iloc[lo : lo + 500] for d in deletions(c)]
                yield pd.DataFrame(rows, columns=["core", "key"]).astype({"key": "int64"})

    tasks = 2 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = cut(units.select("core").distinct().repartition(tasks, "core").mapInPandas(spread, "core string, key bigint"))
    # most shortened cores belong to one core only and go no further
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    few = cut(keys.join(shared, "key", "left_semi"))
    pairs = few.join(few.select(F.col("core").alias("of_core"), "key"), "key").where("core < of_core").select("core", "of_core").distinct()

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y) for x, y in zip(a, b)], dtype="int32")

    # the plain distance, two for a transposition, is at most four here and tells most pairs without Python
    plain = cut(pairs.withColumn("lev", F.levenshtein("core", "of_core")).where("lev <= 4"))
    sure, rest = plain.where("lev <= 1").withColumn("edits", F.col("lev")), plain.where("lev > 1").withColumn("edits", apart("core", "of_core")).where("edits <= 2")
    near = cut(sure.unionByName(rest).select("core", "of_core", "edits"))
    same = units.select("core", F.col("core").alias("of_core"), F.lit(0).alias("edits")).distinct()
    return near.unionByName(near.select(F.col("of_core").alias("core"), F.col("core").alias("of_core"), "edits")).unionByName(same)


def attach(units: DataFrame) -> DataFrame:
    """``a, b``: each unit and the canonical unit of its greatest posterior, where that beats a name of its own.

    A unit is attached only to one with a greater prior (ties by id), so the links form
    trees; forms that only the registry has are attached to none. The rates of typing errors and of dropped trades are estimated once from the
    attachments made with the rates to begin with, then everything is attached anew.
    """
    target = units.select(F.col("core").alias("of_core"), F.col("trade").alias("of_trade"), F.col("weight").alias("of_weight"), F.col("id").alias("of_id"), F.col("company").alias("of_company"))
    pairs = units.where("n > 0").join(near_cores(units), "core").join(target, "of_core").where("id <> of_id").where("of_weight > weight or (of_weight = weight and of_id < id)")
    pairs = cut(pairs.where("company is null or of_company is null or company = of_company").select("id", "core", "trade", "n", "of_core", "of_trade", "of_weight", "of_id", "edits"))

    def links(rate: float, dropped: float) -> DataFrame:
        log_edit, log_dropped = math.log(rate), math.log(dropped)

        @F.pandas_udf("double")
        def channel(core: pd.Series, trade: pd.Series, of_core: pd.Series, of_trade: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([log_likelihood(*x, log_edit, log_dropped) for x in zip(core, trade, of_core, of_trade, n)], dtype=float)

        posterior = channel("core", "trade", "of_core", "of_trade", "edits") + F.log(F.col("of_weight").cast("double") + 1)
        scored = pairs.withColumn("post", posterior).where(F.col("post") > LOG_OWN)
        return scored.groupBy("id").agg(F.max_by(F.struct("of_id", "edits", (F.col("trade") != F.col("of_trade")).alias("dropped"), "n"), F.struct("post", "of_weight", "of_id")).alias("b"))

    said = links(EDIT_RATE, 0.2).agg(F.sum("b.n").alias("n"), F.sum(F.col("b.n") * F.col("b.edits")).alias("e"), F.sum(F.when(F.col("b.dropped"), F.col("b.n")).otherwise(0)).alias("d")).first()
    total = (units.agg(F.sum("n")).first()[0] or 0) + 100
    rate, dropped = ((said["e"] or 0) + 100 * EDIT_RATE) / total, ((said["d"] or 0) + 20) / total
    return links(min(rate, 0.05), min(dropped, 0.5)).select(F.col("id").alias("a"), F.col("b.of_id").alias("b"))
