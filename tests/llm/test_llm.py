"""Training-data operators: edge cases, brute force, held-out accuracy, skew paths."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import leakage, mixing, names, queries, spam, survivor, text
from tests.oracle import canon, connect

TS = dt.datetime


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    con = connect(sf)
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert canon(got) == canon(want)


# ------------------------------------------------------------------ survivor

ROW = "id bigint, grp string, v string, rank int, at timestamp, value string"


def survive(spark, data, lead=True):
    df = spark.createDataFrame(data, ROW)
    got = survivor.survivors(df, "grp", "id", {"v": F.col("v"), "w": F.lit(None).cast("string")}, [(-F.col("rank")).alias("trust"), F.col("at")], 1.0 / F.col("rank"), lead)
    return {r.grp: (r.row_id, r.value) for r in got.collect()}


def test_survivor_cases(spark):
    t = [TS(2020, 1, d) for d in range(1, 9)]
    data = [(1, "a", "x", 2, t[0], "q"), (2, "a", "y", 1, t[1], "q"), (3, "a", "z", 1, t[2], "q"), (4, "a", None, 1, t[5], "q"), (5, "solo", "x", 1, t[0], "q"), (6, None, "x", 1, t[0], "q"), (7, None, "x", 1, t[0], "q"), (8, "e", None, 1, t[0], "q"), (9, "e", None, 1, t[0], "q"), (11, "tie", "x", 1, t[0], "q"), (10, "tie", "x", 1, t[0], "q"), (12, "nul", "x", 1, None, "q"), (13, "nul", "y", 1, t[0], "q"), (14, "empty", "", 1, t[0], "q"), (15, "empty", "!!", 1, t[1], "q")]
    assert survive(spark, data) == {"a": (3, "z"), "tie": (10, "x"), "nul": (13, "y"), "empty": (15, "!!")}
    assert survive(spark, []) == {}


def test_consensus_votes_by_token(spark):
    t = TS(2020, 1, 1)
    data = [(1, "a", "ACME LOGIC INC", 1, t, ""), (2, "a", "ACME LOGIC", 1, t, ""), (3, "a", "ACMEE LOGIC INC", 1, t, ""), (4, "a", "THE ACME LOGIC INC", 1, t, "")]
    assert survive(spark, data, lead=False) == {"a": (1, "ACME LOGIC INC")}


def test_large_groups_by_blocks(spark, monkeypatch):
    """Groups beyond a block give what one block gives, with trust leading or not."""
    rng = random.Random(1)
    base = "ALPHA BETA GAMMA DELTA EPSILON".split()
    data = []
    for i in range(300):
        ws = base.copy()
        if rng.random() < 0.5:
            ws[rng.randrange(5)] = f"W{i}"
        data.append((i, "hot", " ".join(ws), 1 + rng.randrange(4), TS(2020, 1, 1) + dt.timedelta(minutes=i), ""))
    whole = [survive(spark, data, lead) for lead in (True, False)]
    monkeypatch.setattr(survivor, "BLOCK", 12)
    assert [survive(spark, data, lead) for lead in (True, False)] == whole
    assert whole[1]["hot"][1] == " ".join(base)


def test_blocks_decide_nothing(spark, monkeypatch):
    """Random values of few tokens, where every tie and gap counts: the same survivor however the work is cut."""
    rng = random.Random(6)
    data, k = [], 0
    for g in range(60):
        for _ in range(8):
            k += 1
            data.append((k, f"g{g}", " ".join(rng.choice("ABCDE") for _ in range(rng.randrange(1, 6))), 1 + rng.randrange(4), TS(2020, 1, 1) + dt.timedelta(minutes=k), ""))
    whole = survive(spark, data, False)
    for size in (7, 3, 1):
        monkeypatch.setattr(survivor, "BLOCK", size)
        assert survive(spark, data, False) == whole


def test_consensus_beats_the_weightiest_row(spark):
    """The row of greatest weight is outvoted token by token."""
    t = TS(2020, 1, 1)
    data = [(1, "a", "ACNE LOGIC GMBH", 1, t, ""), (2, "a", "ACME LOGIC INC", 2, t, ""), (3, "a", "ACME LOGIK INC", 2, t, ""), (4, "a", "ACME POWER INC", 2, t, "")]
    assert survive(spark, data, lead=False) == {"a": (2, "ACME LOGIC INC")} and survive(spark, data, lead=True) == {"a": (1, "ACNE LOGIC GMBH")}


def test_lead_needs_no_votes(spark):
    """Trust and recency alone decide, whatever a vote would be: ranks of zero and below, whose inverse is none or negative."""
    rng = random.Random(3)
    data = [(i, f"g{rng.randrange(40)}" if i % 3 else "hot", rng.choice([None, "A", "A B", "B C", "!!"]), rng.randrange(-2, 4), rng.choice([None, TS(2020, 1, 1), TS(2020, 1, 2)]), "") for i in range(240)]
    want = {}
    for g in {r[1] for r in data}:
        group = [r for r in data if r[1] == g]
        if len(group) > 1 and any(r[2] for r in group):
            best = min((r for r in group if r[2]), key=lambda r: (r[3], -(r[4] or TS(1970, 1, 1)).timestamp(), r[0]))
            want[g] = (best[0], best[2])
    assert survive(spark, data) == want


def test_p1_found_runs_no_consensus(spark, sf):
    """Its rows are settled by trust and recency: neither votes nor alignments are computed."""
    plans = {n: queries.QUERIES[n](spark, sf)._jdf.queryExecution().optimizedPlan().toString() for n in ("p1_found", "p1_consensus")}
    assert "MapInPandas" not in plans["p1_found"] and "MapInPandas" in plans["p1_consensus"]


def test_order_of_a_source_does_not_depend_on_buckets(spark, monkeypatch):
    sized = spark.createDataFrame([(i, "a", 1 + i % 7) for i in range(300)], "doc_id bigint, src string, tokens bigint")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    curs = mixing.plan(sized, t)
    whole = rows(mixing.mixture(sized, *curs))
    monkeypatch.setattr(mixing, "DOCS_PER_BUCKET", 13)
    assert rows(mixing.mixture(sized, *curs)) == whole


def test_long_ciks_are_nodes_too(spark):
    long = "1234567890123456789012345"
    df = spark.createDataFrame([(1, long), (2, f"CIK{long}; 78"), (3, "0000000078"), (4, None), (5, "1234567890123456789012346"), (6, "")], "registry_id bigint, ciks string")
    got = {r.registry_id: r.company for r in queries.registry_groups(df).collect()}
    assert len(got) == 6 and got[1] == got[2] == got[3] != got[5] and got[4] != got[6] != got[1]


def test_align_to():
    a = "A B C D".split()
    assert survivor.align_to(a, a) == [(i + 1, 0, x) for i, x in enumerate(a)]
    assert survivor.align_to(a, "A X C".split()) == [(1, 0, "A"), (2, 0, "X"), (3, 0, "C"), (4, 0, "")]
    assert survivor.align_to(a, "Q R A B C D".split())[:3] == [(0, 1, "Q"), (0, 2, "R"), (1, 0, "A")]
    assert survivor.align_to([], ["A"]) == [(0, 1, "A")] and survivor.align_to(["A"], []) == [(1, 0, "")]


def test_patent_key(spark):
    same = ["US400360947B1", " US-400360947-B2 ", "US 400,360,947 B1", "US0400360947A", "400360947", "US/400360947", "us400360947b1"]
    df = spark.createDataFrame([(s, "US") for s in same] + [("USRE400360947E", "US"), ("RE400,360,947E", "US"), ("400360947", "EP"), (None, "US"), ("N/A", "US"), (" ", "US")], "p string, c string")
    got = [r[0] for r in df.select(queries.patent_key("p", "c")).collect()]
    assert len(set(got[:7])) == 1 and got[7] == got[8] != got[0] and got[9] != got[0] and got[10:] == [None] * 3


def test_ciks(spark):
    df = spark.createDataFrame([('"7000000|0007000001"',), ("CIK0007000024;0000000000",), ("7000082.0",), ("7000837, 7000838.0",), ("0",), ("9999999999",), (None,)], "c string")
    got = [r[0] for r in df.select(queries.ciks_of("c")).collect()]
    assert got == [["7000000", "7000001"], ["7000024"], ["7000082"], ["7000837", "7000838"], [], [], None]


# --------------------------------------------------------------------- names


def entity_of(spark, listed, guide=()):
    df = spark.createDataFrame([(n,) for n in listed], "name string")
    g = spark.createDataFrame(list(guide), "company bigint, prefix string")
    return {r.spelling: r.entity for r in names.attribute(df, "name", g).collect()}


def test_names_link_and_keep_apart(spark):
    one = ["HYRAFEWIMOOR PHOTONICS INC", "HYRAFEWIMOOR PHOTONICS INC", "Hyrafewimoor Phot Inc.", "PHOTONICS, HYRAFEWIMOOR, INC.", "HYRSFEWIMOOR PHOTONICS INC", "THE HYRAFEWIMOOR PHOTONICS COMPANY", "HYRAFEWIMOOR PHOT TAIWAN INCORPORATED", "HYRAFEWIMOORPHOTONICS I.N.C.", "HYRAFEWI-MOOR PHOTONICS", "HYRAFEW1M00R PHOTONICS", "GALCONAZINEL LTD"]
    other = ["HYRAFEWIMUMA GMBH", "HYRAFEWIMOOR FOODS"]
    got = entity_of(spark, [*one, *other, "HYRAFEWIMOOR FOODS OY", None, "", "---"], [(1, "HYRAFEWIMOOR"), (1, "GALCONAZINEL"), (None, "X")])
    key = lambda n: got[n.upper()]
    assert len({key(n) for n in one}) == 1 and len({key(n) for n in [one[0], *other]}) == 3
    assert key("HYRAFEWIMOOR FOODS") == key("HYRAFEWIMOOR FOODS OY") and "" not in got and "---" not in got


def test_names_of_common_words_stay_apart(spark):
    """Nothing but common words: each name is its own core, whatever the table has learned about its words."""
    listed = ["APPLIED MATERIALS INC", "ADVANCED MATERIALS INC", "UNITED MATERIALS", "TAIWAN SEMICONDUCTOR MANUFACTURING CO", "CHINA SEMICONDUCTOR MANUFACTURING CO", "GLOBAL RESEARCH HOLDINGS", "THE COMPANY LTD"]
    listed += [f"{w} {k}LOREMIPSUMA MATERIALS" for k in "BCDFGHJKLMNP" for w in ("APPLIED", "ADVANCED", "UNITED")] + [f"{k}DOLORSITAME SEMICONDUCTOR {w}" for k in "BCDFGHJK" for w in ("TAIWAN", "CHINA", "MANUFACTURING")]
    got = entity_of(spark, listed)
    assert len(got) == len(set(listed)) and len({got[n] for n in listed[:7]}) == 7


def test_abbreviations_are_learned(spark):
    """Neither the trades nor their short forms, one of them without a letter in order, are known beforehand."""
    rng = random.Random(4)
    cores = ["".join(rng.choice("BDFGKLMNPRSTVZ") + rng.choice("AEIOU") for _ in range(6)) for _ in range(40)]
    trades = [("HYDRAULICS", "HYDR"), ("CARTONNAGE", "KTNG"), ("BREWERIES", "BRW"), ("OPTOMETRY", "OPTM")]
    listed, owner = [], {}
    for i, c in enumerate(cores):
        full, short = trades[i % 4]
        for n in (f"{c} {full} LTD", f"{c} {short} LTD", f"{short}, {c} INC", f"{c} {full} PERU LTD"):
            owner[n] = i
        if i % 5 == 0:
            owner[f"{c} {trades[(i // 5 + 1 + i) % 4][0]} OY"] = -1 - i if (i // 5 + 1) % 4 else i
    listed = list(owner)
    got = entity_of(spark, listed)
    pairs = [(a, b) for i, a in enumerate(listed) for b in listed[:i]]
    true, found = {x for x in pairs if owner[x[0]] == owner[x[1]]}, {x for x in pairs if got[x[0]] == got[x[1]]}
    assert len(true & found) >= 0.99 * len(true) and len(true & found) >= 0.99 * len(found)


def test_classes_have_a_row_per_row(spark, sf):
    n = queries.table(spark, sf, "assignee_match_audit").count()
    c = queries.p5_classes(spark, sf)
    assert c.count() == n == c.select("audit_id").distinct().count() and c.where("class_id is null").count() == 0


def test_names_empty(spark):
    assert entity_of(spark, [], []) == {}


def test_edits_and_deletions():
    assert names.edits("ABCD", "ABDC") == 1 and names.edits("ABCD", "AXYD") == 2 and names.edits("", "AB") == 2
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("ABCDEF") for _ in range(10))
        b = list(a)
        for _ in range(2):
            i = rng.randrange(len(b))
            kind = rng.randrange(3)
            b = b[:i] + b[i + 1 :] if kind == 0 else b[:i] + [rng.choice("ABCDEF")] + b[i + (kind == 1) :]
        assert names.edits(a, "".join(b)) > 2 or len(b) < 8 or names.deletions(a) & names.deletions("".join(b))


# ------------------------------------------------------------------- leakage

W = [a + b for a in ("lor", "mek", "tas", "vun", "pil", "gro", "zet", "hob", "dra", "fik") for b in ("an", "ot", "ug", "ire", "elo", "una", "ax", "im", "os", "eth")]


def sentence(rng, n=16):
    return " ".join(rng.choice(W) for _ in range(n)).capitalize() + "."


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    stock = sentence(rng)
    items = {i: [sentence(rng) for _ in range(4)] for i in range(12)}
    texts = {i: " ".join(s + ([stock] if i % 3 == 0 else [])) for i, s in items.items()}
    filler = lambda k: " ".join(sentence(rng) for _ in range(k))
    docs, want = [(100, None), (101, ""), (102, filler(6)), (103, filler(2) + " " + stock)], set()
    for i, s in items.items():
        docs.append((i, f"{filler(2)} {texts[i]} {filler(1)}"))
        docs.append((20 + i, f"{s[3]} {filler(2)} <p>{s[1].upper()}</p> {filler(1)}"))  # half, in another order
        docs.append((40 + i, f"{filler(2)} {s[0]} {filler(2)}"))  # a quarter: a quotation
        words = " ".join(s).split()
        for k in range(5, len(words), 11):
            words[k] = "changed" if k % 2 else ""
        docs.append((60 + i, filler(1) + " " + " ".join(words).replace("o", "о")))  # altered and dropped words, a look-alike letter
        want |= {(i, i), (20 + i, i), (60 + i, i)}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(list(texts.items()), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, it).collect()}
    assert got == want
    own = leakage.own_words(texts)
    index = leakage.Index(own, leakage.Params())
    brute = {(k, i) for k, t in docs for i in own if index.share(i, leakage.word_ids(text.words(t)))[0] >= 0.5}
    assert brute == want
    assert leakage.leaks(d.limit(0), it).count() == 0 and leakage.leaks(d, it.limit(0)).count() == 0


def test_blocks_of_items_and_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(sentence(rng) for _ in range(3))) for i in range(9)]
    long = " ".join(sentence(rng) for _ in range(3000)) + " " + items[4][1]
    d, it = spark.createDataFrame([(1, long)], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert [tuple(r)[:2] for r in leakage.leaks(d, it).collect()] == [(1, 4)]
    monkeypatch.setattr(leakage, "MAX_BLOCK_WORDS", 60)
    assert [tuple(r)[:2] for r in leakage.leaks(d, it).collect()] == [(1, 4)]


def test_stock_sentences_across_blocks(spark, monkeypatch):
    """What an item's own words are does not depend on the size of a block; repeated ids keep all their texts."""
    rng = random.Random(13)
    stock, other = " ".join(sentence(rng) for _ in range(2)), sentence(rng, 40)
    items = [(i, f"{stock} {sentence(rng)}") for i in range(9)] + [(20, other), (20, other), (20, sentence(rng, 20))]
    d, it = spark.createDataFrame([(1, stock), (2, other)], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1_000_000, 30):
        monkeypatch.setattr(leakage, "MAX_BLOCK_WORDS", size)
        assert [tuple(r)[:2] for r in leakage.leaks(d, it).collect()] == [(2, 20)]


def test_lsh_recall():
    """Windows with one altered or dropped word are found by a key in at least nine of ten cases."""
    rng = random.Random(10)
    p = leakage.Params()
    e, hit = leakage.Embedder(p), 0
    for _ in range(300):
        ws = [rng.choice(W) for _ in range(24)]
        other = ws.copy()
        i = rng.randrange(24)
        other[i : i + 1] = [] if rng.random() < 0.5 else ["altered"]
        a, b = leakage.word_ids(ws), leakage.word_ids(other)
        ka, kb = e.keys(a, np.arange(24 - p.window + 1)), e.keys(b, np.arange(len(other) - p.window + 1))
        hit += bool(set(ka.ravel().tolist()) & set(kb.ravel().tolist()))
    assert hit >= 270


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert leakage.edit_distance(np.array(a), np.array(b)) == survivor.distance(a, b)


def substring_distance(a, doc):
    """Least word edit distance of a sequence to any stretch of the document, by a plain table."""
    row = [0] * (len(doc) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(doc):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def test_passages_after_a_reworded_opening():
    item, doc = np.arange(100), np.arange(100)
    doc[[k for k in range(30) if k % 5 >= 2]] += 1000  # two equal words, three altered ones
    for turned in (1, -1):  # an opening, then an ending
        got = leakage.passages(item[::turned], doc[::turned], leakage.Params())
        assert max(b - a for a, b in got) >= 70 and all(substring_distance(item[::turned][a:b].tolist(), doc[::turned].tolist()) <= 0.15 * (b - a) for a, b in got)


def test_passages_against_a_plain_table():
    """Every kept span is within the limit, and no verbatim or lightly altered stretch is lost whatever stands around it."""
    rng, p = random.Random(12), leakage.Params()
    for _ in range(60):
        item, doc, sure = list(range(60)), [], set()
        at = 0
        while at < 60:
            n = rng.randrange(8, 25)
            part, kind = item[at : at + n], rng.choice(("same", "light", "heavy"))
            if kind == "light" and len(part) >= 20:
                part[10] = 5000 + at
            if kind == "heavy":
                part = [x if k % 5 < 2 else 7000 + x for k, x in enumerate(part)]
            if kind != "heavy" and len(part) >= 8:
                sure |= set(range(at, at + len(part)))
            doc += part
            at += n
        doc = [9000 + k for k in range(5)] + doc
        got = leakage.passages(np.array(item), np.array(doc), p)
        assert all(substring_distance(item[a:b], doc) <= p.max_edit * (b - a) and b - a >= p.min_passage for a, b in got)
        assert sure <= {x for a, b in got for x in range(a, b)}


def test_passages_of_an_item_with_a_refrain():
    """A word pair that stands 60 times between the altered words of a passage breaks no chain."""
    item = [x for k in range(60) for x in (1, 2, 100 + 2 * k, 101 + 2 * k, 300 + k, 500 + k, 700 + k)]
    doc = [5000 + x if 700 <= x else x for x in item]  # every seventh word altered
    got = leakage.passages(np.array(item), np.array(doc), leakage.Params())
    assert sum(b - a for a, b in got) >= len(item) - 1


# -------------------------------------------------------------------- mixing

VOCAB = os.path.exists(mixing.TOKENIZER)


def test_source_key(spark):
    df = spark.createDataFrame([("Crawl Page",), (" crawl-page",), ("CRAWL_PAGE",), (None,), (" ",)], "s string")
    assert [r[0] for r in df.select(mixing.source_key("s")).collect()] == ["crawl_page"] * 3 + [None, None]


@pytest.mark.skipif(not VOCAB, reason="no vocabulary files")
def test_mixture_reaches_shares(spark):
    rng = random.Random(4)
    docs = [(i, "big" if i % 10 else "Small", " ".join(rng.choice(W) for _ in range(rng.randrange(5, 60)))) for i in range(3000)] + [(5000, None, "no source at all"), (5001, "big", None), (5002, "big", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("src", mixing.source_key("source"))
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 5), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    sized = mixing.with_tokens(d, ["doc_id", "src"], "text")
    curs, sizes, targets, total = mixing.plan(sized, t, {"small": 0.8})
    rep = {r.source: r for r in mixing.report(spark, curs, sizes, targets, total).collect()}
    assert not rep["small"].short and rep["none"].short and rep["none"].reached_share == 0 and abs(rep["big"].reached_share - 0.6) < 0.01
    mix = mixing.mixture(sized, curs, sizes, targets, total).toPandas()
    for s in ("big", "small"):
        got = mix[mix.source == s]
        assert abs(got.tokens.sum() / total - rep[s].reached_share) < 0.01
        assert got.groupby("doc_id").size().max() <= targets[s][1]
    assert mix.position.is_monotonic_increasing
    late = mix[mix.source == "small"].position.median() / total
    assert late > 0.55  # tilted to the end
    assert mixing.mixture(sized.limit(0), *mixing.plan(sized.limit(0), t)).count() == 0


@pytest.mark.skipif(not VOCAB, reason="no vocabulary files")
def test_token_counts_are_of_whole_texts(spark):
    import base64

    import tiktoken

    with open(mixing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for s in ("Hello, world! <|endoftext|>", "naïve Gerät  2024\n\n x" * 500):
        n = mixing.with_tokens(spark.createDataFrame([(1, s)], "doc_id bigint, text string"), ["doc_id"], "text").first().tokens
        assert n == len(enc.encode_ordinary(s)) and enc.decode(enc.encode_ordinary(s)) == s


# ---------------------------------------------------------------------- spam

PROSE = ["The quarterly report was filed after the period had closed, and the figures were not revised.", "Readers often ask why the new part costs more than the ones around it.", "In this example the voltage monitor shares one supply with the bus bridge.", "Die Erfindung betrifft eine Schaltung mit der sich der Strom für die Last regeln lässt.", "La solicitud describe un circuito que se usa para la medida de los datos en la red."]


def pages():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(PROSE) for _ in range(n))
    kw = ["cheap wafer", "wafer price", "buy wafer", "best wafer", "wafer forum"]
    spam_pages = [
        ", ".join(rng.choice(kw) for _ in range(60)), " ".join(rng.choice(kw) for _ in range(60)), " ".join("#" + rng.choice(kw).replace(" ", "") for _ in range(70)), "\n".join(f"* [{rng.choice(kw)}](http://x{i}.example/?p={i})" for i in range(30)),
        " ".join(f'<a href="http://x{i}.example/q">{rng.choice(kw)}</a>' for i in range(40)), "\n".join(f"https://x{i}.example/p/{i}" for i in range(40)), "Tags: " + " | ".join(rng.choice(kw).title() for _ in range(60)),
        "Looking for wafer price? Our wafer price is the best wafer price for wafer price buyers. " * 8, prose(2) + " " + ", ".join(rng.choice(kw) for _ in range(60)),
    ]
    fine = [prose(8), prose(6) + "\n" + "\n".join(f"2009Q{1 + i % 4}  {rng.randrange(4000)}  {rng.random() * 90:.1f}" for i in range(12)), "\n".join(f"<p>{prose(2)}</p>" for _ in range(4)), prose(7) + " See <a href='http://a.example'>the notes</a> and https://b.example/x for more.", prose(8) + " " + ", ".join(rng.choice(kw) for _ in range(10)), "wafer: a thin slice of silicon on which the circuits are made.\ndie: one of the pieces into which a wafer is cut.\n" * 3]
    return spam_pages, fine


def test_spam_pages(spark):
    bad, good = pages()
    data = [(i, t) for i, t in enumerate(bad * 4)] + [(100 + i, t) for i, t in enumerate(good * 20)] + [(900, None), (901, ""), (902, "???")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("codes", F.lit("clash"))
    got = {r.doc_id: r for r in spam.label_pages(df).collect()}
    assert {k for k, r in got.items() if r.flagged} == set(range(len(bad) * 4))
    assert 900 not in got and got[901].n_words == 0 and not got[902].flagged
    assert spam.label_pages(df.limit(0)).count() == 0


def test_spam_in_other_languages_and_padded_keywords(spark):
    """Prose in a language without listed function words stays; keywords padded with function words do not; periods of a table are no product codes."""
    finnish = "Puolijohdeteollisuus kasvoi viime vuonna nopeasti koko maassa. Uusi tehdas valmistuu ensi kesänä satamakaupungin laidalle. Yhtiö palkkaa tuotantoon kolmesataa uutta työntekijää syksyyn mennessä. " * 2
    polish = "Nowa fabryka rozpocznie produkcję na początku przyszłego roku. Zarząd spółki ogłosił wczoraj plan budowy kolejnej linii montażowej. Pracę znajdzie tam kilkuset inżynierów oraz techników z całego regionu."
    padded = "buy the cheap wafer and the best wafer for you and the wafer is in the shop of the wafer " * 12
    table = "Sales by period are listed below.\n" + "\n".join(f"{p} {i * 37} {i}.5" for i, p in enumerate(["2015Q3", "FY2016", "2016-Q1", "Q2/2017", "2018H1", "2019W07"] * 4))
    bad, good = pages()
    data = [(1, finnish), (2, polish), (3, padded), (4, table)] + [(10 + i, t) for i, t in enumerate(bad * 2 + good * 10)]
    got = {r.doc_id: r.flagged for r in spam.label_pages(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [False, False, True, False]


def test_em_keeps_likelihood_and_viterbi_is_exact():
    import itertools

    m = spam.prior_model()
    seqs = [np.array([spam.encode((3, 0, 0, 0, 0, 0)), spam.encode((0, 2, 0, 1, 0, 0)), spam.encode((0, 2, 1, 2, 0, 0))]), np.array([spam.encode((0, 0, 2, 2, 0, 0))] * 2), np.array([], dtype=int)]
    table = m.log_lines()
    for s, path in zip(seqs, spam.viterbi(m, seqs)):
        if len(s):
            score = lambda p, s=s: np.log(m.start[p[0]]) + sum(table[o, k] for o, k in zip(s, p)) + sum(np.log(m.step[a, b]) for a, b in zip(p, p[1:]))
            assert abs(score(tuple(path)) - max(map(score, itertools.product(range(4), repeat=len(s))))) < 1e-9
    starts, steps, emits = spam.expected_counts(m, seqs)
    assert abs(starts.sum() - 2) < 1e-9 and abs(steps.sum() - 3) < 1e-9 and abs(emits.sum() - 5) < 1e-9


def test_words_of_dirty_text():
    assert text.words(f'a <div title="{"x " * 600}">b</div> 3 < 4 <!-- c > d -->e <!-- f') == ["a", "b", "3", "4", "e", "f"]
    assert text.words("Gake-\nmas <b>ran</b>&nbsp;１２ ﬁne Саfé") == ["gakemas", "ran", "12", "fine", "cafe"]
    assert text.words(None) == [] and text.words("") == []


def test_items_left_out_early_could_not_leak():
    """The quick look at word pairs leaves out no item whose passages reach the share; ids divisible by 100 against all documents."""
    rng, p = random.Random(21), leakage.Params()
    items = {100 * i: ([rng.randrange(80) for _ in range(rng.randrange(2, 70))], None) for i in range(30)}
    items = {k: (np.array(w, dtype=np.uint64) + np.uint64(1), np.array([rng.random() < 0.8 for _ in w])) for k, (w, _) in items.items()}
    items = {k: (w, own) for k, (w, own) in items.items() if own.any()}
    index = leakage.Index(items, p)
    kept = left = 0
    for _ in range(60):
        doc = []
        for k in rng.sample(sorted(items), 3):
            w = items[k][0].tolist()
            a = rng.randrange(len(w))
            doc += [x if rng.random() > 0.1 else 999 for x in w[a:] + w[: a // 2]] + [rng.randrange(80) for _ in range(9)]
        pairs = leakage.Pairs(np.array(doc, dtype=np.uint64))
        good = set(index.promising(sorted(items), pairs))
        full = {i for i in items if index.share(i, pairs)[0] >= p.min_share}
        assert full <= good
        kept, left = kept + len(full), left + len(items) - len(good)
    assert kept > 20 and left > 200


def test_recall_at_the_full_edit_budget():
    """Copies of whole items with every seventh word altered or dropped: found by a shared key in at least nine of ten cases."""
    rng, p = random.Random(22), leakage.Params()
    items = {100 * i: [rng.choice(W) for _ in range(60)] for i in range(150)}
    index = leakage.Index({k: (leakage.word_ids(w), np.ones(len(w), dtype=bool)) for k, w in items.items()}, p)
    docs = []
    for w in items.values():
        copy = w.copy()
        for j in range(rng.randrange(7), len(copy), 7):
            copy[j] = "altered" if rng.random() < 0.5 else ""
        docs.append(leakage.word_ids([x for x in copy if x]))
    found = [k in c and index.share(k, d)[0] >= p.min_share for k, d, c in zip(items, docs, index.candidates(docs))]
    print(f"recall at the edit budget: {np.mean(found):.3f}")
    assert np.mean(found) >= 0.9
