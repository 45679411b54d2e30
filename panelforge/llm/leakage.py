"""Evaluation passages inside a corpus: CGK embedding, bit-sampling LSH, exact edit check.

Every window of ``window`` words is embedded by random walks (CGK): a walk repeats
or advances a word by a random bit that depends on the step and the word, so two
windows at a small edit distance fall into step again and agree in most places of
the embedding. Of each of ``walks`` walks, ``keys_per_walk`` keys sample ``bits``
places; windows that share a key are candidates. The candidates' passages are then
checked exactly by word edit distance.

The items are the bounded side: they are taken in blocks of at most
``MAX_BLOCK_WORDS`` words, each block's keys are shipped to the tasks, and the
corpus is read in parallel without any shuffle. Documents of any length are worked
on whole, windows in slices.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.text import chunks, plain, spread, words

MAX_BLOCK_WORDS = 1_000_000
SLICE = 200_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class Params:
    window: int = 9
    stride: int = 1
    walks: int = 4
    keys_per_walk: int = 3
    bits: int = 7
    max_edit: float = 0.15  # of a passage's words
    min_passage: int = 8
    min_share: float = 0.5
    seed: int = 11


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_ids(ws: list[str]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in ws), dtype=np.uint64, count=len(ws))


class Embedder:
    """LSH keys of all windows of a word sequence."""

    def __init__(self, p: Params) -> None:
        self.p = p
        rng = np.random.default_rng(p.seed)
        self.length = 2 * p.window
        self.salts = rng.integers(1, 2**63, (p.walks, self.length)).astype(np.uint64)
        self.places = [[np.sort(rng.choice(self.length, p.bits, replace=False)) for _ in range(p.keys_per_walk)] for _ in range(p.walks)]

    def keys(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(windows, walks x keys_per_walk) keys; past its end a window yields a pad word."""
        p, n = self.p, len(starts)
        out = np.zeros((n, p.walks * p.keys_per_walk), dtype=np.uint64)
        end = starts + p.window
        padded = np.concatenate([ids, np.zeros(p.window + 1, dtype=np.uint64)])
        for w in range(p.walks):
            # the random bit of every (step, word) is drawn for the words once, not for each window
            sums = [np.full(n, np.uint64(w * 131 + k + 1)) for k in range(p.keys_per_walk)]
            at = starts.copy()
            for j in range(self.length):
                now = np.where(at < end, padded[at], np.uint64(0))
                for k, places in enumerate(self.places[w]):
                    if j in places:
                        sums[k] = _mix(sums[k] ^ now)
                bit = (_mix(now ^ self.salts[w, j]) & np.uint64(1)).astype(np.int64)
                at = np.minimum(at + bit, end)
            for k in range(p.keys_per_walk):
                out[:, w * p.keys_per_walk + k] = sums[k]
        return out


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Word edit distance, exact."""
    if len(a) > len(b):
        a, b = b, a
    idx = np.arange(len(b) + 1)
    row = idx.copy()
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(new - idx) + idx
    return int(row[-1])


def reach(a: np.ndarray, b: np.ndarray, ends: dict[int, list[int]], max_edit: float, least: int) -> int:
    """Longest prefix of ``a`` that ends, with a prefix of ``b``, in one of ``ends`` within ``max_edit``; else 0.

    ``ends``: prefix lengths of ``a`` with those of ``b``. One table of word edit
    distances serves all ends; it is left when no longer prefix can be within.
    """
    idx = np.arange(len(b) + 1)
    row = idx.copy()
    best, allowed = 0, max_edit * len(a)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(new - idx) + idx
        if i in ends and i >= least and min(row[j] for j in ends[i]) <= max_edit * i:
            best = i
        if row.min() > allowed:
            break
    return best


class Pairs:
    """Neighbouring word pairs of a document, sorted once for all items it is compared with."""

    def __init__(self, doc: np.ndarray) -> None:
        self.words = doc
        ids = pair_ids(doc)
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]


def pair_ids(ws: np.ndarray) -> np.ndarray:
    return _mix(ws[:-1].astype(np.uint64)) ^ ws[1:].astype(np.uint64)


def runs_of(item: np.ndarray, doc: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in the document and in the item, and sizes, of all runs of two or more equal words on a diagonal."""
    none = np.zeros(0, dtype=np.int64)
    ids = pair_ids(item)
    lo, hi = np.searchsorted(doc.sorted, ids, "left"), np.searchsorted(doc.sorted, ids, "right")
    counts = hi - lo
    total = int(counts.sum())
    if not total:
        return none, none, none
    ii = np.repeat(np.arange(len(ids)), counts)
    jj = doc.order[np.repeat(lo, counts) + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)]
    diag = jj - ii
    o = np.lexsort((ii, diag))
    ii, jj, diag = ii[o], jj[o], diag[o]
    new = np.ones(total, dtype=bool)
    new[1:] = (diag[1:] != diag[:-1]) | (ii[1:] != ii[:-1] + 1)
    first = np.flatnonzero(new)
    return jj[first], ii[first], np.diff(np.append(first, total)) + 1


GAP = 3  # item words at most between two runs of a chain


def passages(item: np.ndarray, doc: np.ndarray | Pairs, p: Params) -> list[tuple[int, int]]:
    """Spans of the item found in the document, each within ``max_edit`` of its words.

    Runs of equal words on a diagonal are chained over at most two altered, dropped
    or added words. A chain may begin at any run and end at any run it leads to; of
    every beginning the longest span is kept whose exact edit distance to the
    document's span allows it, unless it lies inside another one.
    """
    pairs = doc if isinstance(doc, Pairs) else Pairs(doc)
    doc = pairs.words
    js, starts, sizes = runs_of(item, pairs)
    if not len(js):
        return []
    runs = sorted(zip(js.tolist(), starts.tolist(), sizes.tolist()))
    # the runs that may follow each run, found by where they begin; a follower always stands later
    at = {(i, j): k for k, (j, i, _) in enumerate(runs)}
    after = [[k for gi in range(-1, 4) for gj in range(-1, 4) if (k := at.get((i + n + gi, j + n + gj))) is not None and runs[k][1] + runs[k][2] > i + n] for j, i, n in runs]
    far = [i + n for _, i, n in runs]
    for k in range(len(runs) - 1, -1, -1):
        far[k] = max([far[k], *(far[x] for x in after[k])])
    found: list[tuple[int, int]] = []
    for k in sorted(range(len(runs)), key=lambda k: runs[k][1] - far[k]):
        j0, i0, _ = runs[k]
        if far[k] - i0 < p.min_passage:
            break
        if any(a <= i0 and far[k] <= b for a, b in found):
            continue
        seen, todo, ends = {k}, [k], {}
        while todo:
            j, i, n = runs[x := todo.pop()]
            ends.setdefault(i + n - i0, []).append(j + n - j0)
            new_ones = set(after[x]) - seen
            seen |= new_ones
            todo += new_ones
        width = max(max(v) for v in ends.values())
        n = reach(item[i0 : far[k]], doc[j0 : j0 + width], ends, p.max_edit, p.min_passage)
        if n:
            found.append((i0, i0 + n))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: s[0] - s[1]):
        if not any(x <= a and b <= y for x, y in out):
            out.append((a, b))
    return out


def _sentences(text: str | None) -> list[list[str]]:
    return [s for s in (words(x) for x in _SENTENCE.split(plain(text or ""))) if s]


def stock_sentences(items: DataFrame, item_id: str, text: str) -> set[str]:
    """Sentences that stand in more than one item of the whole table."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, s) for k, t in zip(pdf["k"], pdf["t"]) for s in {" ".join(x) for x in _sentences(t)}]
            yield pd.DataFrame(rows, columns=["k", "s"])

    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("k"), F.col(text).alias("t"))
    found = rows.mapInPandas(split, "k bigint, s string").groupBy("s").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi")
    return {x.s for x in found.select("s").collect()}


def own_words(texts: dict[int, str], stock: set[str] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per item: its word ids, and which of them are its own.

    A sentence that stands in several items is a stock sentence and belongs to none;
    ``stock`` has those of the whole table, without it those of ``texts`` count.
    """
    sentences = {k: _sentences(t) for k, t in texts.items()}
    if stock is None:
        seen = Counter(s for ss in sentences.values() for s in {" ".join(x) for x in ss})
        stock = {s for s, n in seen.items() if n > 1}
    out = {}
    for k, ss in sentences.items():
        flat = [w for s in ss for w in s]
        own = [" ".join(s) not in stock for s in ss for _ in s]
        out[k] = (word_ids(flat), np.array(own, dtype=bool))
    return out


class Index:
    """A block of items, ready to be shipped to the tasks."""

    def __init__(self, items: dict[int, tuple[np.ndarray, np.ndarray]], p: Params) -> None:
        self.p, self.items, self.embed = p, items, Embedder(p)
        # pair ids with room for a gap after each item, and the own words likewise
        room = np.zeros(GAP + 2, dtype=np.uint64)
        self.laid = {k: (np.concatenate([pair_ids(ids), room]), np.concatenate([own, np.zeros(len(room) - 1 + (len(ids) == 0), dtype=bool)])) for k, (ids, own) in items.items()}
        keys, owners = [], []
        for k, (ids, own) in items.items():
            if not own.any():
                continue
            last = max(0, len(ids) - p.window)
            starts = np.unique(np.append(np.arange(0, last + 1, p.stride), last))
            starts = np.array([s for s in starts if own[s : s + p.window].mean() > 0.5], dtype=np.int64)
            if len(starts):
                got = self.embed.keys(ids, starts)
                keys.append(got.ravel())
                owners.append(np.full(got.size, k, dtype=np.int64))
        allk = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        allo = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        o = np.lexsort((allo, allk))
        self.keys, self.owners = allk[o], allo[o]

    def candidates(self, docs: list[np.ndarray]) -> list[set[int]]:
        """Items that share a key with each document."""
        w = self.p.window
        found: list[set[int]] = [set() for _ in docs]
        if not len(self.keys):
            return found
        flat = np.concatenate([*docs, np.zeros(w, dtype=np.uint64)]) if docs else np.zeros(w, dtype=np.uint64)
        at, starts, owner = 0, [], []
        for n, d in enumerate(docs):
            k = max(1, len(d) - w + 1) if len(d) else 0
            starts.append(np.arange(at, at + k))
            owner.append(np.full(k, n))
            at += len(d)
        starts, owner = np.concatenate(starts), np.concatenate(owner)
        for s in range(0, len(starts), SLICE):
            got = self.embed.keys(flat, starts[s : s + SLICE])
            left = np.searchsorted(self.keys, got, "left")
            hit = (left < len(self.keys)) & (self.keys[np.minimum(left, len(self.keys) - 1)] == got)
            rows, cols = np.nonzero(hit)
            if not len(rows):
                continue
            pairs = np.unique(np.column_stack([owner[s : s + SLICE][rows], left[rows, cols]]), axis=0)
            for doc, k in pairs.tolist():
                key = self.keys[k]
                while k < len(self.keys) and self.keys[k] == key:
                    found[doc].add(int(self.owners[k]))
                    k += 1
        return found

    def promising(self, items: list[int], doc: Pairs) -> list[int]:
        """Those of the items that could reach ``min_share`` in the document.

        A chain covers runs of two or more equal words and at most ``GAP`` words
        between two of them; an item whose words within reach of such runs, on any
        diagonal, hold too few of its own cannot reach it. All items are looked up at once.
        """
        if not items:
            return []
        laid = [self.laid[i] for i in items]
        ids = np.concatenate([x for x, _ in laid])
        at = np.minimum(np.searchsorted(doc.sorted, ids), max(len(doc.sorted) - 1, 0))
        on = (doc.sorted[at] == ids) if len(doc.sorted) else np.zeros(len(ids), dtype=bool)
        near = on.copy()
        for k in range(1, GAP + 2):  # the pair's second word, then the gap
            near[k:] |= on[:-k]
        bounds = np.cumsum([0] + [len(x) for x, _ in laid[:-1]])
        got = np.add.reduceat((near & np.concatenate([o for _, o in laid])).astype(np.int64), bounds)
        return [i for i, n, (_, o) in zip(items, got, laid) if n >= self.p.min_share * o.sum()]

    def share(self, item: int, doc: np.ndarray | Pairs) -> tuple[float, int]:
        """Share of the item's own words found in passages, and the number of passages."""
        ids, own = self.items[item]
        mark = np.zeros(len(ids), dtype=bool)
        spans = passages(ids, doc, self.p)
        for a, b in spans:
            mark[a:b] = True
        return float((mark & own).sum() / own.sum()), len(spans)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[dict[int, str]]:
    """Items in blocks of a bounded size; the whole table is a stated query set."""
    sizes = items.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("c")).first()
    blocks = max(1, -(-(sizes["c"] or 0) // (5 * MAX_BLOCK_WORDS)))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b).select(item_id, text).collect()  # at most a block
        texts: dict[int, set[str]] = {}
        for k, t in rows:
            if k is not None:
                texts.setdefault(k, set()).update([t] if t else [])
        yield {k: " .\n".join(sorted(v)) for k, v in texts.items()}


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """Documents that carry at least ``min_share`` of an item's own words in passages.

    Returns ``doc_id, item_id, share, passages``; one row per pair. Null or empty
    texts carry nothing; repeated rows of a document repeat its rows; rows with a
    null id are left aside; empty tables give no rows. Stock sentences (standing in
    more than one item of the table) are nobody's own; different texts under one item
    id are parts of that item.
    """
    spark: SparkSession = docs.sparkSession
    out: DataFrame | None = None
    stock = stock_sentences(items, item_id, text)
    for block in _blocks(items, item_id, text):
        shipped = spark.sparkContext.broadcast(Index(own_words(block, stock), p))

        def find(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            index = shipped.value
            for pdf in (part for batch in batches for part in chunks(batch, "text")):
                rows = []
                ids = [word_ids(words(t)) for t in pdf["text"]]
                for doc, seq, cands in zip(pdf["doc_id"], ids, index.candidates(ids)):
                    pairs = Pairs(seq) if cands else None
                    for item in index.promising(sorted(cands), pairs) if cands else ():
                        share, n = index.share(item, pairs)
                        if share >= p.min_share:
                            rows.append((doc, item, share, n))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "passages"])

        rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        part = spread(rows).mapInPandas(find, "doc_id bigint, item_id bigint, share double, passages int")
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out
