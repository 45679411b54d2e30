"""Keyword-stuffed and link-list pages: a hidden Markov model over lines.

A page is cut into lines (long lines further into sentences and pieces). Each line
becomes six small counts-in-classes (function words, links, list marks, repetition,
codes, shouting); a hidden Markov model with the states prose, link list, tag list
and menu labels the lines, and a page is flagged when more than half of its words
stand in lines that are not prose. The model starts from a stated prior and is
trained on all lines of the corpus by expectation maximisation: tasks return
expected counts (a table of fixed size), never texts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.text import spread, strip_marks, strip_tags
from panelforge.plans.lineage import cut

STATES = ("prose", "link list", "tag list", "menu")
LEVELS = (4, 3, 3, 3, 3, 2)  # classes of each feature
SAID = 6  # times at which a word pair of a page counts as repeated
PIECE = 24  # words at most in a line after cutting

# Frequent function words of the corpus' four languages.
FUNCTION_WORDS = frozenset(
    "a about after all also although an and any are as at be because been before being but by can could did do each for from had has have he her his how i if in into is it its may more most "
    "no not of on one or other our out over per she should since so some such than that the their them then there they this to two under until up us was we were what when where which while "
    "who why will with would you your "
    "aber als am an auch auf aus bei bis da das dass dem den der des die durch ein eine einem einen einer eines er es fur hat ich im in ist kann mit nach nicht noch nur ob oder sein sich sie sind "
    "so uber um und unter vom von vor war waren was wenn werden wie wir wird wurde zu zum zur "
    "au aux avec ce ces cette comme dans de des deux du elle en est et etait il ils la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa sans se ses son sont sur un une vers "
    "al como con cuando de del desde donde dos el ella en entre era es esta este fue ha hasta la las lo los mas muy no o para pero por que se segun ser si sin sobre son su sus un una y".split()
)
_BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|tr|td|h\d)\b[^<>]*>", re.I)  # a line break inside running text is none
_ANCHOR = re.compile(r"<a\b[^<>]*>(.*?)</a>", re.I | re.S)
_MD_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)")
_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_SENTENCE = re.compile(r"(?<=[.!?:])[\"”»)]*\s+(?=[A-ZÀ-Þ\"“«¿¡#<\[*\d])|(?<=\x02)\s+(?=[A-ZÀ-Þ])|\s+(?=(?:\w+ ?: )?\x02)")
_WORD = re.compile(r"[^\W_]+(?:[-/_'’.][^\W_]+)*")
_MARKS = re.compile(r"[#★•·|;»«>*]|,(?!\d)| / ")
PERIOD = re.compile(r"(?:fy)?\d{4}[-/.]?(?:[qhwm]\d{1,2})?$|[qh]\d[-/.]?(?:fy)?\d{2,4}$")  # a year, quarter, half, month or week: a figure, no code
_ENDED = re.compile(r"[.!?][\"'”»)\]]*\s*$")
_SHOUT = re.compile(r"!!|>>|\.\.\.|(?i:click here|buy now|order now)")
_LINK = "\x02"


def lines_of(text: str) -> list[tuple[str, bool]]:
    """Lines of a page, and whether each belongs to something that ends like a sentence; links stand as a control character before their text."""
    t = _BLOCK.sub("\n", html.unescape(text) if "&" in text else text)
    t = _ANCHOR.sub(lambda m: f" {_LINK} {m.group(1)} ", t)
    t = _MD_LINK.sub(lambda m: f" {_LINK} {m.group(1)} ", t)
    t = _URL.sub(f" {_LINK} ", t)
    t = strip_tags(t)
    out = []
    for line in t.split("\n"):
        for s in _SENTENCE.split(line):
            tokens, ended = s.split(), bool(_ENDED.search(s))
            size = -(-len(tokens) // max(1, -(-len(tokens) // PIECE)))  # even pieces, no stray last word
            for k in range(0, len(tokens), max(1, size)):
                piece = " ".join(tokens[k : k + size])
                if piece:
                    out.append((piece, ended))
    return out


def _level(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def _content(w: str) -> bool:
    return w not in FUNCTION_WORDS and not w.isdigit()


def reads_as_sentence(line: str, ws: list[str]) -> bool:
    """A sentence by its shape, in whatever language: begun with a capital, mostly small letters after it, nothing said three times.

    The caller knows that it ends like one.
    """
    first = next((c for c in line if c.isalpha()), "")
    small = sum(t[0].islower() for t in line.split() if t[0].isalpha())
    return len(ws) >= 6 and first.isupper() and 2 * small > len(ws) and max(Counter(ws).values()) < 3 and len(_MARKS.findall(line)) * 6 <= len(ws)


def features(line: str, ended: bool = False, heavy: frozenset[str] = frozenset(), said: Counter | None = None) -> tuple[tuple[int, ...], int] | None:
    """Classes of a line's features and its number of words; None for a line without any.

    ``heavy`` are the page's overused words, ``said`` counts its word pairs (see
    :func:`page_lines`). A line without known function words that reads as a sentence
    is taken for one in a language that the list does not have.
    """
    links = line.count(_LINK)
    ws = [w.lower() for w in _WORD.findall(strip_marks(line))]
    n = len(ws) + links
    if n == 0:
        return None
    figures = sum(w.replace(".", "").isdigit() or bool(PERIOD.match(w)) for w in ws) / n
    if figures >= 0.6:  # a row of a table of figures is running text here
        return (len(PRIOR["prose"][0]) - 1, 0, 0, 0, 0, 0), n
    function = sum(w in FUNCTION_WORDS for w in ws) / n
    level = 1 if n <= 3 and not links and function == 0 else _level(function, 0.06, 0.16, 0.26)  # a few words tell little
    if level == 0 and ended and not links and reads_as_sentence(line, ws):
        level = 2
    top = max(Counter(w for w in ws if _content(w)).values(), default=0)
    stuffed = sum(w in heavy for w in ws) / n
    codes = sum(any(c.isdigit() for c in w) and any(c.isalpha() for c in w) and len(w) >= 5 and not PERIOD.match(w) for w in ws) / n
    return (
        level,
        _level(links / n, 0.04, 0.15),
        _level(len(_MARKS.findall(line)) / n, 0.2, 0.34),
        max(_level(top / n, 0.13, 0.2) if top >= 3 else 0, _level(stuffed, 0.15, 0.25), 2 if said and len(ws) > 2 and 2 * sum(said[p] >= SAID for p in zip(ws, ws[1:])) > len(ws) else 0),
        _level(codes, 0.15, 0.35),
        int(len(_SHOUT.findall(line)) / n > 0.1),
    ), n


def page_lines(text: str) -> list[tuple[tuple[int, ...], int]]:
    """Features of all lines of a page.

    Words that make up a twelfth of it are overused; word pairs said ``SAID`` times and
    holding an overused word are too, whatever function words stand among them.
    """
    lines = lines_of(text)
    counts: Counter = Counter()
    said: Counter = Counter()
    for line, _ in lines:
        ws = [x.lower() for x in _WORD.findall(strip_marks(line))]
        counts.update(ws)
        said.update(zip(ws, ws[1:]))
    total = sum(counts.values())
    heavy = frozenset(w for w, k in counts.items() if k >= 5 and 12 * k >= total and _content(w))
    said = Counter({p: k for p, k in said.items() if k >= SAID and (p[0] in heavy or p[1] in heavy)})
    return [f for f in (features(line, ended, heavy, said) for line, ended in lines) if f]


def encode(f: tuple[int, ...]) -> int:
    code = 0
    for x, k in zip(f, LEVELS):
        code = code * k + x
    return code


CODES = int(np.prod(LEVELS))
DECODED = np.array(np.unravel_index(np.arange(CODES), LEVELS)).T

# Prior of the emissions, one row per state and feature, as pseudo-counts' shares.
PRIOR = {
    "prose": ((0.02, 0.08, 0.25, 0.65), (0.96, 0.035, 0.005), (0.93, 0.06, 0.01), (0.97, 0.025, 0.005), (0.97, 0.02, 0.01), (0.995, 0.005)),
    "link list": ((0.75, 0.15, 0.07, 0.03), (0.02, 0.18, 0.8), (0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (0.9, 0.08, 0.02), (0.97, 0.03)),
    "tag list": ((0.8, 0.14, 0.04, 0.02), (0.97, 0.02, 0.01), (0.15, 0.25, 0.6), (0.35, 0.3, 0.35), (0.8, 0.12, 0.08), (0.95, 0.05)),
    "menu": ((0.5, 0.25, 0.15, 0.1), (0.98, 0.01, 0.01), (0.7, 0.2, 0.1), (0.3, 0.2, 0.5), (0.6, 0.15, 0.25), (0.75, 0.25)),
}


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    def log_lines(self) -> np.ndarray:
        """(codes, states) log-likelihood of every possible line."""
        return sum(np.log(self.emit[k])[:, DECODED[:, k]].T for k in range(len(LEVELS)))


def prior_model() -> Model:
    k = len(STATES)
    step = np.full((k, k), 0.03)
    np.fill_diagonal(step, 1 - 0.03 * (k - 1))
    return Model(np.array([0.85, 0.05, 0.05, 0.05]), step, [np.array([PRIOR[s][j] for s in STATES]) for j in range(len(LEVELS))])


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in seqs])
    out = np.zeros((len(seqs), max(1, lengths.max(initial=0))), dtype=np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out, lengths


def _batches(seqs: list[np.ndarray], cells: int = 400_000) -> Iterator[list[int]]:
    """Sequences of like length together, each batch of bounded size."""
    order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
    batch: list[int] = []
    for i in order:
        if batch and (len(batch) + 1) * len(seqs[i]) > cells:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def viterbi(m: Model, seqs: list[np.ndarray]) -> list[np.ndarray]:
    table, ls, la = m.log_lines(), np.log(m.start), np.log(m.step)
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64) for _ in seqs]
    for batch in _batches(seqs):
        obs, n = _padded([seqs[i] for i in batch])
        b, t = obs.shape
        back = np.zeros((b, t, len(STATES)), dtype=np.int8)
        v = ls + table[obs[:, 0]]
        best = [v]
        for s in range(1, t):
            z = v[:, :, None] + la
            back[:, s] = z.argmax(1)
            v = z.max(1) + table[obs[:, s]]
            best.append(v)
        for r, i in enumerate(batch):
            path = np.zeros(n[r], dtype=np.int64)
            path[-1] = best[n[r] - 1][r].argmax()
            for s in range(n[r] - 1, 0, -1):
                path[s - 1] = back[r, s, path[s]]
            out[i] = path
    return out


def expected_counts(m: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, steps and (code, state) emissions."""
    k = len(STATES)
    table = np.exp(m.log_lines())
    starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((CODES, k))
    for batch in _batches(seqs):
        obs, n = _padded([seqs[i] for i in batch])
        b, t = obs.shape
        live = np.arange(t) < n[:, None]
        e = np.where(live[:, :, None], table[obs], 1.0)
        fw, scale = np.zeros((b, t, k)), np.ones((b, t))
        fw[:, 0] = m.start * e[:, 0]
        for s in range(t):
            if s:
                fw[:, s] = np.where(live[:, s, None], (fw[:, s - 1] @ m.step) * e[:, s], fw[:, s - 1])
            scale[:, s] = fw[:, s].sum(1)
            fw[:, s] /= scale[:, s, None]
        bw = np.ones((b, k))
        for s in range(t - 1, -1, -1):
            g = fw[:, s] * bw
            g = g / g.sum(1, keepdims=True) * live[:, s, None]
            np.add.at(emits, obs[:, s], g)
            if s == 0:
                starts += g.sum(0)
            else:
                on = live[:, s, None]
                right = e[:, s] * bw
                x = fw[:, s - 1][:, :, None] * m.step * right[:, None, :]
                x = x / np.maximum(x.sum((1, 2), keepdims=True), 1e-300) * on[:, :, None]
                steps += x.sum(0)
                new = right @ m.step.T
                bw = np.where(on, new / new.sum(1, keepdims=True), bw)
    return starts, steps, emits


def refit(prior: Model, starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, weight: float) -> Model:
    """Maximum a posteriori: the prior counts as ``weight`` of the lines seen, so that states keep their meaning."""
    w = max(1.0, weight * emits.sum() / len(STATES))
    step = steps + w * prior.step
    emit = []
    for j, levels in enumerate(LEVELS):
        got = np.zeros((len(STATES), levels))
        for lev in range(levels):
            got[:, lev] = emits[DECODED[:, j] == lev].sum(0)
        share = got + w * prior.emit[j]
        emit.append(share / share.sum(1, keepdims=True))
    start = starts + w * prior.start
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit)


def coded_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, codes ARRAY<INT>, words ARRAY<INT>``: the lines of each page as codes."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, sizes = [], []
            for t in pdf["text"]:
                got = page_lines(t)
                codes.append([encode(f) for f, _ in got])
                sizes.append([n for _, n in got])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "codes": codes, "words": sizes})

    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return spread(rows).mapInPandas(code, "doc_id bigint, codes array<int>, words array<int>")


def train(lines: DataFrame, iterations: int = 2, weight: float = 0.3) -> Model:
    """Model after EM over all lines; per iteration one table of fixed size comes to the driver."""
    prior = model = prior_model()
    k = len(STATES)
    for _ in range(iterations):

        def count(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            total = np.zeros(k + k * k + CODES * k)
            for pdf in batches:
                got = expected_counts(model, [np.asarray(c, dtype=np.int64) for c in pdf["codes"]])
                total += np.concatenate([x.ravel() for x in got])
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at.astype("int32"), "x": total[at]})

        sums = lines.select("codes").mapInPandas(count, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()
        flat = np.zeros(k + k * k + CODES * k)
        flat[sums["i"].to_numpy()] = sums["x"].to_numpy()
        model = refit(prior, flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(CODES, k), weight)
    return model


def label_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", iterations: int = 2, share: float = 0.5) -> DataFrame:
    """Per page the share of its words in lines that are not prose, and its flag.

    Returns ``doc_id, n_words, non_prose_share, kind (most frequent label by words),
    flagged``. Null texts and null ids are left aside; a page without words has
    share 0 and is prose; repeated rows of a page repeat its row; an empty table
    gives no rows.
    """
    lines = cut(coded_lines(docs, doc_id, text))
    model = train(lines, iterations)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = viterbi(model, [np.asarray(c, dtype=np.int64) for c in pdf["codes"]])
            rows = []
            for doc, path, sizes in zip(pdf["doc_id"], paths, pdf["words"]):
                by = np.bincount(path, weights=np.asarray(sizes, dtype=float), minlength=len(STATES)) if len(path) else np.array([1.0, 0, 0, 0])
                n = int(by.sum()) if len(path) else 0
                off = float(1 - by[0] / by.sum())
                rows.append((doc, n, off, STATES[int(by.argmax())], off > share))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "non_prose_share", "kind", "flagged"])

    return lines.mapInPandas(label, "doc_id bigint, n_words bigint, non_prose_share double, kind string, flagged boolean")
