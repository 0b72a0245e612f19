"""Toxicity scores from a learned lexicon, matched through a Levenshtein automaton on its trie.

Learning uses a bounded, hash-drawn sample of labelled rows (``MAX_TRAIN`` expected; rows that share their least word
5-gram count once, so groups of copies have one vote):
1. Terms are words and word stems of ``STEM`` to ``LONGEST_STEM`` letters (a stem stands for its proper extensions). A term enters the lexicon when toxic documents
   have it significantly more often (log-likelihood ratio at least ``EVIDENCE``); its weight is its log odds.
2. Misspellings: the trie of whole-word terms is intersected with the Levenshtein automaton for one edit (two from
   ``TWO_EDITS`` letters, none under ``ONE_EDIT``). States are determinised when they are first met and kept, so a
   word costs one table step per letter. What such near hits are worth is learned per term, starting from half its weight.
3. Context: the words within ``CONTEXT`` places of a hit carry weights of their own (learned from hits in toxic and in
   other documents); with quotation marks around the hit they scale it, which tells quotation from abuse.
4. A logistic regression on a few sums of these (strongest hit, plain hits, near hits, quoted hits, density) gives the score.

All terms that reach the evidence enter; ties and repeated rows change nothing, as documents of either kind are counted.
An empty table of documents gives no scores. Labels, language, source and ids are never inputs of a score. Null and empty texts score as texts without a hit. Without
labelled rows of both kinds every score is the share of toxic rows (0.0 without any). Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidebars.llm.common import Memo, gram_hashes, id_text, scan_words
from tidebars.session import materialize

MAX_TRAIN = 20_000
EVIDENCE = 12.0
LEAST_DOCS = 4
STEM, LONGEST_STEM = 4, 11
ONE_EDIT = 5
TWO_EDITS = 8
CONTEXT = 4
PRIOR_WEIGHT = 0.5

_WORD = re.compile(r"\w+")
_OPENING = "\"'“„«‘»"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Automaton:
    """All words within their edit bound of a term, as a table that grows as words are read.

    A place is a trie node with the edits so far, as ``4 * node + edits``; a state is a set of places. States are forgotten
    when they hold ``limit`` places together.
    """

    def __init__(self, terms: list[str], limit: int = 1_500_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.bound = [0]  # most edits that any term below allows
        for t in terms:
            k = edits_for(t)
            at = 0
            self.bound[0] = max(self.bound[0], k)
            for c in t:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.bound.append(0)
                at = nxt
                self.bound[at] = max(self.bound[at], k)
            self.term[at] = t
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.dead = self.number({})
        self.start = self.number({0: 0} if len(self.children) > 1 else {})

    def number(self, places: dict[int, int]) -> int:
        """State for a set of (trie node, edits so far), closed under leaving out letters of terms."""
        todo = list(places.items())
        while todo:
            node, e = todo.pop()
            if e > places.get(node, e):
                continue
            for child in self.children[node].values():
                if e + 1 <= self.bound[child] and e + 1 < places.get(child, 99):
                    places[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(4 * n + e for n, e in places.items()))
        if key not in self.numbers:
            self.size += 10 + len(key)
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            best = min(((e, self.term[n]) for n, e in places.items() if self.term[n] is not None and e <= edits_for(self.term[n])), default=None)
            self.ends.append((best[1], best[0]) if best else None)
        return self.numbers[key]

    def step(self, state: int, c: str) -> int:
        places: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.bound[node] and e < places.get(node, 99):
                places[node] = e

        for place in self.states[state]:
            node, e = divmod(place, 4)
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
            reach(node, e + 1)
        to = self.steps[state][c] = self.number(places)
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        """The term nearest to ``word`` within the bounds, and its distance."""
        if self.size > self.limit:
            self.clear()
        s = self.start
        for c in word:
            to = self.steps[s].get(c)
            s = self.step(s, c) if to is None else to
            if s == self.dead:
                return None
        return self.ends[s]


def edits_for(term: str) -> int:
    return 0 if len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else 2


@dataclass
class Lexicon:
    """Weights of terms (stems end in ``*``), of near hits per term, of context words; and the regression."""

    terms: dict[str, float] = field(default_factory=dict)
    near: dict[str, float] = field(default_factory=dict)
    context: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=list)


class Matcher:
    """Finds hits in one worker process."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        whole = [t for t in lexicon.terms if not t.endswith("*")]
        self.automaton = Automaton(whole)
        self.longest = max((len(t) for t in lexicon.terms), default=0)
        self.seen = Memo(self.look, 200_000)

    def look(self, word: str) -> tuple[float, bool, str] | tuple[()]:
        """(weight, near?, term) of the best match of a word, or nothing."""
        terms = self.lexicon.terms
        found = [(terms[word], False, word)] if word in terms else []
        for n in range(STEM, min(len(word), self.longest)):
            if (stem := word[:n] + "*") in terms:
                found.append((terms[stem], False, stem))
        if not found and ONE_EDIT - 1 <= len(word) and (near := self.automaton.find(word)) is not None:
            found.append((self.lexicon.near.get(near[0], PRIOR_WEIGHT * terms[near[0]]), True, near[0]))
        return max(found) if found else ()

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, float, bool, str, bool]]]:
        """Words, and (place, weight, near?, term, quoted?) of every hit."""
        words = words_of(text)
        self.seen.trim()
        look = self.seen.__getitem__
        at = [i for i, w in enumerate(words) if look(w)]
        if not at:
            return words, []
        spans = [m.span() for m in _WORD.finditer(text.lower())]
        lower = text.lower()
        quoted = []
        for i in at:
            a, b = spans[max(0, i - CONTEXT)][0], spans[min(len(words) - 1, i + CONTEXT)][1]
            quoted.append(any(q in lower[a : spans[i][0]] for q in _OPENING) and any(q in lower[spans[i][1] : b + 1] for q in "\"'”“»«’"))
        return words, [(i, *look(words[i]), q) for i, q in zip(at, quoted, strict=True)]

    def features(self, words: list[str], hits: list[tuple[int, float, bool, str, bool]]) -> list[float]:
        """Strongest hit, and log sums of plain hits, near hits, quoted hits; number of different terms; hits per word."""
        plain = near = quoted = top = 0.0
        for i, weight, is_near, _, is_quoted in hits:
            around = [self.lexicon.context[w] for w in words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT] if w in self.lexicon.context]
            scale = 1 / (1 + math.exp(-sum(around))) * 2 if around else 1.0
            value = max(0.0, weight) * min(scale, 1.5)
            if is_quoted:
                quoted += value
            elif is_near:
                near += value
            else:
                plain += value
            top = max(top, value * (0.3 if is_quoted else 1.0))
        return [1.0, top, math.log1p(plain), math.log1p(near), math.log1p(quoted), math.log1p(len({h[3] for h in hits})), min(1.0, 10 * len(hits) / max(1, len(words)))]

    def assess(self, text: str) -> tuple[float, list[str]]:
        """Score and the terms that were hit."""
        words, hits = self.hits(text)
        z = sum(a * b for a, b in zip(self.lexicon.coefficients, self.features(words, hits), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), sorted({h[3] for h in hits})


def terms_in(words: set[str]) -> set[str]:
    """Words and stems of a document."""
    return words | {w[:n] + "*" for w in words for n in range(STEM, min(len(w), LONGEST_STEM + 1))}


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """``text`` and ``toxic`` (0/1) of at most about ``max_train`` labelled rows, one per least word 5-gram."""
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("toxic in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    # The same draw by id on both sides, so that only drawn texts are shuffled.
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < F.lit(min(1.0, max_train / max(1, n)) * 1_000_003)
    drawn, texts = marked.where(draw), id_text(docs, id_col, text_col).where(draw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for t in batch.column(0).to_pylist():
                h = scan_words([t]).hashes
                g = gram_hashes(h, min(5, max(1, len(h))))
                keys.append(int(g.min()) - (1 << 63) if len(g) else 0)
            yield pa.record_batch([*batch.columns, pa.array(keys, pa.int64())], ["text", "toxic", "key"])

    rows = texts.join(drawn, "doc_id").select("text", "toxic").mapInArrow(run, "text binary, toxic int, key long")
    one = rows.groupBy("key").agg(F.max(F.struct("toxic", "text")).alias("r"))
    return materialize(one.select("r.text", "r.toxic"), "toxicity")


def counted(rows: DataFrame, of) -> DataFrame:
    """Documents of either kind per term that ``of(texts)`` yields; summed in the tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (pos if toxic else neg).update(of(text.decode("utf-8", "replace")))
            terms = list(pos | neg)
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], ["term", "pos", "neg"])

    return rows.select("text", "toxic").mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def log_odds(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def fit(features: np.ndarray, toxic: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards ``prior``."""
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        pull = np.full(len(w), strength)
        pull[0] = 1e-3
        gradient = features.T @ (p - toxic) + pull * (w - prior)
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag(pull)
        change = np.linalg.solve(hessian, gradient)
        w = w - change
        if np.abs(change).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, evidence: float = EVIDENCE) -> Lexicon:
    """The model of rows that have a label. ``docs`` and ``labels`` hold only rows that may be learned from."""
    rows = sample(docs, labels, id_col, text_col, label_col, max_train)
    found = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = found.get(1, 0), found.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon(coefficients=[30.0 if n_pos else -30.0, *[0.0] * 6])
    share = n_pos / (n_pos + n_neg)
    terms = counted(rows, lambda text: terms_in(set(words_of(text))))
    n = F.col("pos") + F.col("neg")
    gain = F.col("pos") * F.ln(F.col("pos") / (n * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.ln(F.col("neg") / (n * (1 - share)))).otherwise(0.0)
    strong = terms.where((F.col("pos") >= LEAST_DOCS) & (F.col("pos") > n * share)).withColumn("gain", gain).where(F.col("gain") >= evidence)
    best = strong.orderBy(F.desc("gain"), "term").collect()  # terms of at least LEAST_DOCS rows of the bounded sample
    lexicon = Lexicon(terms={r["term"]: log_odds(r["pos"], r["neg"], n_pos, n_neg) for r in best})
    lexicon.terms = {t: w for t, w in lexicon.terms.items() if w > 1.0}

    def near_and_context(text: str) -> set[str]:
        m = _matcher(lexicon)
        words, hits = m.hits(text)
        out = {f"n:{h[3]}" for h in hits if h[2]}
        for h in hits:
            out.update("c:" + w for w in words[max(0, h[0] - CONTEXT) : h[0]] + words[h[0] + 1 : h[0] + 1 + CONTEXT])
        return out

    seen = counted(rows, near_and_context).where(F.col("term").startswith("n:") | (n >= 20)).collect()  # n: at most one per term; c: words that 20 sampled rows have
    for r in seen:
        kind, term = r["term"][:2], r["term"][2:]
        if kind == "n:":
            start = PRIOR_WEIGHT * lexicon.terms[term]
            k = 2.0
            lexicon.near[term] = (k * start + (r["pos"] + r["neg"]) * log_odds(r["pos"], r["neg"], n_pos, n_neg)) / (k + r["pos"] + r["neg"])
        elif term not in lexicon.terms:
            lexicon.context[term] = 0.2 * math.log((r["pos"] + 5 * share) / (r["neg"] + 5 * (1 - share)) * (1 - share) / share)
    in_hits = lexicon.context.values()
    middle = float(np.median(list(in_hits))) if in_hits else 0.0  # words around hits are in toxic documents anyway
    lexicon.context = {w: v - middle for w, v in lexicon.context.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(lexicon)
        for batch in batches:
            rows = [m.features(*m.hits(t.decode("utf-8", "replace"))) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    data = rows.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").collect()  # seven numbers per sampled row
    x, y = np.array([r["x"] for r in data]), np.array([r["toxic"] for r in data], float)
    prior = np.array([-3.0, 0.8, 0.3, 0.3, 0.1, 0.3, 0.2])
    lexicon.coefficients = fit(x, y, prior).tolist()
    return lexicon


_OPEN: dict[int, Matcher] = {}


def _matcher(lexicon: Lexicon) -> Matcher:
    key = hash((tuple(lexicon.terms.items()), tuple(lexicon.near.items()), tuple(lexicon.context.items()), tuple(lexicon.coefficients)))
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Matcher(lexicon)
    return _OPEN[key]


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``predicted`` and ``terms`` (what was hit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(lexicon)
        for batch in batches:
            found = [m.assess(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            scores, terms = [s for s, _ in found], [t for _, t in found]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "score", "predicted", "terms"])

    df = id_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, score double, predicted int, terms array<string>")
