"""Toxicity by weak supervision.

Voters are lexicons and patterns that need no label, and words and word beginnings. Words and beginnings are proposed by a distributed count over a bounded, deduplicated sample of labelled rows
(SAMPLE_ROWS, a parameter) and a likelihood-ratio test; each other voter is fixed. A generative label model (expectation maximisation over latent classes)
estimates each voter's accuracies, discounts voters by the correlation of their residuals, and treats an observed label, where there is one, as
one more voter. A linear (logistic) classifier is trained on the posterior labels and scores every whole text. Without labels the fixed voters alone
supervise. Only counts, chosen terms and the sample's vote lists reach the driver; the scan of all documents is one map without shuffle.

Defined cases: a null or empty text has no features and gets the classifier's base score; texts and words of any length are read whole; repeated rows get equal scores; columns named score or predicted are replaced; conflicting labels of one doc_id are averaged; null labels and labels
without a document count for nothing; an empty table gives an empty one; other columns (labels, lang, source, doc_id) are no input of the score and are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.tables import spread

from .common import map_arrow, written

#: Labelled rows that the model is fitted on, about; terms proposed at most; the test's least statistic and least rows.
SAMPLE_ROWS, TERMS, LEAST_G, LEAST_ROWS = 20_000, 512, 25.0, 4
#: Lexicons, each a voter that needs no label, in the four languages of the corpora this is meant for.
LEXICONS = {
    "insult": "idiot idiots moron morons stupid dumb loser losers clown fool fools imbecile idiota idiotas estúpido imbécil tonto idiote stupide crétin trottel dummkopf blödmann idioten",
    "contempt": "scum trash pathetic worthless disgusting vermin garbage filth basura asqueroso patético ordure dégoûtant minable abschaum müll erbärmlich widerlich",
    "profanity": "fuck fucking shit bullshit asshole bastard bitch crap damn mierda puta cabrón merde putain salaud scheisse scheiße arschloch",
    "threat": "kill murder destroy hurt beat strangle matar destruir tuer détruire umbringen töten vernichten",
}
_THEME = {w: name for name, words in LEXICONS.items() for w in words.split()}
#: Patterns, likewise; each is tried only where its needle stands in the text, in lower case.
PATTERNS = {
    "shout": ("!!!", re.compile(r"!{3,}")), "you are": ("you", re.compile(r"\byou(?:'re| are) (?:an? |so |such )", re.I)), "shut up": ("shut up", re.compile(r"\bshut up\b", re.I)), "get lost": ("get lost", re.compile(r"\bget lost\b", re.I)),
    "hate you": ("hate", re.compile(r"\b(?:hate|despise) (?:you|them|those)\b", re.I)), "go away": ("go ", re.compile(r"\bgo (?:to hell|away|die)\b", re.I)),
}
FIXED = [*(f"f:{name}" for name in LEXICONS), *(f"f:{name}" for name in PATTERNS)]
THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = (4, 5, 6)


def terms(text: str) -> set[str]:
    """Candidate terms: words (w:), their beginnings (b:) and the names of the fixed voters that fire (f:)."""
    found = set()
    for w in set(_WORDS(text.lower())):
        found.update(f"b:{w[:k]}" for k in BEGINNINGS if len(w) > k)
        found.add(f"w:{w}")
        if w in _THEME:
            found.add(f"f:{_THEME[w]}")
    return found | set(fired(text))


def fired(text: str) -> list[str]:
    """The patterns that a text has."""
    low = text.lower()
    return [f"f:{name}" for name, (needle, p) in PATTERNS.items() if needle in low and p.search(text)]


@dataclass
class Model:
    """Terms and their weights, and the base."""

    weights: dict[str, float]
    base: float
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.names = list(self.weights)
        self.at = {t: i for i, t in enumerate(self.names)}
        self.w = np.array([self.weights[t] for t in self.names] or [0.0])

    def hits(self, text: str | None) -> list[int]:
        """Places of the terms in a text, each once; words seen before are looked up."""
        if not text:
            return []
        at, known, out = self.at, self.known, set()
        for w in set(_WORDS(text.lower())):
            found = known.get(w)
            if found is None:
                own = [f"b:{w[:k]}" for k in BEGINNINGS if len(w) > k] + [f"w:{w}"] + ([f"f:{_THEME[w]}"] if w in _THEME else [])
                found = tuple(at[t] for t in own if t in at)
                if len(known) >= 150_000:
                    known.clear()
                if len(w) <= 64:
                    known[w] = found
            if found:
                out.update(found)
        out.update(at[name] for name in fired(text) if name in at)
        return sorted(out)

    def score(self, hits: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.base + self.w[hits].sum(), -30, 30))))


def signatures(text: str) -> tuple[int, int]:
    """Two minimum hashes over three-word shingles: near copies share one of them."""
    w = text.lower().split()
    grams = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    return tuple(min(xxhash.xxh64_intdigest(g, s) for g in grams) - (1 << 63) for s in (1, 2))


def label_model(votes: np.ndarray, gold: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probability of label 1 for each row. votes: rows x voters, 0 or 1; gold: 0, 1 or NaN; start: first odds of each voter, P(vote | 1) / P(vote | 0)."""
    n, m = votes.shape
    seen = ~np.isnan(gold)
    y = np.where(seen, gold, 0.5)
    prior = float(np.clip(y[seen].mean(), 0.01, 0.5)) if seen.any() else 0.1
    rate = votes.mean(axis=0)
    a, b = np.clip(rate * start, 1e-4, 0.9), np.clip(rate, 1e-5, 0.9)
    discount, right = np.ones(m), (0.9, 0.1)  # P(label says 1 | 1), P(label says 1 | 0)
    post = y.copy()
    for k in range(rounds):
        if k or not seen.any():
            with np.errstate(divide="ignore"):
                log = np.log(prior / (1 - prior)) + votes @ (discount * np.log(a / b)) + (1 - votes) @ (discount * np.log((1 - a) / (1 - b)))
            log = log + np.where(seen, np.where(y > 0.5, np.log(right[0] / right[1]), np.log((1 - right[0]) / (1 - right[1]))), 0)
            post = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        one, zero = post.sum() + 1e-9, (1 - post).sum() + 1e-9
        a = np.clip((post @ votes + 0.5) / (one + 1), 1e-4, 0.999)
        b = np.clip(((1 - post) @ votes + 0.01) / (zero + 1), 1e-6, 0.999)
        prior = float(np.clip(one / n, 0.005, 0.5))
        if seen.any():
            right = (float(np.clip(post[seen] @ y[seen] / (post[seen].sum() + 1e-9), 0.6, 0.98)), float(np.clip((1 - post[seen]) @ y[seen] / ((1 - post[seen]).sum() + 1e-9), 0.002, 0.4)))
        # Voters whose residuals go together beyond chance (three standard errors) depend on one another: their evidence is shared among them.
        rest = votes - np.outer(post, a) - np.outer(1 - post, b)
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
        together = np.abs(rest.T @ rest / n / np.outer(spread, spread))
        np.fill_diagonal(together, 0)
        together = np.where(together > max(0.1, 3 / np.sqrt(n)), together, 0)
        discount = 1 / (1 + together.sum(axis=1))
    return post


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, keep = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + keep * w
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(keep), grad)
        w -= np.clip(step, -4, 4)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame | None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs (doc_id, text) and the labels (doc_id, toxic) that may be learned from."""
    n = 0
    if labels is not None:
        by_doc = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("y"))
        n = by_doc.count()
    unit = (F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    if n:
        chosen = docs.join(F.broadcast(by_doc.where(unit < sample_rows / n)), "doc_id").select("text", "y")
    else:
        total = max(1, docs.count())
        chosen = docs.where(unit < sample_rows / total).select("text", F.lit(None).cast("double").alias("y"))

    def signed(batches):
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            s = [signatures(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in s], pa.int64()), pa.array([x[1] for x in s], pa.int64()), pa.array(texts, pa.string()), b.column(1)], ["s1", "s2", "text", "y"])

    rows = map_arrow(chosen, signed, "s1 long, s2 long, text string, y double")
    for s in ("s1", "s2"):  # one row of a group of near copies, else their words would seem to be signs
        other = [c for c in ("s1", "s2", "text", "y") if c != s]
        rows = rows.groupBy(s).agg(F.min(F.struct("text", *[c for c in other if c != "text"])).alias("r")).select(s, "r.*")
    rows = written(rows.select("text", "y"), "sample")
    n_one, n_zero = rows.agg(F.coalesce(F.sum(F.when(F.col("y") > 0.5, 1)), F.lit(0)), F.coalesce(F.sum(F.when(F.col("y") <= 0.5, 1)), F.lit(0))).first()

    def counted(batches):
        one, zero = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if y is not None:
                    (one if y > 0.5 else zero).update(t for t in terms(text) if t[0] != "f")
        names = list({**one, **zero})
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([one[t] for t in part], pa.int64()), pa.array([zero[t] for t in part], pa.int64())], ["term", "one", "zero"])

    found = []
    if n_one and n_zero:
        sums = map_arrow(rows, counted, "term string, one long, zero long").groupBy("term").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
        share, of = n_one / (n_one + n_zero), F.col("one") + F.col("zero")
        g = 2 * (F.col("one") * F.log(F.col("one") / (of * share)) + F.when(F.col("zero") > 0, F.col("zero") * F.log(F.col("zero") / (of * (1 - share)))).otherwise(0.0))
        strong = sums.where((F.col("one") >= LEAST_ROWS) & (F.col("one") / of > min(0.5, 4 * share))).withColumn("g", g).where(F.col("g") >= LEAST_G)
        found = strong.orderBy(F.desc("g"), "term").limit(TERMS).collect()
    names = FIXED + [r["term"] for r in found]
    probe = Model(dict.fromkeys(names, 0.0), 0.0)

    def voted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([probe.hits(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1)], ["hits", "y"])

    got = map_arrow(rows, voted, "hits array<int>, y double").collect()  # SAMPLE_ROWS lists at most, about
    got.sort(key=lambda r: (r["hits"], -1.0 if r["y"] is None else r["y"]))
    votes = np.zeros((len(got), len(names)), np.float32)
    for i, r in enumerate(got):
        votes[i, r["hits"]] = 1
    gold = np.array([np.nan if r["y"] is None else float(r["y"] > 0.5) for r in got])
    if not len(got):
        return Model({f"f:{name}": 4.0 for name in LEXICONS}, -3.0)
    start = np.array([20.0 if t[2:] in LEXICONS else 2.0 if t[0] == "f" else 10.0 for t in names])
    w, base = linear(votes, label_model(votes, gold, start))
    return Model({t: float(x) for t, x in zip(names, w, strict=True)}, base)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; columns of those names are replaced."""
    own = docs.select(*[c for c in docs.columns if c.lower() not in {"score", "predicted"}])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.base))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            scores = [m.score(m.hits(t)) for t in b.column(b.schema.names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*b.schema.names, "score", "predicted"])

    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_arrow(spread(own), run, schema)


def held_out(doc_id):
    """Rows that nothing is learned from: CRC-32 of doc_id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    return fit(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))), sample_rows)
