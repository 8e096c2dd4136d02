"""Mixing documents to target weights with soft domain membership.

A softmax classifier over hashed words, learnt in one task from a bounded sample of a
labelled table, gives every document a posterior over domains.  The rates at which
documents are to be drawn are the solution of a least-squares problem over rates not
below ``least_rate`` (0: nonnegative):

    minimise  sum_d (S_d(r) - T_d)^2 / D_d,   S_d(r) = sum_i r_i tokens_i P(d | i)

where T are the target token totals and D the totals at rate 1.  It is solved by
projected gradient steps with momentum in the metric of the documents' tokens, in which
step length 1 always descends (the matrix of second moments over D has row sums 1).  A
step needs only the D-vector of totals, one distributed sum over a narrow table, and a
document's rate after k steps follows from its posterior and the k vectors, so no state
is kept.

Defined results: a null or empty text has no tokens, the posterior of the bias, and
takes no part in the sums; a null label is not learnt from; a domain without tokens
cannot be raised and is left out; without labels there is one domain, ""; more than
``MOST_DOMAINS`` domains are an error; repeated rows get equal rates, and rows that repeat
a key are learnt from once; a whole text counts, however long; an empty table gives an
empty table; other columns are kept, except those named tokens, posterior or rate, whose
place the results take.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each, worker_state, written

#: most labelled documents to learn from, and most domains
SAMPLE, MOST_DOMAINS = 4096, 64
BITS = 16
EPOCHS, RATE = 6, 0.5


class Words:
    """Weight index of each word, remembered in a bounded table."""

    def __init__(self, bits: int = BITS, remembered: int = 250_000):
        self.shift, self.most = 64 - bits, remembered
        self.at: dict[str, int] = {}

    def indices(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        try:
            return np.array(list(map(self.at.__getitem__, words)), np.int64)
        except KeyError:
            pass
        if len(self.at) > self.most:
            self.at = {}
        for w in set(words).difference(self.at):
            self.at[w] = xxhash.xxh64_intdigest(w) >> self.shift
        return np.array(list(map(self.at.__getitem__, words)), np.int64)


class DomainModel:
    """Softmax weights: one row per hashed word, the last for the bias."""

    def __init__(self, domains: list[str], weights: np.ndarray):
        self.domains, self.weights = domains, weights

    def posterior(self, words: Words, text: str | None) -> tuple[int, np.ndarray]:
        """(words, P(domain | text))."""
        at = words.indices(text)
        z = self.weights[-1].astype(np.float64)
        if len(at):
            z = z + np.full(len(at), 1.0 / len(at)) @ self.weights[at].astype(np.float64)
        e = np.exp(z - z.max())
        return len(at), e / e.sum()


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], domains: int, bits: int = BITS) -> np.ndarray:
    """Softmax regression with per-coordinate (Adagrad) steps."""
    w = np.zeros(((1 << bits) + 1, domains), np.float64)
    g2 = np.full_like(w, 1e-8)
    for _ in range(EPOCHS):
        for at, values, label in examples:
            at, x = np.append(at, len(w) - 1), np.append(values, 1.0)
            z = x @ w[at]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p
            g2[at] += g * g
            w[at] -= RATE * g / np.sqrt(g2[at])
    return w.astype(np.float32)


def fit_domains(docs: DataFrame, key: str, text: str, domain: str, labelled: DataFrame | None = None, most: int = SAMPLE, bits: int = BITS) -> DomainModel:
    """Learns from at most ``most`` rows of ``docs``, the first by a hash of their key.

    ``labelled`` is a table whose keys say which rows' domains are known; without it all are.
    """
    rows = docs.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{domain}`")).alias("o"), F.col(f"`{key}`").alias("k"), F.col(f"`{domain}`").cast("string").alias("d"))
    if labelled is not None:  # keys and domains only: no text is moved for this
        rows = rows.join(labelled.select(F.col(f"`{key}`").alias("k")), "k", "left_semi")
    chosen = rows.filter("d IS NOT NULL AND k IS NOT NULL").orderBy("o", "k").limit(most).distinct()
    found = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "k")  # at most ``most`` short rows
    sample = found.groupBy("o", "k", "d").agg(F.min("t").alias("t"))  # of rows that repeat a key, the least text: as many rows as keys

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(bits)
        for b in batches:
            for order, t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at = words.indices(t)
                at, counts = np.unique(at, return_counts=True)
                row = [order, at.astype(np.int32).tobytes(), (counts / max(1, counts.sum())).astype(np.float32).tobytes(), d]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["o", "at", "values", "d"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        domains = sorted({d for *_, d in rows})
        if len(domains) > MOST_DOMAINS:
            raise ValueError(f"{len(domains)} domains; at most {MOST_DOMAINS} can be mixed")
        examples = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), domains.index(d)) for _, a, v, d in rows]
        domains = domains or [""]
        yield pa.RecordBatch.from_arrays([pa.array([domains], pa.list_(pa.string())), pa.array([train(examples, len(domains), bits).tobytes()], pa.binary())], ["domains", "weights"])

    made = sample.select("o", "t", "d").mapInArrow(features, "o long, at binary, values binary, d string").repartition(1).mapInArrow(learn, "domains array<string>, weights binary")
    domains, weights = made.first()
    return DomainModel(list(domains), np.frombuffer(bytes(weights), np.float32).reshape(-1, len(domains)))


def _rates(posteriors: np.ndarray, steps: list[tuple[float, np.ndarray]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the steps, and before the last one."""
    r = before = np.full(len(posteriors), max(1.0, least))
    for momentum, g in steps:
        r, before = np.maximum(least, r + momentum * (r - before) - posteriors @ g), r
    return r, before


class Mixer:
    """Fits rates over ``df`` and applies them; texts are read once.

    ``keep`` names the columns that ``rated`` returns (all of ``df`` by default): they are
    written with the posteriors, and steps read only the posteriors.
    """

    def __init__(self, df: DataFrame, model: DomainModel, text: str = "text", least_rate: float = 0.0, keep: list[str] | None = None):
        self.least = least_rate
        self.domains = model.domains
        self.steps: list[tuple[float, np.ndarray]] = []  # momentum, and a value for each domain
        shared = df.sparkSession.sparkContext.broadcast(model)  # at most (2^BITS + 1) x MOST_DOMAINS floats
        added = ["tokens", "posterior"]
        self.keep = [c for c in (df.columns if keep is None else keep) if c not in [*added, "rate"]]
        rest = self.keep + ([] if text in self.keep else [text])
        at = rest.index(text)
        schema = T.StructType([df.schema[c] for c in self.keep] + [T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
        kept = len(self.keep)

        def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, model = worker_state(("domains", BITS), lambda: Words(BITS)), shared.value
            for b in batches:
                found = [model.posterior(words, t) for t in each(b.column(at))]
                columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([p.tolist() for _, p in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], *columns], [*b.schema.names[:kept], *added])

        self.described = written(df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(described, schema), "posteriors")
        self.narrow = self.described.select("tokens", "posterior")

    def totals(self) -> np.ndarray:
        """One distributed sum: expected tokens of each domain at the present rates; the same before the last step; and all the tokens that it moved."""
        steps, least, d = self.steps, self.least, len(self.domains)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * d + 1)
            for b in batches:
                tokens = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                rates, before = _rates(p, steps, least)
                total += np.concatenate([(rates * tokens) @ p, (before * tokens) @ p, [np.abs(rates - before) @ tokens]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * d + 1)), pa.array(total)], ["domain", "total"])

        out = np.zeros(2 * d + 1)
        for domain, total in self.narrow.mapInArrow(summed, "domain long, total double").groupBy("domain").sum("total").collect():  # two rows per domain
            out[domain] = total
        return out

    def fit(self, targets: Callable[[dict[str, float]], dict[str, float]], tolerance: float = 1e-4, most_steps: int = 1000) -> Mixer:
        """Steps until every domain is within ``tolerance`` of its target, or until the rates are optimal.

        ``targets`` gets each domain's tokens and returns the tokens each is to have.  Steps
        have momentum, which starts anew when the cost has grown.  Rates are optimal when a
        step without momentum moves less than a ``tolerance`` of all tokens: what a
        projected gradient step moves is nought exactly where the optimality conditions
        hold.  Targets may be out of reach of rates not below ``least_rate``: ``after`` has
        what was reached, ``residual`` the share of tokens that the last step moved,
        ``met`` whether the targets were, ``converged`` whether either end was (else there
        is a warning).
        """
        d = len(self.domains)
        now = self.totals()[:d]
        base = now
        self.before = dict(zip(self.domains, base.tolist(), strict=True))
        wanted = targets(self.before)
        self.targets = np.array([wanted.get(x, 0.0) for x in self.domains])
        scale = np.where(base > 0, base, np.inf)
        cost = lambda t: float(((t - self.targets) ** 2 / scale).sum())
        last, self.residual, since, momentum = now, np.inf, 0, 0.0
        while True:
            off = np.where(base > 0, now - self.targets, 0.0)
            self.met = bool(np.all(np.abs(off) <= tolerance * np.maximum(self.targets, 1.0)))
            self.converged = self.met or (self.residual <= tolerance and momentum == 0.0)
            if self.converged or len(self.steps) >= most_steps:
                break
            settled = self.residual <= tolerance or cost(now) > cost(last)  # look, or start, without momentum
            since = 0 if settled else since + 1
            momentum = since / (since + 3.0) if since else 0.0
            ahead = now + momentum * (now - last)  # the totals are linear in the rates
            self.steps.append((momentum, (ahead - self.targets) / scale))
            out = self.totals()
            now, last = out[:d], out[d : 2 * d]
            self.residual = out[2 * d] / max(now.sum(), 1.0)
        if not self.converged:
            warnings.warn(f"mixing stopped after {most_steps} steps; the last one moved {self.residual:.2g} of all tokens", stacklevel=2)
        self.after = dict(zip(self.domains, now.tolist(), strict=True))
        return self

    def rated(self) -> DataFrame:
        """The kept columns with tokens, posterior and rate: the steps taken, as an expression over the posterior."""
        if not self.steps:
            return self.described.withColumn("rate", F.lit(max(1.0, self.least)))
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in (m, *g)]) for m, g in self.steps])

        def step(state: Column, s: Column) -> Column:
            moved = F.aggregate(F.zip_with("posterior", F.slice(s, 2, len(self.domains)), lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
            r = state["r"] + F.get(s, F.lit(0)) * (state["r"] - state["before"]) - moved
            return F.struct(F.greatest(F.lit(float(self.least)), r).alias("r"), state["r"].alias("before"))

        start = F.lit(max(1.0, self.least))
        return self.described.withColumn("rate", F.aggregate(steps, F.struct(start.alias("r"), start.alias("before")), step)["r"])


def copies(rate: Column, key: Column, seed: int = 7) -> Column:
    """A whole number with the rate as its mean, the same for the same key at every run."""
    part = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))
    return F.floor(rate + part).cast("int")


def weights_of_total(weights: dict[str, float]) -> Callable[[dict[str, float]], dict[str, float]]:
    """Targets that keep the number of tokens and give each domain its weight."""
    return lambda have: {d: w * sum(have.values()) / sum(weights.values()) for d, w in weights.items()}


def tempered(power: float, room: float = 0.05) -> Callable[[dict[str, float]], dict[str, float]]:
    """Targets in proportion to share^power, large enough that no domain has to shrink.

    Raising one domain raises others too, as membership is soft: ``room`` is what the
    largest may gain by that.
    """

    def targets(have: dict[str, float]) -> dict[str, float]:
        raised = {d: n**power for d, n in have.items() if n > 0}
        scale = (1 + room) * max((have[d] / x for d, x in raised.items()), default=0.0)
        return {d: x * scale for d, x in raised.items()}

    return targets
