"""N-gram Jaccard join: near-duplicate classes of documents by exact set similarity.

The join is a sparse matrix product of the document by n-gram incidence with itself,
done in blocks and with everything left out that a size-derived bound rules out:

1. Each document becomes its set of hashed word n-grams.  Equal sets collapse to one row
   (a *set*); n-grams in very many documents and common words are found (bounded lists).
2. With the n-grams of a set in one global order, two sets that are similar enough share
   one of the first ``n - ceil(t n) + 1``.  Only these *postings* enter the product, dealt
   by n-gram and by band of set size (sizes further apart than the threshold never meet).
   The order puts n-grams of rare words first and listed ones last: how likely unrelated
   texts are to share an n-gram follows from its words, whatever the size of the corpus.
3. In blocks with many sets, each set first meets a few pivots only, those in which the
   block's n-gram comes earliest (they have least of their own); the links found join
   most of a large group of copies, and what is already in one class needs no more pairs.  Then all pairs of a block whose classes differ are taken, so no link between
   classes is lost, and a group of copies never emits all its pairs.
   Overlap counts are summed for each pair over all its blocks.
4. A product of two postings is only made while what either set has left from there on
   allows a link, and a pair is discarded if its summed overlap and what its sets have left
   after the last shared posting cannot reach the threshold; so is one that a bound from
   folded bitmaps rules out (the symmetric difference is at least the number of differing
   bits).  Products of the n-grams beyond are not made: what is left is verified on the
   whole sets.
5. Links are closed to classes by connected components.

Defined results: words are what ASCII white space separates, A-Z lower-cased; a text
with fewer words than n has one shingle, the whole sequence; one without words has none
and is linked with nothing; a null text is empty; repeated rows and texts fall in one
class; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dropped, each, freed, worker_state, written
from .components import connected_components

#: n-grams listed as frequent, and the count in a run of documents from which one is a candidate;
#: an n-gram seen in less than a share of the places of its rarest word needs no listing
FREQUENT, FREQUENT_IN_RUN, OF_RAREST = 1 << 18, 3, 0.2
#: n-grams in a run, which bounds what a task holds
RUN_GRAMS = 2_500_000
#: the same for common words
COMMON, COMMON_IN_RUN = 1 << 17, 8
#: sets in a block from which pivots come first, and how many pivots
LARGE_BLOCK, PIVOTS = 48, 2
MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd constant: 2^64 over the golden ratio


@dataclass(frozen=True)
class Rule:
    """Links sets when ``den * intersection >= num * union``."""

    words: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def band(self, n: str) -> str:
        """SQL: sizes within the threshold of each other are in the same or neighbouring bands.

        The band is a little wider than the threshold, so that rounding cannot part two sizes.
        """
        return f"CAST(floor(ln(CAST({n} AS DOUBLE)) / {float(np.log(self.den / self.num)) + 1e-9!r}) AS INT)"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of hashed word n-grams; remembers word hashes in a bounded table.

    ``common`` (sorted word hashes and their costs) gives each n-gram the sum of its words' costs.
    """

    def __init__(self, words: int, seed: int = 0, common: tuple[np.ndarray, np.ndarray] | None = None, remembered: int = 250_000):
        self.words, self.seed, self.most, self.common = words, seed, remembered, common
        self._clear(remembered)

    def _clear(self, room: int) -> None:
        self.at: dict[bytes, int] = {}
        self.hashes, self.costs = np.zeros(room, np.uint64), np.zeros(room, np.int64)

    def _place(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if len(self.at) + len(new) > len(self.hashes):
            new = list(dict.fromkeys(words))
            self._clear(max(self.most, len(new)))
        first = len(self.at)
        for i, w in enumerate(new, first):
            self.at[w] = i
            self.hashes[i] = xxhash.xxh64_intdigest(w, self.seed)
        if self.common is not None and len(self.common[0]):
            h, (keys, costs) = self.hashes[first : first + len(new)], self.common
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            self.costs[first : first + len(new)] = np.where(keys[at] == h, costs[at], 0)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-gram hashes in order of the text, their costs, word hashes)."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = self._place(words)
        h, c = self.hashes[at], self.costs[at]
        k = min(self.words, len(h))
        n = len(h) - k + 1
        out, cost = h[:n] * MIX + np.uint64(k), c[:n]
        for i in range(1, k):
            out, cost = _mixed(out) + h[i : n + i], cost + c[i : n + i]
        return _mixed(out), cost, h

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingle hashes, sorted."""
        return np.unique(self.grams(text)[0])


def digest(hashes: np.ndarray, seed: int) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed) - (1 << 63)


def bitmap(hashes: np.ndarray) -> bytes:
    """2n to 4n bits, one set for each hash, by its low bits: maps of different lengths fold onto each other."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    marks = np.zeros(bits, bool)
    marks[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _describe(rule: Rule, seed: int, told: bool = False):
    """Texts to set descriptions (with the digest beside the text, if ``told``), and the n-grams (n = -1) and words (n = -2) that are frequent in a run of documents."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, sum_words = worker_state(("grams", rule.words, seed), lambda: Shingler(rule.words, seed)), 0, 0
        run, words, places = [], [], []  # distinct n-grams of each text, its words, and where in the run the n-grams stand
        names = ["doc", "n", "set_id", "proof", "bits", *["digest"] * told]

        def row(hashes: np.ndarray, counts: np.ndarray, kind: int) -> pa.RecordBatch:
            none = pa.nulls(len(hashes), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(np.full(len(hashes), kind)), pa.array(hashes.view(np.int64)), pa.array(counts), *[pa.nulls(len(hashes), pa.binary())] * (1 + told)], names)

        def frequent() -> Iterator[pa.RecordBatch]:
            if not run:
                return
            joined = lambda parts: (np.concatenate(parts), parts.clear())[0]  # noqa: E731  a run's arrays go as they are used up
            found, at, counts = np.unique(joined(words), return_inverse=True, return_counts=True)
            yield row(found[counts >= COMMON_IN_RUN], counts[counts >= COMMON_IN_RUN], -2)
            of_word = counts.astype(np.int32)[at]
            del found, at
            rarest = of_word.copy()
            for i in range(1, rule.words):
                np.minimum(rarest[:-i], of_word[i:], out=rarest[:-i])
            del of_word
            rarest = rarest[joined(places)]
            grams, first, counts = np.unique(joined(run), return_index=True, return_counts=True)
            listed = (counts >= FREQUENT_IN_RUN) & (counts >= OF_RAREST * rarest[first])
            yield row(grams[listed], counts[listed], -1)

        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), each(b.column(1)), strict=True):
                grams, _, h = shingler.grams(text)
                s, first = np.unique(grams, return_index=True)
                if len(s):
                    places.append(first + sum_words)
                    sum_words += len(h)
                    words.append(h)
                    rows.append((doc, len(s), digest(s, seed), digest(s, seed + 1), bitmap(s)))
                    run.append(s)
                    held += len(s)
                else:
                    rows.append((doc, 0, None, None, None))
                if held > RUN_GRAMS:
                    yield from frequent()
                    run, words, places, held, sum_words = [], [], [], 0, 0
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)] + b.columns[2:], names)
        yield from frequent()

    return described


def _postings(rule: Rule, seed: int, frequent):
    """Texts to (gram, set_id, n, pos) for the first n-grams of each set in the global order."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ranks, words, costs = frequent.value  # sorted, with the rank of each (rarer first, from 1)
        shingler, seen = worker_state(("costed grams", rule.words, seed, hash((words.tobytes(), costs.tobytes()))), lambda: Shingler(rule.words, seed, (words, costs))), set()
        for b in batches:
            parts = []
            for text in each(b.column(0)):
                s, cost, _ = shingler.grams(text)
                if not len(s):
                    continue
                s, first = np.unique(s, return_index=True)
                cost = cost[first]
                name = digest(s, seed)
                if name in seen:
                    continue
                if len(seen) < 1_000_000:  # spares repeating what copies post; the rest is combined later
                    seen.add(name)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    cost = cost + np.where(grams[at] == s, ranks[at] << 32, 0)
                s = s[np.argsort(cost, kind="stable")]  # of equal cost in order of hash
                first = s[: rule.prefix(len(s))]
                parts.append((first, np.full(len(first), name), np.full(len(first), len(s)), np.arange(len(first))))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], ["gram", "set_id", "n", "pos"])

    return posted


def _sets(rule: Rule, seed: int):
    """Texts to whole sets under their names."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = worker_state(("grams", rule.words, seed), lambda: Shingler(rule.words, seed))
        for b in batches:
            names, grams, held = [], [], 0
            for i, text in enumerate(each(b.column(0))):
                s = shingler.shingles(text)
                if len(s):
                    names.append(digest(s, seed))
                    grams.append(s.tobytes())
                    held += len(s)
                if held > 1_000_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(grams, pa.binary())], ["set_id", "grams"])
                    names, grams, held = [], [], 0

    return made


def _alike_maps(rule: Rule):
    """Keeps pairs whose bitmaps do not rule out a link."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, na, nc, ma, mc = (x.to_pylist() for x in b.columns)
            keep = []
            for i in range(b.num_rows):
                most = (na[i] + nc[i] - differing_bits(ma[i], mc[i])) // 2  # intersection at most
                if most * (rule.num + rule.den) >= rule.num * (na[i] + nc[i]):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, c)], ["a", "b"])

    return kept


def _linked(rule: Rule):
    """Keeps pairs whose whole sets are similar enough."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if rule.den * both >= rule.num * (len(x) + len(y) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return kept


class _Join:
    def __init__(self, docs: DataFrame, rule: Rule):
        self.rule = rule
        self.docs = docs.select("doc", "text")  # doc long, text string
        told = [c for c in docs.columns if c == "digest"]  # binary, optional
        for self.seed in range(0, 10, 2):  # another seed if two sets share a name, which is next to never
            described = written(docs.mapInArrow(_describe(rule, self.seed, bool(told)), "doc long, n long, set_id long, proof long, bits binary" + ", digest binary" * len(told)), "sets")
            self.members = described.filter("n >= 0").select("doc", "n", "set_id", *told)
            named = described.filter("n > 0").groupBy("set_id")
            self.sets = named.agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("proof").alias("p"), F.max("proof").alias("q"))
            if self.sets.filter("p != q").isEmpty():
                break
        self.sets = self.sets.drop("p", "q")
        grams, ranks = self._most(described.filter("n = -1"), FREQUENT)
        words, counts = self._most(described.filter("n = -2"), COMMON)
        # a word's cost: its frequency on a log scale, in steps of a quarter of a doubling
        costs = np.round(4 * np.log2(np.maximum(counts, 1))).astype(np.int64)
        by_count = np.empty(len(grams), np.int64)
        by_count[np.lexsort((grams, ranks))] = np.arange(1, len(grams) + 1)
        self.frequent = docs.sparkSession.sparkContext.broadcast((grams, by_count, words, costs))

    @staticmethod
    def _most(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` highest counts at most, in order of hash."""
        found = counted.groupBy("set_id").agg(F.sum("proof").alias("c")).orderBy(F.desc("c"), "set_id").limit(most).toArrow()
        hashes, counts = found["set_id"].to_numpy().view(np.uint64), found["c"].to_numpy()
        order = np.argsort(hashes)
        return hashes[order], counts[order]

    def postings(self) -> DataFrame:
        """The first n-grams of each set, where at least two sets have them."""
        posted = self.docs.select("text").mapInArrow(_postings(self.rule, self.seed, self.frequent), "gram long, set_id long, n long, pos long")
        # dealt by n-gram once: both aggregations use it
        once = posted.repartition("gram").groupBy("gram", "set_id").agg(F.min("n").cast("int").alias("n"), F.min("pos").cast("int").alias("pos"))
        shared = once.withColumn("sets", F.expr("count(1) OVER (PARTITION BY gram)")).filter("sets > 1").drop("sets")
        return written(shared.withColumn("band", F.expr(self.rule.band("n"))), "postings")

    def within(self, overlap: str, na: str, nb: str) -> str:
        """SQL: so large an overlap of sets of such sizes is a link."""
        return f"{self.rule.num + self.rule.den}L * ({overlap}) >= {self.rule.num}L * ({na} + {nb})"

    def near(self, x: str, y: str) -> str:
        """SQL: sizes, and what either set has left from a shared n-gram on, allow a link whose first one it is."""
        sizes = f"{self.rule.den} * least({x}.n, {y}.n) >= {self.rule.num} * greatest({x}.n, {y}.n)"
        return f"{sizes} AND {self.within(f'least({x}.n - {x}.pos, {y}.n - {y}.pos)', f'{x}.n', f'{y}.n')}"

    def product(self, met: DataFrame) -> DataFrame:
        """Pairs (a < b) of the block product ``met`` (x, y: set_id, n, pos) with their overlap counts summed, less those that bounds rule out.

        Shared n-grams come in one order in both sets and ``near`` lets the first of them
        through, so ``overlap`` counts all up to the last that is met; from there on a
        pair can share no more than either set has left.
        """
        x, y = (F.struct(f"{s}.set_id", f"{s}.n", f"{s}.pos") for s in "xy")
        ends = met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        summed = ends.groupBy(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).agg(
            F.count("*").alias("overlap"), F.min("a.n").alias("na"), F.min("b.n").alias("nb"), F.max("a.pos").alias("pa"), F.max("b.pos").alias("pb")
        )
        return summed.filter(self.within("overlap + least(na - pa, nb - pb) - 1", "na", "nb"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a < b), those that are linked."""
        maps = self.sets.select("set_id", "n", "bits")
        with_maps = pairs.join(maps.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ma")), "a")
        with_maps = with_maps.join(maps.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("mb")), "b")
        likely = checkpointed(with_maps.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_alike_maps(self.rule), "a long, b long"))
        freed(pairs.sparkSession)  # the product's shuffles
        wanted = checkpointed(likely.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(self.sets.select("set_id", "doc"), "set_id"))
        holders = wanted.select("doc").distinct().alias("w")
        texts = self.docs.alias("d").join(holders, F.expr("d.doc <=> w.doc"), "left_semi").select("text")
        made = texts.mapInArrow(_sets(self.rule, self.seed), "set_id long, grams binary")
        # rows that share a key with a wanted set may hold other sets
        whole = written(made.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), "whole")
        freed(pairs.sparkSession)
        pairs = likely.join(whole.select(F.col("set_id").alias("a"), F.col("grams").alias("ga")), "a")
        pairs = pairs.join(whole.select(F.col("set_id").alias("b"), F.col("grams").alias("gb")), "b")
        linked = checkpointed(pairs.select("a", "b", "ga", "gb").mapInArrow(_linked(self.rule), "a long, b long"))
        dropped(whole)
        return linked

    def classes(self) -> DataFrame:
        """(set_id, class): the class of every set that is linked to another."""
        postings = self.postings()
        freed(postings.sparkSession)
        blocks = postings.withColumn("block", F.explode(F.array("band", F.expr("band - 1"))))
        sizes = blocks.groupBy("gram", "block").agg(
            F.count("*").alias("sets"),
            *[F.min_by(F.struct("set_id", "n", "pos"), F.struct("pos", F.xxhash64(F.lit(r), "set_id"))).alias(f"p{r}") for r in range(PIVOTS)],
        )
        large = sizes.filter(F.col("sets") >= LARGE_BLOCK)
        met = blocks.alias("x").join(large.select("gram", "block", F.explode(F.array(*[f"p{r}" for r in range(PIVOTS)])).alias("y")), ["gram", "block"])
        ordered = [F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")]
        # pivots are met in their own blocks only, so their counts are not whole and rule nothing out
        links = self.verified(met.filter(f"x.set_id != y.set_id AND {self.near('x', 'y')}").select(*ordered).distinct())
        first = connected_components(links)

        # what is left: pairs whose classes differ
        classed = blocks.join(first.withColumnRenamed("node", "set_id"), "set_id", "left")
        classed = classed.withColumn("class", F.coalesce("component", "set_id")).select("gram", "block", "band", "set_id", "n", "pos", "class")
        per_class = classed.groupBy("gram", "block", "class").agg(F.count("*").alias("c"))
        main = per_class.groupBy("gram", "block").agg(F.sum("c").alias("sets"), F.count("*").alias("classes"), F.max_by("class", F.struct("c", "class")).alias("main"))
        open_blocks = main.filter("classes > 1").select("gram", "block", "main", "sets")
        inside = written(classed.join(open_blocks, ["gram", "block"]), "open")
        dropped(postings)
        # in a large block, only those outside its main class look for partners
        seekers = inside.filter(f"sets < {LARGE_BLOCK} OR class != main").alias("x")
        partners = inside.withColumn("seeks", F.expr(f"sets < {LARGE_BLOCK} OR class != main")).alias("y")
        met = seekers.join(partners, ["gram", "block"]).filter(
            "x.class != y.class AND (NOT y.seeks OR x.set_id < y.set_id) AND (x.band = block OR y.band = block) AND " + self.near("x", "y")
        )
        more = self.verified(self.product(met).select("a", "b"))
        dropped(inside)
        found = connected_components(links.unionByName(more))
        return found.withColumnRenamed("node", "set_id").withColumnRenamed("component", "class")


def near_duplicate_classes(df: DataFrame, rule: Rule, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: (doc, n_shingles, component_id).

    ``component_id`` is the least key of the class; a key is a long.
    """
    docs = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    join = _Join(docs, rule)
    named = join.sets.select("set_id", "doc").join(join.classes(), "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))
    least = named.groupBy("class").agg(F.min("doc").alias("component_id"))
    of_set = checkpointed(named.join(least, "class").select("set_id", "component_id"))
    out = join.members.join(of_set, "set_id", "left")
    return out.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def first_of_classes(df: DataFrame, rule: Rule, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, digest, rows): the key and text digest that come first in each class, and how many rows have both.

    Keys come in order, null last, then digests.  Texts without words are in no class;
    each of their keys and digests stands alone.
    """
    docs = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), text_digest(text).alias("digest"))
    join = _Join(docs, rule)
    of_set = checkpointed(join.sets.select("set_id").join(join.classes(), "set_id", "left").select("set_id", F.coalesce("class", "set_id").alias("class")))
    alone = F.when(F.col("class").isNull(), F.struct("doc", "digest")).alias("alone")
    rows = join.members.join(of_set, "set_id", "left").groupBy("class", "doc", "digest").agg(F.count("*").alias("rows"))
    first = rows.groupBy("class", alone).agg(F.min(F.struct(F.col("doc").isNull().alias("keyless"), "doc", "digest", "rows")).alias("first"))
    return first.select("first.doc", "first.digest", "first.rows")


def text_digest(text: str) -> Column:
    """16 bytes that tell texts apart; none for null."""
    return F.coalesce(F.unhex(F.md5(F.encode(F.col(f"`{text}`"), "UTF-8"))), F.lit(b""))
