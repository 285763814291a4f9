"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Texts with equal words become one node (grouped by digest, reduced in every
   task first).  A worker computes each text's signature of ``BANDS * ROWS`` 16-bit
   MinHash values; the signature is stored as one 64-bit number per band.
2. Nodes that share a band are candidates.  Not every pair is compared: each
   bucket has a pivot, and its members are compared with that only.
3. Sequential Bayesian verification: signatures are compared a batch at a time;
   a pair goes as soon as the posterior probability that its similarity reaches
   the threshold (uniform prior) falls under ``MISS``.
4. Survivors are verified exactly on the full sets of word shingles.
   The first pivot of a bucket is its node with most candidates.
5. Confirmed links give components.  Before all else each node meets the most central
   node of all its buckets, which links most of a group of near copies with one
   comparison each.  Members of a bucket that lie in different components are still
   open.  They meet their bucket's pivot; where a pivot leaves many open, these are
   dealt into buckets by the shingles that the pivot lacks (see ``_spread``).  Of
   buckets with equal members one is kept.  Then the
   pivot leaves and others take its place, eight times as many each round, until no
   bucket spans two components.
   So every candidate pair is either compared or already connected; a group of
   near copies costs about one comparison per member instead of all pairs.

Nothing is collected to the driver but counts.  Every step is written to the
shared folder before the next one reads it.

Defined results: a null text has no words, an empty set and no links; repeated
rows are one document each and fall into one component; a null ``doc_id`` counts
as the smallest long and is given back as null in ``doc_id``; an empty table gives
no rows; further columns aren't read (``drop_near_copies`` passes them through).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import lower_ascii, materialise, text_or_empty, words
from keepsake.session import ship_package

SHINGLE = 5
#: Linked from this similarity in percent.
PERCENT = 75
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
#: Signature values compared before a pair is judged again.
BATCH = 16
#: Miss probability at which a pair is pruned.
MISS = 1e-6
#: Characters of text that are hashed at a time.
PIECE = 1 << 20
NO_ID = -(2 ** 63)
#: Open members of one pivot from which on they are spread by the shingles that the pivot lacks.
MANY = 32
#: Pivots a bucket up to which a round ends with spreading.
SPREAD = 8

_RNG = np.random.default_rng(20240601)
_BYTES = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64)
_BYTES[[10, 32]] = 0
_PLACE = _RNG.integers(0, 2 ** 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = (_RNG.integers(0, 2 ** 31, HASHES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
_ADD = _RNG.integers(0, 2 ** 32, HASHES, dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for one piece of text."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 2 ** 64)):
            p = np.full(4 * PIECE + 8, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(piece: bytes) -> np.ndarray:
    """64-bit hashes of the words of a piece, in which single blanks separate words."""
    up, down = _powers()
    raw = np.frombuffer(piece + b" ", np.uint8)
    sums = np.cumsum(_BYTES[raw] * up[:len(raw)])
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return _mix((sums[ends] - before) * down[starts] + (ends - starts).astype(np.uint64) * _PLACE[0])


def _hash_words(text: str) -> np.ndarray:
    """Word hashes of one text of any length, piece by piece."""
    parts, at = [], 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at, at + PIECE)
        if cut <= at:  # one word longer than a piece: fold its parts
            end = text.find(" ", at)
            end = len(text) if end < 0 else end
            h = np.uint64(0)
            for k in range(at, end, PIECE):
                h = _mix(np.array([h], np.uint64) * _PLACE[1] + _word_hashes(text[k:min(k + PIECE, end)].encode()))[0]
            parts.append(np.array([h], np.uint64))
            at = end + 1
        else:
            parts.append(_word_hashes(text[at:cut].encode()))
            at = cut + 1
    if at < len(text) or not parts:
        parts.append(_word_hashes(text[at:].encode()))
    return np.concatenate(parts)


def _shingle_hashes(w: np.ndarray) -> np.ndarray:
    if len(w) < SHINGLE:
        whole = sum(int(x) * int(p) for x, p in zip(w, _PLACE)) + len(w) * int(_PLACE[4])
        return _mix(np.array([whole % 2 ** 64], np.uint64))
    n = len(w) - SHINGLE + 1
    h = w[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        h = h + w[k:k + n] * _PLACE[k]
    return _mix(h)


def sign(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct shingles, signatures as one 64-bit number per band) of texts with single blanks."""
    counts = np.zeros(len(texts), np.int64)
    signature = np.zeros((len(texts), HASHES), np.uint16)
    group: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush():
        nonlocal held
        if not group:
            return
        hashes = np.concatenate([h for _, h in group])
        at = np.concatenate([[0], np.cumsum([len(h) for _, h in group])[:-1]])
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        rows = [i for i, _ in group]
        for k in range(HASHES):
            least = np.minimum.reduceat(x * _MUL[k] + _ADD[k], at)
            signature[rows, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        group.clear()
        held = 0

    for i, t in enumerate(texts):
        if t:
            h = np.unique(_shingle_hashes(_hash_words(t)))
            counts[i] = len(h)
            group.append((i, h))
            held += len(h)
            if held > 100_000:
                flush()
    flush()
    return counts, signature.view(np.uint64).astype(np.int64)


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            n, sig = sign(b.column("norm").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(n) + 1, BANDS, dtype=np.int32)),
                                             pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("own"), b.column("digest"), pa.array(n), lists],
                                             names=["doc_id", "own", "digest", "n_shingles", "sig"])


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Matches among ``n`` values below which P(similarity >= percent) < miss, from a uniform prior."""
    t = percent / 100
    for m in range(n + 1):
        # the posterior is Beta(m + 1, n - m + 1): its upper tail is a binomial sum
        tail = sum(math.comb(n + 1, j) * t ** j * (1 - t) ** (n + 1 - j) for j in range(m + 1))
        if tail >= miss:
            return m
    return n + 1


def plausible(a: np.ndarray, b: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Which rows of two signature arrays survive sequential comparison."""
    alive = np.arange(len(a))
    found = np.zeros(len(a), np.int64)
    for at in range(0, HASHES, BATCH):
        found[alive] += (a[alive, at:at + BATCH] == b[alive, at:at + BATCH]).sum(axis=1)
        alive = alive[found[alive] >= least_matches(at + BATCH, percent, miss)]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, HASHES)


def _prune(percent: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = plausible(_values(b.column("sig_a")), _values(b.column("sig_b")), percent, miss)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))
    return run


def shingle_set(text: str) -> set:
    w = text.split(" ")
    return set(zip(*(w[k:] for k in range(SHINGLE)))) if len(w) >= SHINGLE else {tuple(w)}


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot, pivot_set = None, set()
        for rows in batches:
            ok = []
            for b, ta, tb in zip(rows["b"], rows["text_a"], rows["text_b"]):
                if b != pivot:
                    pivot, pivot_set = b, shingle_set(tb)
                own = shingle_set(ta)
                both = len(own & pivot_set)
                ok.append(100 * both >= percent * (len(own) + len(pivot_set) - both))
            yield rows.loc[ok, ["a", "b"]]
    return run


def _outside(percent: int):
    """For members and their pivot: set size, shingles in common, and hashes of shingles outside the pivot."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot, pivot_hashes = None, None
        for rows in batches:
            sizes, commons, outside = [], [], []
            for p, ta, tb in zip(rows["pivot"], rows["text_a"], rows["text_b"]):
                if p != pivot:
                    pivot, pivot_hashes = p, np.unique(_shingle_hashes(_hash_words(tb)))
                own = np.unique(_shingle_hashes(_hash_words(ta)))
                other = np.setdiff1d(own, pivot_hashes, assume_unique=True)
                common = len(own) - len(other)
                least = max(1, -(-percent * len(own) // 100) - common)
                sizes.append(len(own))
                commons.append(common)
                outside.append(other[:max(0, len(other) - least + 1)].astype(np.int64))
            yield rows[["pivot", "node", "comp", "degree"]].assign(size=sizes, common=commons, outside=outside)
    return run


def normal_text(text: Column) -> Column:
    """Words with A-Z lower-cased, separated by one blank."""
    return F.array_join(words(lower_ascii(text_or_empty(text))), " ")


def _based(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    uid = F.col(f"`{id_col}`").cast("long")
    return (docs.select(uid.alias("doc_id"), F.coalesce(uid, F.lit(NO_ID)).alias("own"),
                        normal_text(F.col(f"`{text_col}`")).alias("norm"))
            .withColumn("digest", F.unhex(F.sha2("norm", 256))))


class NearGroups:
    """The near-duplicate components of one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                 miss: float = MISS):
        ship_package(docs.sparkSession)
        self.percent, self.miss = percent, miss
        based = _based(docs, id_col, text_col)
        self.rows = materialise(based.mapInArrow(
            _sign_batches, "doc_id long, own long, digest binary, n_shingles long, sig array<long>"))
        self.nodes = materialise(
            self.rows.filter("n_shingles > 0").groupBy("digest")
            .agg(F.min("own").alias("own"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
            .withColumn("node", F.monotonically_increasing_id()))
        self.texts: DataFrame | None = None
        self.based = based
        self.comps = self._components()

    def _texts_of(self, members: DataFrame) -> DataFrame:
        """(node, text) of every candidate, written once."""
        wanted = members.select("node").distinct().join(self.nodes.select("node", "digest", "own"), "node")
        got = self.based.select("digest", "own", "norm").join(wanted, ["digest", "own"])
        return materialise(got.groupBy("digest", "own").agg(F.first("node").alias("node"), F.first("norm").alias("text"))
                           .select("node", "text"))

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose similarity is verified."""
        sig = self.nodes.select("node", "n", "sig")
        left = sig.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        right = sig.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        sized = pairs.join(left, "a").join(right, "b").filter(
            100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        kept = materialise(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(self.percent, self.miss), "a long, b long"))
        ta = self.texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        tb = self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        texts = kept.join(ta, "a").join(tb, "b")
        return materialise(texts.mapInPandas(_verify(self.percent), "a long, b long"))

    def _components(self) -> DataFrame:
        """(node, comp) of the nodes that have a link."""
        bands = self.nodes.select("node", F.col("n").alias("size"), F.posexplode("sig").alias("band", "value"))
        shared = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        members = materialise(bands.join(shared, ["band", "value"]))
        degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
        members = materialise(members.drop("n").join(degree, "node").withColumn("comp", F.col("node")))
        comps = members.sparkSession.createDataFrame([], "node long, comp long")
        if not members.isEmpty():
            self.texts = self._texts_of(members)
            # each node meets the most central node of all its buckets first: a group of near copies is mostly linked by that
            best = F.max(F.struct("degree", (-F.col("node")).alias("less")))
            centre = members.groupBy("band", "value").agg(best.alias("c"))
            nearest = members.join(centre, ["band", "value"]).groupBy("node").agg(F.max("c").alias("c"))
            nearest = nearest.select("node", (-F.col("c.less")).alias("b")).filter("node <> b")
            comps = self._linked(comps, nearest)
            members = self._open(members, comps)
        pivots = 1
        while not members.isEmpty():
            slot = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots))
            best = F.max(F.struct("degree", (-F.col("node")).alias("less"), "comp", "size"))
            pivot = materialise(members.groupBy("band", "value", slot.alias("slot")).agg(best.alias("p")).select(
                "band", "value", (-F.col("p.less")).alias("b"), F.col("p.comp").alias("comp_b"), F.col("p.size").alias("size_b")))
            own = pivot.select("band", "value", F.col("b").alias("node"), F.lit(True).alias("is_pivot"))
            members = members.join(own, ["band", "value", "node"], "left")
            # two pivots of a bucket meet once; sets too unlike in size can't be linked
            meet = ((F.col("comp") != F.col("comp_b")) & (F.col("is_pivot").isNull() | (F.col("node") > F.col("b")))
                    & (100 * F.least("size", "size_b") >= self.percent * F.greatest("size", "size_b")))
            comps = self._linked(comps, members.join(pivot, ["band", "value"]).filter(meet).select("node", "b"))
            rest = members.filter("is_pivot is null").drop("is_pivot")
            spread = pivots <= SPREAD
            if spread:
                centre = pivot.groupBy("band", "value").agg(F.min("b").alias("pivot"))
                rest = rest.join(centre, ["band", "value"])
            members = self._open(materialise(rest), comps)
            if spread and not members.isEmpty():
                members, comps = self._spread(members, comps)
            pivots *= 8
        return comps

    def _linked(self, comps: DataFrame, pairs: DataFrame) -> DataFrame:
        """Components after verifying pairs of nodes."""
        a, b = pairs.columns
        links = self._links(materialise(pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()))
        return comps if links.isEmpty() else self._merged(comps, links)

    def _open(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members with their present components, of the buckets that lie in more than one; of equal buckets one."""
        now = materialise(members.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        open_ = now.groupBy("band", "value").agg(
            F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("i")).filter("x < y")
        one = open_.groupBy("x", "y", "n", "h", "i").agg(F.min(F.struct("band", "value")).alias("one"))
        return materialise(now.join(one.select("one.*"), ["band", "value"]))

    def _spread(self, members: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Replaces the buckets of a pivot that has many open members by smaller ones.

        Of the shingles that two members share, the pivot has at most as many as
        it shares with either.  If that isn't enough to reach the threshold, the
        two share a shingle outside the pivot: they meet in a bucket of one of
        those (of the first so many in a fixed order that one must be common).
        The other pairs are close in size and are compared directly.
        """
        group = members.groupBy("pivot", "node").agg(F.first("comp").alias("comp"), F.first("degree").alias("degree"))
        many = group.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY).select("pivot")
        few = members.join(many, "pivot", "left_anti").drop("pivot")
        ta = self.texts.select("node", F.col("text").alias("text_a"))
        tb = self.texts.select(F.col("node").alias("pivot"), F.col("text").alias("text_b"))
        rest = materialise(
            group.join(many, "pivot").join(ta, "node").join(tb, "pivot")
            .select("pivot", "node", "comp", "degree", "text_a", "text_b")
            .mapInPandas(_outside(self.percent), "pivot long, node long, comp long, degree long, size long, common long, "
                                                 "outside array<long>"))
        # similarity t needs t / (1 + t) of both sizes in common; here in whole numbers
        share, whole = self.percent, 100 + self.percent
        home = comps.select(F.col("node").alias("pivot"), F.col("comp").alias("home"))
        away = rest.join(home, "pivot", "left").filter(F.col("comp") != F.coalesce("home", "pivot"))
        low = F.ceil(F.col("size") * self.percent / 100)
        high = F.floor(F.col("common") * whole / share) - F.col("size")
        x = away.filter(low <= high).select("pivot", F.col("node").alias("x"), F.col("comp").alias("comp_x"),
                                            F.explode(F.sequence(low, high)).alias("size"))
        near = (x.join(rest.select("pivot", "node", "comp", "size", "common"), ["pivot", "size"])
                .filter("comp <> comp_x"))
        sizes = away.select("pivot", F.col("node").alias("x"), F.col("size").alias("size_x"))
        near = near.join(sizes, ["pivot", "x"]).filter(
            F.col("common") * whole >= share * (F.col("size") + F.col("size_x")))
        comps = self._linked(comps, near.select("x", "node"))
        tokens = rest.select(F.lit(-1).alias("band"), F.explode("outside").alias("token"), "pivot", "node", "degree", "comp",
                             "size")
        small = tokens.select("band", F.xxhash64("pivot", "token").alias("value"), "node", "degree", "comp", "size")
        return self._open(materialise(few.select(*small.columns).unionByName(small)), comps), comps

    def _merged(self, comps: DataFrame, links: DataFrame) -> DataFrame:
        """Components after adding links: contracted to the old components, then joined to all nodes."""
        old = comps.select("node", "comp")

        def named(df: DataFrame, c: str) -> DataFrame:
            o = old.select(F.col("node").alias(c), F.col("comp").alias(f"c_{c}"))
            return df.join(o, c, "left").withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))
        edges = named(named(links, "a"), "b").filter("c_a <> c_b").select(
            F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()
        root = connected(materialise(edges))
        touched = links.select(F.explode(F.array("a", "b")).alias("node")).unionByName(old.select("node")).distinct()
        base = touched.join(old, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        r = root.select(F.col("node").alias("comp"), "root")
        return materialise(base.join(r, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))

    def report(self) -> DataFrame:
        """One row per document: doc_id, own, digest, n_shingles, component_id."""
        n = self.nodes.select("digest", "node", F.col("own").alias("first"))
        placed = n.join(self.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
        by_digest = placed.join(least, "comp").select("digest", "component_id")
        out = self.rows.select("doc_id", "own", "digest", "n_shingles").join(by_digest, "digest", "left")
        return out.withColumn("component_id", F.coalesce("component_id", "own"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by passing on labels and shortcutting them."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hop = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = materialise(near.join(hop, "root").select("node", "old", F.col("next").alias("root")))
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id linked), kept."""
    out = NearGroups(docs, id_col, text_col).report()
    return out.select("doc_id", "n_shingles", "component_id", (F.col("own") == F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which no linked document has a smaller id, with their own columns.

    Rows that repeat both id and words can't be told apart by those: all of them stay or go.
    """
    names = docs.columns
    keep = (NearGroups(docs, id_col, text_col).report().filter("own = component_id")
            .select(F.col("own").alias("k_own"), F.col("digest").alias("k_digest")).distinct())
    row = F.struct([F.col(f"`{c}`") for c in names]).alias("row")
    uid = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    norm = normal_text(F.col(f"`{text_col}`"))
    rows = docs.select(row, uid.alias("own"), norm.alias("norm")).select(
        "row", "own", F.unhex(F.sha2("norm", 256)).alias("digest"))
    out = rows.join(keep, (F.col("own") == F.col("k_own")) & (F.col("digest") == F.col("k_digest")), "left_semi")
    return out.select([F.col("row").getField(c).alias(c) for c in names])
