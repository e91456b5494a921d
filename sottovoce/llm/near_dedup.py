"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each whole text becomes the set of its distinct word shingles (64-bit hashes). Texts with equal sets form a
   class; everything after this works on one representative of each class.
2. MinHash signatures are cut into bands; representatives that share a band key are candidates. In each bucket
   the member that shares most keys with others leads, and all members are paired with it alone, so that a
   group of copies gives a star and not all its pairs.
3. Pairs are compared batch by batch on their signatures. After each batch, the posterior of the similarity
   under a uniform prior is bounded: a pair goes once the probability that it reaches the threshold is below
   ``miss``. Survivors are confirmed on their full sets.
4. Links give components. A leader and all that it was paired with are a group. In groups that still hold several
   components, members are described by a consensus: the shingles they share with it, and their own. All are
   paired with the member nearest to it.
5. What is then left in different components has not been compared. By the sizes, each such pair has to share a
   certain number of own shingles; pairs that share one of their rarest (prefix filtering), and those close enough
   to the consensus to need none, are verified in the same way. Both conditions are exact for any consensus, so no
   link is lost, and copies with unrelated edits, which lie just below the threshold, do not meet at all.

With 42 bands of 6 rows a pair at similarity 0.80 misses every band with probability 3e-6, at 0.85 with 2e-9.

Edge cases: null and empty texts and texts without words have the empty set and are linked with nothing; a
text of fewer words than a shingle is one shingle; rows that share an id share a component; a row with a null
id is linked with nothing and kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, scratch, table

BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
PIECE = 1 << 17  # bytes of a text whose words are hashed together
SAMPLED = 32  # members of a group whose majority is its consensus
BATCH = 42  # signature values compared between two looks at the posterior
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FACTORS = np.random.default_rng(20240229).integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_FACTORS = np.random.default_rng(7).integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; powers of the base are kept between texts."""

    def __init__(self, width: int):
        self.width = width
        self.powers, self.inverses = self._tables(PIECE)

    @staticmethod
    def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return tuple(np.concatenate([[_U(1)], np.cumprod(np.full(n, x, dtype=np.uint64))]) for x in (_BASE, _INVERSE))

    def _words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words of one piece of the text."""
        powers, inverses = (self.powers, self.inverses) if len(raw) <= PIECE else self._tables(len(raw))
        sums = np.concatenate([[_U(0)], np.cumsum(_LOWER[raw] * powers[: len(raw)])])
        return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * _BASE)

    def __call__(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, dtype=np.uint8)
        inside = ~_SPACE[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        # Pieces of whole words keep the tables short, however long the text is.
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PIECE // 2, len(raw), PIECE // 2)), [len(ends)]]))
        word = np.concatenate([self._words(raw[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        k = min(self.width, len(word))
        n = len(word) - k + 1
        out = word[:n] + _U(k)
        for j in range(1, k):
            out = mixed(out * _BASE + word[j : j + n])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a set that is not empty."""
    x = (shingles >> _U(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 2048):
        for f in range(0, HASHES, 42):
            out[f : f + 42] = np.minimum(out[f : f + 42], (_FACTORS[f : f + 42, None] * x[None, i : i + 2048]).min(axis=1))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    folded = (sig.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return mixed(folded + np.arange(BANDS, dtype=np.uint64) * _BASE).view(np.int64)


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch, the number of equal values below which a pair goes.

    With a uniform prior and m of n values equal, the posterior is Beta(m + 1, n - m + 1), and the probability
    of a similarity of at least t is that of at most m successes in n + 1 trials at t.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < miss:
            m += 1
        out.append(m)
    return out


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, d1, d2, sig, bands); d1 and d2 tell sets apart, sig keeps 16 bits of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in batches:
            n, d1, d2, sigs, bands = [], [], [], [], []
            for text in _texts(batch.column("text")):
                s = cut(text)
                n.append(len(s))
                d1.append(int(mixed(s ^ _BASE).sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(mixed(s + _INVERSE).sum(dtype=np.uint64).view(np.int64)))
                sig = signature(s) if len(s) else None
                sigs.append(None if sig is None else sig.astype(np.uint16).tobytes())
                bands.append(None if sig is None else band_keys(sig))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n_shingles", "d1", "d2", "sig", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) from (id, text); the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in batches:
            sets = [cut(t).tobytes() for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles binary")


def likely(pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) that no look at the posterior rules out."""
    least = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
            for i, m in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, set_a, set_b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that the links (a, b) reach, for every node in them.

    Each round takes the least label among the neighbours and then the label of that label, so long chains
    shrink fast. Labels are written each round; what the driver sees is one count.
    """
    edges = scratch(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = scratch(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("a") == F.col("node")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("f"), F.col("label").alias("further"))
        labels = scratch(least.join(far, F.col("f") == F.col("label")).select("node", "was", F.least("label", "further").alias("label")), "labels")
        if labels.filter("label < was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    spark = docs.sparkSession
    with batches_of(spark, 2000):
        sketches = scratch(sketch(docs, width, id_col, text_col), "sketches")
    key = ["n_shingles", "d1", "d2"]
    classes = scratch(sketches.filter("n_shingles > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("class")), "classes")
    heads = sketches.join(classes.withColumnRenamed("class", "id"), [*key, "id"])
    keys = heads.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = scratch(keys.join(scratch(shared, "buckets"), "key"), "members")
    weight = scratch(members.groupBy("id").agg(F.sum("m").alias("w")), "weights")
    # Sets and signatures only of texts that share a bucket with another.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with batches_of(spark, 2000):
        sets = scratch(shingle_sets(texts.join(weight.select("id"), "id"), width), "sets")
    sigs = scratch(heads.select("id", "sig").join(weight.select("id"), "id"), "signatures")

    def verified(pairs: DataFrame) -> DataFrame:
        def beside(df: DataFrame, what: DataFrame, column: str, name: str) -> DataFrame:
            for side in ("a", "b"):
                df = df.join(what.select(F.col("id").alias(side), F.col(column).alias(f"{name}_{side}")), side)
            return df

        with batches_of(spark, 1000):
            survivors = scratch(likely(beside(pairs, sigs, "sig", "sig"), percent, miss), "survivors")
        with batches_of(spark, 200):
            return scratch(confirmed(beside(survivors, sets, "shingles", "set"), percent).distinct(), "links")

    lead = members.join(weight, "id").groupBy("key").agg(F.max(F.struct(F.col("w"), (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("lead"))
    stars = members.join(scratch(lead, "leaders"), "key").filter(F.col("lead") != F.col("id")).select("lead", "id").distinct()
    stars = scratch(stars, "stars")
    links = verified(_ordered(stars.select(F.col("lead").alias("a"), F.col("id").alias("b"))))
    labels = components(links)

    def labelled(df: DataFrame) -> DataFrame:
        return df.join(labels, df["id"] == F.col("node"), "left").select(*df.columns, F.coalesce("label", "id").alias("label"))

    groups = stars.union(stars.select("lead", F.col("lead").alias("id")).distinct())
    parts = labelled(groups).groupBy("lead").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y"))
    groups = groups.join(scratch(parts.filter("m > 2 and x < y").select("lead"), "open"), "lead")
    apart = differences(groups, sets)
    centre = apart.groupBy("lead").agg(F.min(F.struct("d", "id")).alias("top")).select("lead", F.col("top.id").alias("centre"))
    centre = scratch(centre, "centres")
    near = labelled(apart.select("lead", "id").join(centre, "lead"))
    near = near.join(labelled(centre.select(F.col("lead").alias("of"), F.col("centre").alias("id"))).select("of", F.col("label").alias("main")), F.col("lead") == F.col("of")).filter("label != main")
    second = verified(_ordered(near.select(F.col("centre").alias("a"), F.col("id").alias("b"))))
    if not second.isEmpty():
        links = links.union(second)
        labels = components(links)
    apart = labelled(apart)
    main = labelled(centre.select("lead", F.col("centre").alias("id"))).select("lead", F.col("label").alias("main"))
    third = verified(_ordered(sharing_rare(apart, percent).union(within_consensus(apart, scratch(main, "main"), percent))))
    if not third.isEmpty():
        labels = components(links.union(third))
    return _result(sketches, classes, labels, key)


def differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, id, n, c, d, own) for the members (lead, id) of each group: set size, shingles in the group's consensus,
    shingles that only one of the two has, and the member's own shingles, which the consensus lacks.

    The consensus holds what more than half of up to ``SAMPLED`` members share, one member for each value of a hash.
    It only decides how much work is left, so it need not be exact.
    """
    placed = groups.join(sets, "id")
    picked = groups.groupBy("lead", F.pmod(F.xxhash64("id"), F.lit(SAMPLED)).alias("cell")).agg(F.min("id").alias("id")).select("lead", "id")
    gathered = picked.join(sets, "id").groupBy("lead").agg(F.collect_list("shingles").alias("some"))

    def consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for some in batch.column("some"):
                shingle, times = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in some.values]), return_counts=True)
                out.append(shingle[2 * times > len(some.values)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lead"), pa.array(out, pa.binary())], ["lead", "common"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c, d, own = [], [], [], []
            for x, y in zip(batch.column("shingles"), batch.column("common"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                own.append(np.setdiff1d(s, t, assume_unique=True).view(np.int64))
                n.append(len(s))
                c.append(len(s) - len(own[-1]))
                d.append(len(s) + len(t) - 2 * c[-1])
            numbers = [pa.array(v, pa.int64()) for v in (n, c, d)]
            yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("id"), *numbers, pa.array(own, pa.list_(pa.int64()))], ["lead", "id", "n", "c", "d", "own"])

    with batches_of(groups.sparkSession, 100):
        common = scratch(gathered.mapInArrow(consensus, "lead long, common binary"), "consensus")
        return scratch(placed.join(common, "lead").select("lead", "id", "shingles", "common").mapInArrow(compare, "lead long, id long, n long, c long, d long, own array<long>"), "differences")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of sets of n and m shingles that are linked."""
    return F.ceil((n + m) * percent / (100 + percent) - 1e-6)


def _missing(x: str, y: str, percent: int) -> Column:
    """How many shingles outside the consensus x and y have to share to be linked."""
    return _overlap(F.col(f"{x}.n"), F.col(f"{y}.n"), percent) - F.least(F.col(f"{x}.c"), F.col(f"{y}.c"))


def sharing_rare(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one group that may share enough of their own shingles to be linked.

    Members that need k common shingles of their own share one of the a - k + 1 that come first in any order in
    which both list them. Rare ones come first here, so a shingle that many members have is rarely among these.
    """
    own = apart.select("lead", "id", F.explode("own").alias("e"))
    often = scratch(own.groupBy("lead", "e").agg(F.count("*").alias("f")).filter("f > 1"), "shared-shingles")
    listed = own.join(often, ["lead", "e"]).groupBy("lead", "id").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("es"))
    listed = listed.join(apart.select("lead", "id", "n", "c", "label"), ["lead", "id"])
    # Shingles of one member alone come before all of these.
    alone = F.col("n") - F.col("c") - F.size("es")
    least = F.greatest(F.ceil(F.col("n") * percent / 100 - 1e-6) - F.col("c"), F.lit(1))
    first = F.greatest(F.col("n") - F.col("c") - least + 1 - alone, F.lit(0)).cast("int")
    rows = listed.select("lead", "id", "n", "c", "label", alone.alias("alone"), F.posexplode(F.slice("es", F.lit(1), first)).alias("pos", "e"))
    rows = scratch(rows.select("lead", F.col("e.e").alias("e"), F.struct("id", "n", "c", "label", (F.col("pos") + F.col("alone")).alias("at")).alias("x")), "rare")
    # Members of a shingle's most frequent component need not meet one another.
    kinds = rows.groupBy("lead", "e", "x.label").agg(F.count("*").alias("m")).groupBy("lead", "e").agg(F.max(F.struct("m", "label")).alias("most"), F.count("*").alias("kinds"))
    kinds = scratch(kinds.filter("kinds > 1").select("lead", "e", F.col("most.label").alias("most")), "rare-open")
    left = rows.join(kinds, ["lead", "e"]).filter("x.label != most").select("lead", "e", "x")
    right = rows.join(kinds.select("lead", "e"), ["lead", "e"]).select("lead", "e", F.col("x").alias("y"))
    need = _missing("x", "y", percent)
    fits = (need >= 1) & (F.col("x.at") <= F.col("x.n") - F.col("x.c") - need) & (F.col("y.at") <= F.col("y.n") - F.col("y.c") - need)
    return left.join(right, ["lead", "e"]).filter(F.col("x.label") != F.col("y.label")).filter(fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def within_consensus(apart: DataFrame, main: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one group in which both share so much with the consensus that they may be linked by that alone.

    Their sizes then lie in a narrow range, so they meet by bins of the size. One is outside the centre's component.
    """
    close = apart.filter(F.col("c") * 100 >= F.col("n") * percent).select("lead", F.struct("id", "n", "c", "label").alias("x"))
    size_bin = lambda n: F.when(n <= 100, n.cast("double")).otherwise(F.floor(100 + 100 * F.log(n / 100.0)))
    low = size_bin(F.floor(F.col("x.n") * percent / 100))
    high = size_bin(F.ceil(F.least(F.col("x.c") * (100 + percent) / percent - F.col("x.n"), F.col("x.n") * 100 / percent)) + 1)
    left = close.join(main, "lead").filter("x.label != main").select("lead", "x", F.explode(F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))).alias("bin"))
    right = close.select("lead", F.col("x").alias("y"), size_bin(F.col("x.n")).cast("long").alias("bin"))
    return left.join(right, ["lead", "bin"]).filter(F.col("x.label") != F.col("y.label")).filter(_missing("x", "y", percent) <= 0).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _result(sketches: DataFrame, classes: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    roots = scratch(classes.join(labels, F.col("class") == F.col("node"), "left").select(*key, F.coalesce("label", "class").alias("root")), "roots")
    component: Column = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    out = sketches.select("id", *key).join(roots, key, "left").select("id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_near_dedup": op9_near_dedup}
