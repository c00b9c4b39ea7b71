"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. Sketch (one scan): the words of a text give weighted five-word shingles.  Every shingle is a
   Poisson process whose rate is its weight; an arrival hits one of the sketch's components, and
   each component keeps its earliest shingle.  A process stops once its next arrival would be later
   than every component's.  Two sketches agree in a component with the probability Jaccard of
   their weighted shingle sets.  Weights lie between 1 and ``HEAVIEST``, so this is at least the
   plain Jaccard divided by ``HEAVIEST``, however often two texts repeat their shingles.
2. Banding: texts with the same sketch rows in a band share a bucket.  Equal texts are one node.
3. Verification: texts are compared by the Jaccard of their whole shingle sets.  A bucket is never
   expanded into rows of pairs: its members are compared with a hub, and linked members become one
   class.  What then lies in different classes of a bucket, and could be near by size and by the
   triangle inequality of the Jaccard distance to the hub, is dealt in tiles of bounded size; a
   tile counts common shingles by matrix products and returns links between classes only.
4. Classes are connected components of the links.

Nodes, links and sets stay in tables; the driver sees counts only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried_id, discard, expand_copies, keep_rows, materialize, restored_id, text_or_empty

_G = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Jaccard distances are compared with this slack for rounding.
EPS = 1e-9
#: No shingle weighs more; a shingle that occurs once weighs 1.
HEAVIEST = 1.05


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit codes of word shingles; words are cached up to ``keep``."""

    def __init__(self, width: int = 5, keep: int = 120_000):
        self.width, self._keep, self._words = width, keep, {}

    def _word(self, word: bytes) -> bytes:
        found = hashlib.blake2b(word, digest_size=8).digest()
        if len(word) <= 48:
            self._words[word] = found
        return found

    def codes(self, text: str) -> np.ndarray:
        """Code of every shingle, repeats included.  A shorter text is one shingle, an empty one none."""
        words = text.encode().lower().split()
        if len(self._words) > self._keep:
            self._words.clear()
        get = self._words.get
        w = np.frombuffer(b"".join([get(x) or self._word(x) for x in words]), dtype="<u8")
        if not len(w):
            return w
        width = min(self.width, len(w))
        code = np.zeros(len(w) - width + 1, dtype=np.uint64)
        for i in range(width):
            code = _mix(code + w[i : i + len(code)] + _G)
        return code


def shingle_weights(counts: np.ndarray) -> np.ndarray:
    """Weights of shingles by their number in a text, rising from 1 towards HEAVIEST.

    The probability Jaccard of weights a, b sums 1 / sum_e max(a_e / a_d, b_e / b_d) over the common
    shingles d.  No ratio exceeds HEAVIEST, so it is at least |common| / (HEAVIEST |all|).
    """
    return 1.0 + (HEAVIEST - 1.0) * (1.0 - 1.0 / counts)


def prob_minhash(codes: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, size: int) -> np.ndarray:
    """ProbMinHash sketches (docs x size) of many weighted sets at once.

    ``codes``, ``weights`` and ``doc`` (set number) describe the elements.  Each round draws the
    next arrival of every process that is still early enough to matter.
    """
    earliest = np.full(docs * size, np.inf)
    sketch = np.zeros(docs * size, dtype=np.uint64)
    time, state = np.zeros(len(codes)), codes.copy()
    alive = np.arange(len(codes))
    while len(alive):
        state = _mix(state + _G)
        time = time - np.log((state >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights[alive]
        place = doc[alive] * size + ((_mix(state ^ _B) >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        before = earliest[place]
        early = time < before
        np.minimum.at(earliest, place[early], time[early])
        won = early & (time == earliest[place])
        sketch[place[won]] = codes[alive[won]]
        latest = earliest.reshape(docs, size).max(axis=1)
        stay = time < latest[doc[alive]]
        alive, time, state = alive[stay], time[stay], state[stay]
    return sketch.reshape(docs, size)


SKETCH = "doc_id long, nameless boolean, text_hash long, node binary, size int, bands array<long>, shingles binary"


def _sketcher(width: int, bands: int, rows: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen = Shingler(width), set()
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                yield one(pdf.iloc[lo : lo + 256], shingler, seen)

    def one(pdf: pd.DataFrame, shingler: Shingler, seen: set) -> pd.DataFrame:
        nodes, sizes, texts, fresh = [], [], [], []
        for text in pdf["text"]:
            words = b" ".join(text.encode().lower().split())
            node = hashlib.blake2b(words, digest_size=16).digest()
            nodes.append(node)
            new = node not in seen
            if new and len(seen) < 50_000:  # later copies in this task need no sketch of their own
                seen.add(node)
            fresh.append(new and bool(words))
            texts.append(text)
        sets = [np.unique(shingler.codes(t), return_counts=True) if f else None for t, f in zip(texts, fresh)]
        made = [s for s in sets if s is not None]
        band_rows, blobs = [None] * len(pdf), [None] * len(pdf)
        if made:
            sizes = np.array([len(c) for c, _ in made])
            counts = np.concatenate([n for _, n in made]).astype(np.float64)
            sk = prob_minhash(np.concatenate([c for c, _ in made]), shingle_weights(counts), np.repeat(np.arange(len(made)), sizes), len(made), bands * rows)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _G, (len(made), bands)).copy()
            for r in range(rows):
                key = _mix(key + sk.reshape(len(made), bands, rows)[:, :, r] + _G)
            key = key.astype(np.int64)
            at = 0
            for i, s in enumerate(sets):
                if s is not None:
                    band_rows[i] = key[at]
                    blobs[i] = np.unique((s[0] >> np.uint64(32)).astype("<u4")).tobytes()  # 32 bits of each shingle
                    at += 1
        lengths = [0 if b is None else len(b) // 4 for b in blobs]
        return pdf[["doc_id", "nameless", "text_hash"]].assign(node=nodes, size=lengths, bands=band_rows, shingles=blobs)

    return sketch


def connect(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``links`` (a, b): (node, root), root the least node.

    Large-star and small-star steps in turn; each halves the remaining depth.  Grouping on a hub
    with many links takes a minimum, which Spark combines before the shuffle.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour is linked to the least of the neighbourhood
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, name)
        # small star: a node and its smaller neighbours are linked to the least of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, name)
        now = small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(large), discard(edges)  # ``small`` is written and reads neither
        edges = small
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``jaccard`` of the whole shingle sets."""

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out)

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").withColumn("jaccard", jaccard("x", "y")).drop("x", "y")


#: Members of a bucket that a tile holds on each side.
TILE = 512
#: Shingles that a tile counts at once.
COLUMNS = 4096


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every two of the given distinct arrays."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[place] > 1  # an element of one set only is common to none
    number = np.cumsum(counts > 1) - 1
    owner, place = owner[shared], number[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int((counts > 1).sum()), COLUMNS):
        i, j = np.searchsorted(place, [lo, lo + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[i:j], place[i:j] - lo] = 1.0
        out += block @ block.T
    return out


def _tile_links(least: float):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, "<u4") for x in pdf["shingles"]]
        sizes = np.array([len(s) for s in sets], np.float32)
        roots, first, root = np.unique(pdf["root"].to_numpy(), return_index=True, return_inverse=True)
        both = common_counts(sets)
        near = both >= (least - EPS) * (sizes[:, None] + sizes[None, :] - both)
        a, b = np.nonzero(near & (root[:, None] < root[None, :]))
        pairs = np.unique(np.stack([root[a], root[b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), int)
        return pd.DataFrame({"a": [roots[x] for x in pairs[:, 0]], "b": [roots[x] for x in pairs[:, 1]]})

    return links


def link_buckets(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Components over all pairs of one bucket whose Jaccard is at least ``least``: (node, root).

    ``members`` (bucket, node, size) may hold buckets of any number of nodes; ``sets`` (node,
    shingles) is their exact form.  Nodes without a link are left out.  Tables that grow with the
    input are joined by shuffles at every size, never broadcast.
    """
    short = F.xxhash64("node")
    busy = members.groupBy("bucket").agg(F.min(short).alias("h0"), F.max(short).alias("h1"), F.count(F.lit(1)).alias("n")).filter("h0 <> h1")
    company = materialize(members.join(busy.select("bucket", "n").hint("merge"), "bucket"), "near-company").distinct()
    # a text that others were copied from shares more and larger buckets than its copies: it is the hub
    degree = company.groupBy("node").agg(F.sum("n").alias("degree"))
    sets = materialize(sets.join(degree.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    ranked = company.join(degree.hint("merge"), "node").withColumn("turn", F.struct(-F.col("degree"), F.xxhash64("bucket", "node"), "node", "size"))
    hubs = ranked.groupBy("bucket").agg(F.min("turn").alias("hub")).select("bucket", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"))
    shared = materialize(company.select("bucket", "node", "size").join(hubs.hint("merge"), "bucket"), "near-shared")
    possible = F.least("size", "hub_size") >= F.lit(least) * F.greatest("size", "hub_size")
    first = shared.filter((F.col("node") != F.col("hub")) & possible).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tested = materialize(_verified(first, sets), "near-tested")
    links = tested.filter(F.col("jaccard") >= least - EPS).select("a", "b")
    roots = connect(links, "near-roots")

    # what a bucket still leaves open: members of different classes
    placed = materialize(
        shared.join(roots.hint("merge"), "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .withColumn("a", F.least("node", "hub"))
        .withColumn("b", F.greatest("node", "hub"))
        .join(tested.hint("merge"), ["a", "b"], "left")
        .withColumn("far", 1.0 - F.col("jaccard"))
        .filter(F.col("node") != F.col("hub"))
        .select("bucket", "node", "size", "root", "far"),
        "near-placed",
    )
    split = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
    rest = placed.join(split.hint("merge"), "bucket", "left_semi")
    # a member of the largest class counts only where one outside that class may be near it
    per_root = rest.groupBy("bucket", "root").agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("s0"), F.max("size").alias("s1"),
        F.min(F.coalesce("far", F.lit(0.0))).alias("f0"), F.max(F.coalesce("far", F.lit(1.0))).alias("f1"),
    )
    main = per_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main")).select("bucket", F.col("main.root").alias("main"))
    others = (
        per_root.join(main.hint("merge"), "bucket").filter("root <> main")
        .groupBy("bucket", "main")
        .agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("f0").alias("f0"), F.max("f1").alias("f1"))
    )
    slack = F.lit(1.0 - least + EPS)
    may = (
        (F.col("root") != F.col("main"))
        | (F.col("size") >= F.col("s0") * least) & (F.col("size") * least <= F.col("s1"))
        & (F.col("far").isNull() | (F.col("far") >= F.col("f0") - slack) & (F.col("far") <= F.col("f1") + slack))
    )
    rest = rest.join(others.hint("merge"), "bucket").filter(may).select("bucket", "node", "root")
    rest = materialize(rest, "near-rest")
    open_ = rest.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).filter("r0 <> r1")
    open_ = open_.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = (
        rest.join(open_.hint("merge"), "bucket")
        .withColumn("block", block)
        .withColumn("with_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "node", "root", F.least("block", "with_block").alias("i"), F.greatest("block", "with_block").alias("j"))
    )
    found = tiles.join(sets.hint("merge"), "node").groupBy("bucket", "i", "j").applyInPandas(_tile_links(least), "a binary, b binary")
    found = materialize(found.distinct(), "near-links")
    return roots if found.isEmpty() else connect(links.unionByName(found), "near-roots")


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, bands: int = 32, rows: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, is_first, text_hash``.

    Documents are linked when the Jaccard of their sets of ``shingle_words``-word shingles (words
    lower-cased A-Z, split at separators) is at least ``similarity``, or when their words are the
    same; a text with fewer words is one shingle, empty and null texts are the same text.
    ``class_id`` is the least id of the class (null only where all its ids are null), and
    ``is_first`` marks one row of each class, whatever rows repeat.
    """
    source = docs.select(*carried_id(id_col), text_or_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketched = restored_id(materialize(source.mapInPandas(_sketcher(shingle_words, bands, rows), SKETCH), "near-sketch"))
    fresh = sketched.filter(F.col("bands").isNotNull())
    members = fresh.select("node", "size", F.explode("bands").alias("bucket"))
    roots = link_buckets(members, fresh.select("node", "shingles"), similarity)

    copies = sketched.groupBy("node", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    placed = copies.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lead = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node", "text_hash")
    classes = materialize(placed.groupBy("root").agg(F.min(lead).alias("lead"), F.sum("copies").alias("class_size")), "near-classes")
    first = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("node") == F.col("lead.node")) & (F.col("text_hash") == F.col("lead.text_hash")) & (F.col("copy") == 1)
    every = expand_copies(placed.join(classes, "root"), "copies", "copy")
    return every.select("doc_id", F.col("lead.doc_id").alias("class_id"), "class_size", first.alias("is_first"), "text_hash")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with one document of each class: its least id.

    Rows are found again by id and text hash, and repeats of a row that stays are dropped where the
    join has brought them together, so texts are shuffled once.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    stay = near_duplicates(docs, **options).filter("is_first").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("mark"))
    return keep_rows(docs, id_col, F.xxhash64(text_or_empty(text_col)), stay)
