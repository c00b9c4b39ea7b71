"""Document fingerprints by SpotSigs.

A signature starts at a common word (the anchor) and chains the content words that follow it, at a
fixed spacing.  In a long stretch without anchors (tables, lists of names, other languages) every
word starts a chain, so that such text has signatures too.  Two sets are compared by Jaccard; sets
whose lengths alone keep them apart are not compared element by element.

Across documents, sets are partitioned by length: a set meets only those of its own and the next
length class, and only where they share one of their rarest signatures.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried_id, materialize, restored_id, text_or_empty
from .near_dedup import link_buckets

# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = frozenset(
    "the of and to in a is that for it was on be with as by this are at from "
    "le la les de des un une et en du que qui est au aux pour par sur avec dans "
    "der die das und den von zu mit sich auf ein eine ist nicht im dem es "
    "el los las se con para del al por su una y o".split()
)
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_MIX = np.uint64(0x9E3779B97F4A7C15)


_SIGNERS: dict[tuple, "SpotSigner"] = {}


class SpotSigner:
    """Signature sets of texts; words are cached up to ``keep``.

    Words are lower-cased and stripped of ASCII punctuation at their ends.  ``chain`` content words
    at every ``spacing``-th place follow an anchor, or follow a word in a stretch of more than
    ``gap`` content words without an anchor; chains cut off by the end of the text do not count.
    A text without any whole chain has one signature, that of all its words.
    """

    def __init__(self, chain: int = 2, spacing: int = 1, keep: int = 150_000, gap: int = 8):
        self.chain, self.spacing, self._keep, self.gap = chain, spacing, keep, gap
        self._words: dict[str, bytes] = {}

    @classmethod
    def shared(cls, chain: int, spacing: int) -> "SpotSigner":
        """One signer per worker process and setting."""
        return _SIGNERS.setdefault((chain, spacing), cls(chain, spacing))

    def _word(self, word: str) -> bytes:
        core = word.lower().strip(_EDGE)
        if not core:
            found = b""
        else:
            code = int.from_bytes(hashlib.blake2b(core.encode(), digest_size=8).digest(), "little")
            found = ((code & ~1) | (core in ANCHORS)).to_bytes(8, "little")  # the low bit marks anchors
        if len(word) <= 48:
            self._words[word] = found
        return found

    def codes(self, text: str) -> np.ndarray:
        if len(self._words) > self._keep:
            self._words.clear()
        get = self._words.get
        return np.frombuffer(b"".join([self._word(w) if (c := get(w)) is None else c for w in text.split()]), dtype="<u8")

    def signatures(self, text: str) -> np.ndarray:
        """Sorted distinct 32-bit signatures."""
        codes = self.codes(text)
        anchor = (codes & np.uint64(1)).astype(bool)
        at, content = np.flatnonzero(anchor), codes[~anchor]
        first = at - np.arange(len(at))  # content words before each anchor
        bounds = np.concatenate([[0], first, [len(content)]])
        long = np.repeat(np.diff(bounds) > self.gap, np.diff(bounds))
        heads = np.concatenate([codes[at], content[long]])
        first = np.concatenate([first, np.flatnonzero(long) + 1])
        whole = first + (self.chain - 1) * self.spacing < len(content)
        heads, first = heads[whole], first[whole]
        if not len(heads):
            return np.frombuffer(hashlib.blake2b(codes.tobytes(), digest_size=4).digest(), dtype="<u4")
        sig = heads * _MIX
        for k in range(self.chain):
            sig = (sig ^ (sig >> np.uint64(29))) * _MIX + content[first + k * self.spacing]
        sig = (sig ^ (sig >> np.uint64(32))) * _MIX
        return np.unique((sig >> np.uint64(32)).astype("<u4"))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted distinct arrays; 0 without a comparison where lengths rule ``least`` out."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def encode_fingerprint(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def decode_fingerprint(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def fingerprint_documents(docs: DataFrame, chain: int = 2, spacing: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_chars, fingerprint, n_signatures``.

    Null texts are empty, an empty text has one signature; repeated rows are fingerprinted each.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = SpotSigner(chain, spacing)
        for pdf in batches:
            sets = [signer.signatures(t) for t in pdf["text"]]
            prints = {"fingerprint": list(map(encode_fingerprint, sets)), "n_signatures": list(map(len, sets))}
            yield pdf[["doc_id", "nameless"]].assign(n_chars=pdf["text"].str.len(), **prints)

    rows = docs.select(*carried_id(id_col), text_or_empty(text_col).alias("text"))
    return restored_id(rows.mapInPandas(sign, "doc_id long, nameless boolean, n_chars long, fingerprint string, n_signatures long"))


def length_class(size, least: float):
    """Number of the length class of a set (Spark column): the least length of the next class is 1 / ``least`` times larger."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def similar_fingerprints(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """``prints`` (of :func:`fingerprint_documents`) with ``class_id``: sets linked by a Jaccard of at least ``least``.

    Equal sets are one node.  Two sets this near differ in length by at most a factor ``least``, so
    their length classes are the same or neighbours; and each shares one of the other's rarest
    n - ceil(least * n) + 1 signatures.  Members of such a bucket, of any number, are compared by the
    tiles of :func:`link_buckets`, never as pairs of rows.  ``class_id`` is the least id of the class,
    null only where all its ids are.  Repeated rows are returned each, an empty table gives no rows.
    """
    known = materialize(prints.withColumn("node", F.unhex(F.md5("fingerprint"))), "spot-prints")
    sets = known.select("node", F.unbase64("fingerprint").alias("shingles"), F.col("n_signatures").cast("int").alias("size")).dropDuplicates(["node"])
    sets = materialize(sets, "spot-sets")

    @F.pandas_udf("array<long>")
    def signatures(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: np.frombuffer(x, "<u4").astype(np.int64))

    each = sets.select("node", "size", F.explode(signatures("shingles")).alias("signature"))
    # rarest first; what a signature's own rank is matters to no result, so ties go by the signature
    common = each.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = each.join(common, "signature", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    prefix = F.sort_array(F.collect_list(F.struct("n", "signature")))  # one set, as long as its text
    rarest = ranked.groupBy("node", "size").agg(prefix.alias("all"))
    kept = F.slice("all", F.lit(1), (F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)) + 1).cast("int"))
    own = length_class(F.col("size"), least)
    members = (
        rarest.select("node", "size", own.alias("own"), F.explode(kept).alias("s"))
        .filter("s.n > 1")
        .select("node", "size", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("length_class"), F.col("s.signature").alias("signature"))
        .select("node", "size", F.xxhash64("length_class", "signature").alias("bucket"))
    )
    roots = link_buckets(members, sets.select("node", "shingles"), least)
    placed = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return placed.join(classes, "root").select(*prints.columns, "class_id")


def _cut_keys(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Keys (k, h) that cut ``rows`` into about ``parts`` ranges; they need not be keys of rows.

    An id that fills several quantiles is cut by its texts' hashes, evenly.
    """
    found = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()[0] or []
    times = Counter(found)
    return sorted((k, -(2**63) + j * (2**64 // (n + 1))) for k, n in times.items() for j in range(n))


def _range_of(keys: list[tuple[int, int]]):
    """Number of keys at or below (k, h), as a column; two levels of keys, so that rows are compared with few."""
    leap = max(1, int(len(keys) ** 0.5))
    listed = lambda some: F.arrays_zip(*[F.split(F.lit(",".join(str(x[i]) for x in some)), ",").cast("array<bigint>").alias(n) for i, n in ((0, "k"), (1, "h"))])
    below = lambda some: F.size(F.filter(some, lambda s: s <= F.struct(F.col("k").alias("k"), F.col("h").alias("h"))))
    block = F.greatest(F.lit(0), below(listed(keys[::leap])) - 1)
    return (block * leap + below(F.slice(listed(keys), block * leap + 1, F.lit(leap)))).cast("int")


def with_next(rows: DataFrame, parts: int, step, schema: str) -> DataFrame:
    """Run ``step(current, following)`` over neighbours in the order of (k, hash of text), the last with the first.

    ``rows`` has ``k`` (long, not null) and ``text``.  Each range of keys is a task's work, streamed
    in order; one copy of the first row of each range goes to the range before it, so no task needs
    another's output.  ``step`` gets lists of neighbours, each row once as the current one.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = _cut_keys(rows, parts)
    if not keys:
        return spark.createDataFrame([], schema)
    # the first row of each range that has rows: one (range, key) per range comes to the driver
    firsts = rows.groupBy(_range_of(keys).alias("part")).agg(F.min(F.struct("k", "h")).alias("first")).orderBy("part").collect()
    heads = [(r["first"]["k"], r["first"]["h"]) for r in firsts]
    n, part = len(heads), _range_of(heads) - 1
    dealt = rows.withColumn("part", part)
    is_head = F.struct("k", "h") == F.element_at(F.arrays_zip(*[F.split(F.lit(",".join(str(x[i]) for x in heads)), ",").cast("array<bigint>").alias(c) for i, c in ((0, "k"), (1, "h"))]), F.col("part") + 1)
    ahead = materialize(dealt.filter(is_head).dropDuplicates(["part"]), "spot-heads")
    own = dealt.withColumn("ahead", F.lit(0))
    dealt = own.unionByName(ahead.withColumn("part", F.pmod(F.col("part") - 1, F.lit(n))).withColumn("ahead", F.lit(1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last own row, waiting for its follower
        for pdf in batches:
            now, after = [], []
            for row in pdf.itertuples(index=False):
                if held is not None and row.part == held.part:
                    now.append(held), after.append(row)
                    held = None
                if not row.ahead:
                    held = row
            if now:
                yield step(now, after)

    return dealt.repartitionByRange(n, "part").sortWithinPartitions("part", "ahead", "k", "h").mapInPandas(run, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, nameless boolean"


def fingerprints_under_edit(
    docs: DataFrame, chain: int = 2, spacing: int = 1, least: float = 0.1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited text, with both likenesses.

    The edited text has the last quarter of the code points replaced by the first as many of the
    next document in id order (the first after the last).  A likeness that the lengths of the two
    sets keep below ``least`` is 0.  Null texts are empty; null ids come first and are returned as
    null; rows with equal ids follow the order of their texts' hashes.  A single document is its own
    next; an empty table gives no rows.
    """
    low = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("k"), F.col(id_col).isNull().alias("nameless"), text_or_empty(text_col).alias("text"))

    def step(now: list, after: list) -> pd.DataFrame:
        signer, out, known = SpotSigner.shared(chain, spacing), [], {}

        def signed(text: str) -> np.ndarray:
            if text not in known:
                known.clear()  # a follower is the next current row
                known[text] = signer.signatures(text)
            return known[text]

        for row, following in zip(now, after):
            text, cut = row.text, len(row.text) // 4
            edited = text[: len(text) - cut] + following.text[:cut] if cut else text
            mine = signed(text)
            changed = mine if edited == text else signer.signatures(edited)
            theirs = signed(following.text)
            out.append(
                (
                    row.k,
                    len(text),
                    hashlib.sha256(edited.encode()).hexdigest(),
                    encode_fingerprint(mine),
                    encode_fingerprint(changed),
                    pruned_jaccard(mine, changed, least),
                    pruned_jaccard(mine, theirs, least),
                    row.nameless,
                )
            )
        return pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")])

    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return restored_id(with_next(rows, parts, step, EDITED))
