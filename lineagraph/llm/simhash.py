"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Of two fingerprints that differ in at most two
bits, one segment differs in at most one, so the pair shares a variant of that segment with one bit
left out. Variants are indexed, joined by equality and verified on the whole fingerprint.

A bucket with more members than ``PAIRS_UP_TO`` is not paired: its members are indexed by their
midpoints, all fingerprints at one midpoint are linked, and a star replaces the pairs. No link
between fingerprints is lost.

A null or empty text has fingerprint zero and is linked like any other. Repeated rows share a
fingerprint. An empty table gives an empty result. Only the id and the text are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.llm.common import _SPACE, LOWER, documents, fresh, materialize, mix64, prepare, text_passes, tidy, utf8_of, word_spans
from lineagraph.llm.graph import components

PAIRS_UP_TO = 16


def shingle_xxh64(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all runs of ``width`` lower-cased words, space-joined, and each run's row."""
    starts, ends, row = word_spans(flat, offsets)
    keep = ~_SPACE[flat]
    after = ends[ends < len(flat)]
    keep[after] = True  # one separator after each word, or the next document's first byte
    joined = LOWER[flat]
    joined[_SPACE[flat]] = 0x20
    place = np.concatenate([[0], np.cumsum(keep)])
    data = joined[keep].tobytes()
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    lasting = np.minimum(width, n)[row]  # words of a run: all that there are in a short text
    begin = np.flatnonzero(np.arange(len(row)) + lasting <= first[row + 1])
    finish = begin + lasting[begin] - 1
    hashed = xxhash.xxh64_intdigest
    out = np.fromiter((hashed(data[a:b], 42) for a, b in zip(place[starts[begin]].tolist(), place[ends[finish]].tolist())), dtype=np.uint64, count=len(begin))
    return out, row[begin]


def simhash_bits(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row the 64-bit fingerprint: a bit is 1 if set in over half of the row's hashes."""
    out = np.zeros(rows, np.uint64)
    if len(hashes):
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        size = np.diff(np.append(heads, len(row)))
        packed = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little")
        out[row[heads]] = packed.view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint over runs of ``width`` words as a signed 64-bit number."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch):
                fp = simhash_bits(*shingle_xxh64(*utf8_of(part.column("text")), width), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def one_wildcard_variants(nodes: DataFrame) -> DataFrame:
    """(key, fp): each of the two 32-bit segments with each one of its bits left out."""
    half = F.when(F.col("t") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    without = F.expr("~shiftleft(1L, t % 32)")
    key = F.expr("shiftleft(cast(t as bigint), 32)").bitwiseOR(half.bitwiseAND(without))
    return nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("t")).select(key.alias("key"), "fp")


def midpoint_stars(nodes: DataFrame) -> DataFrame:
    """(u, v) between each fingerprint and the least one that shares a midpoint with it.

    The midpoints of a fingerprint are itself and all that differ from it in one bit. Two
    fingerprints share one exactly if they differ in at most two bits, so all that share one are
    linked to each other (at most 65), and a star connects them.
    """
    moved = F.expr("if(b = 64, fp, fp ^ shiftleft(1L, b))")
    keyed = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("b")).select("fp", moved.alias("z"))
    star = keyed.groupBy("z").agg(F.min("fp").alias("v"), F.max("fp").alias("w"), F.collect_set("fp").alias("all")).where("v < w")
    return star.select(F.explode("all").alias("u"), "v").where("u <> v").distinct()


def fingerprint_links(nodes: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(u, v) links that connect exactly the fingerprints (column fp, distinct) within two bits."""
    variants = one_wildcard_variants(nodes)
    sizes = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = materialize(sizes)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    twos = sizes.where("n = 2").select(F.col("a").alias("u"), F.col("b").alias("v")).where(near)
    cold = sizes.where(f"n > 2 and n <= {pairs_up_to}").select("key")
    members = variants.join(cold, "key")
    pairs = members.select("key", F.col("fp").alias("u")).join(members.select("key", F.col("fp").alias("v")), "key").where("u < v").where(near).select("u", "v")
    links = twos.unionByName(pairs)
    if sizes.where(f"n > {pairs_up_to}").limit(1).count():
        hot = variants.join(sizes.where(f"n > {pairs_up_to}").select("key"), "key").select("fp").distinct()
        links = links.unionByName(midpoint_stars(hot))
    return links.distinct()


def fingerprint_components(marked: DataFrame) -> DataFrame:
    """Rows (doc_id, fp) with component_id, the least doc_id that links of fingerprints at two or fewer differing bits reach."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    links = fingerprint_links(nodes.select("fp"))
    named = links.join(nodes.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(nodes.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    found = components(named.select(F.col("a").alias("u"), F.col("b").alias("v")))
    owner = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(owner, "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): links join fingerprints at two or fewer differing bits; the id is the least doc_id of the component."""
    return fingerprint_components(materialize(fingerprints(docs, width, doc_id, text)))


def first_of_components(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of the least id in their SimHash component (``simhash_components``).

    Rows without id stay, and so do all rows of an id that has several fingerprints, which links nothing;
    repeated rows stay or go together. Null and empty texts are one text. Other columns may have any name.
    """
    marked = materialize(fingerprints(docs.where(F.col(doc_id).isNotNull()), width, doc_id, text))
    several = marked.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    marked = materialize(marked.join(several, "doc_id", "left_anti"))
    name = fresh(docs.columns, "gone")
    gone = fingerprint_components(marked).where("doc_id > component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates at a Jaccard similarity, by bands of min-hashes and a wider fingerprint ---

#: Of the 144 bits of three SimHashes, pairs that differ in more cannot be expected to be similar enough.
MOST_BITS = 44
SIMILARITY = 0.8
#: A pair of Jaccard similarity J shares a band with probability J ** BAND_ROWS.
BANDS, BAND_ROWS = 20, 5
#: Members of a large bucket that the others are compared with in each round after the first.
LEADERS = 16
#: So few pairs are sent to the texts; of more, the texts are shuffled to them.
SENT_PAIRS = 200_000
_WIDE_SEEDS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
_FACTORS = np.random.default_rng(20240901).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row a key of each band: the hash of its min-hashes (zero for a row without hashes)."""
    out = np.zeros((rows, BANDS), np.uint64)
    if len(hashes):
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for band in range(BANDS):
            key = np.full(len(heads), band, np.uint64)
            for factor in _FACTORS[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
                key = mix64(key + np.minimum.reduceat(hashes * factor, heads))
            out[row[heads], band] = key
    return out


def distinct_per_row(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and their rows without repeats, sorted by row and hash."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], row[new]


def set_digests(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 64 bits of each row's set of hashes: sum and exclusive or of two mixes."""
    total, parity = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(hashes):
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        total[row[heads]] = np.add.reduceat(mix64(hashes), heads)
        parity[row[heads]] = np.bitwise_xor.reduceat(mix64(hashes ^ np.uint64(_WIDE_SEEDS[1])), heads)
    return total, parity


def wide_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, d0, d1, f0, f1, f2, keys): a digest of the shingle set, 48 bits each of three SimHashes over it, and the keys of its bands."""
    prepare(docs.sparkSession)
    names = ["doc_id", "d0", "d1", "f0", "f1", "f2", "keys"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch):
                hashes, row = distinct_per_row(*shingle_xxh64(*utf8_of(part.column("text")), width))
                words = [simhash_bits(mix64(hashes ^ np.uint64(s)), row, part.num_rows) & np.uint64(2**48 - 1) for s in _WIDE_SEEDS]
                numbers = [pa.array(w.view(np.int64)) for w in (*set_digests(hashes, row, part.num_rows), *words)]
                keys = band_keys(mix64(hashes), row, part.num_rows).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, lists], names=names)

    return docs.mapInArrow(tidy(run), "doc_id long, d0 long, d1 long, f0 long, f1 long, f2 long, keys array<long>")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Of the rows (key, node), those whose key has several nodes, and their number n."""
    return materialize(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))


def buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes and their keys, the members (key, node) of the small buckets, and of the large ones.

    The members of a bucket over ``PAIRS_UP_TO`` are dealt anew by each two of their keys that have
    such buckets; what is still large then shares ten min-hashes.
    """
    members = shared_keys(nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "node"))
    held = members.where(f"n > {PAIRS_UP_TO}").groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("k"))
    twos = "explode(flatten(transform(k, (x, i) -> transform(slice(k, i + 2, size(k)), y -> xxhash64(x, y))))) as key"
    finer = shared_keys(held.selectExpr(twos, "node"))
    small = members.where(f"n <= {PAIRS_UP_TO}").select("key", "node").unionByName(finer.where(f"n <= {PAIRS_UP_TO}").select("key", "node"))
    return small, finer.where(f"n > {PAIRS_UP_TO}").select("key", "node")


def classed(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with ``c``, the component that the links put them in."""
    found = components(links)
    return members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))


def led(members: DataFrame, leaders: int) -> DataFrame:
    """(key, node, leader): each bucket's members with its least one, or with those of so many classes of them."""
    chosen = members.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("class")).agg(F.min("node").alias("leader"))
    return members.join(chosen.select("key", "leader"), "key")


def similar_pairs(nodes: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v) links that connect what pairs of nodes in one bucket do that ``verified`` keeps.

    In each bucket all are compared with the least node first, so that a group of near copies makes a
    star. In small buckets, those are compared then that no link connects yet. In large ones, those not
    connected with a node they were compared with are compared with others from among themselves, until
    none is left.
    """
    small, large = (materialize(x) for x in buckets(nodes))
    ordered = (F.least("leader", "node").alias("u"), F.greatest("leader", "node").alias("v"))
    stars = led(small, 1).select(*ordered).unionByName(led(large, 1).select(*ordered)).where("u <> v").distinct()
    links = materialize(verified(materialize(stars)))

    apart = classed(small, links)
    mixed = apart.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key")
    held = apart.join(mixed, "key").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", "c"))).alias("s"))
    crossed = "explode(flatten(transform(s, (x, i) -> transform(filter(slice(s, i + 2, size(s)), y -> y.c <> x.c), y -> struct(x.node as u, y.node as v))))) as p"
    pairs = held.selectExpr(crossed).select("p.u", "p.v").distinct().join(stars, ["u", "v"], "left_anti")
    links = materialize(links.unionByName(verified(materialize(pairs))))

    leaders = 1
    while True:
        # who is connected with a leader, or led, leaves
        waiting = classed(large, links)
        first = led(waiting, leaders)
        leading = waiting.select(F.col("node").alias("leader"), "key", F.col("c").alias("with"))
        gone = first.join(leading, ["key", "leader"]).where("c = with").select("key", "node").distinct()
        large = materialize(waiting.join(gone, ["key", "node"], "left_anti").select("key", "node"))
        if not large.limit(1).count():
            return links
        leaders = LEADERS
        asked = led(large, leaders).select(*ordered).where("u <> v").distinct()
        links = materialize(links.unionByName(verified(materialize(asked))))


def shingle_sets(docs: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """Of the pairs (u, v) of documents, those whose shingle sets (as hashes of 32 bits) have at least this Jaccard similarity."""

    def shingles(text: str | None) -> np.ndarray:
        flat = np.frombuffer((text or "").encode(), dtype=np.uint8)
        return np.unique((shingle_xxh64(flat, np.array([0, len(flat)]), width)[0] >> np.uint64(32)).astype("<u4"))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch):
                sets = pa.array([shingles(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), sets], names=["u", "v", "of_u"])

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch):
                keep = []
                for h, t in zip(part.column("of_u").to_pylist(), part.column("text").to_pylist()):
                    a, b = np.frombuffer(h, "<u4"), shingles(t)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both >= similarity * (len(a) + len(b) - both))
                kept = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("u"), kept.column("v")], names=["u", "v"])

    texts = docs.select(F.col("doc_id").alias("d"), "text")
    if pairs.count() <= SENT_PAIRS:
        texts = texts.join(F.broadcast(pairs.select(F.explode(F.array("u", "v")).alias("d")).distinct()), "d", "left_semi")
    of_u = pairs.join(texts, F.col("u") == F.col("d")).select("u", "v", "text").mapInArrow(tidy(first), "u long, v long, of_u binary")
    return of_u.join(texts, F.col("v") == F.col("d")).select("u", "v", "of_u", "text").mapInArrow(tidy(second), "u long, v long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id) of the documents that are near-duplicates of a document of a smaller id.

    Documents of one set of shingles (by a digest of 128 bits) are one node. Nodes that share a band
    of five min-hashes, of twenty, are compared, first by the 144 bits of their SimHashes over the
    set, then by the sets themselves. A pair of
    Jaccard similarity 0.8 shares a band with a probability of 0.9996, one of 0.85 of 0.99999.
    Ids that have texts of several sets are left alone: none of their rows is in a group. A member of a
    bucket is not compared with those that other links connect it with already. In
    buckets over ``PAIRS_UP_TO`` members that share ten min-hashes, one that is connected with the
    member that it is compared with is not compared with further ones there.
    """
    known = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    marked = materialize(wide_fingerprints(known, width))
    of_id = F.struct("d0", "d1")
    several = materialize(marked.groupBy("doc_id").agg(F.min(of_id).alias("a"), F.max(of_id).alias("b")).where("a <> b").select("doc_id"))
    if several.limit(1).count():
        marked, known = (t.join(several, "doc_id", "left_anti") for t in (marked, known))
    nodes = materialize(marked.groupBy("d0", "d1").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("f0", "f1", "f2", "keys"))))
    side = lambda c: nodes.select(F.col("node").alias(c), *(F.col(f"f{i}").alias(f"{c}{i}") for i in range(3)))
    apart = sum((F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(1, 3)), F.bit_count(F.col("u0").bitwiseXOR(F.col("v0"))))

    def verified(pairs: DataFrame) -> DataFrame:
        close = pairs.join(side("u"), "u").join(side("v"), "v").where(apart <= MOST_BITS).select("u", "v")
        return materialize(shingle_sets(known, materialize(close), similarity, width))

    found = components(similar_pairs(nodes.select("node", "keys"), verified))
    owner = nodes.join(found, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("group_id"))
    return marked.select("doc_id", "d0", "d1").join(owner, ["d0", "d1"]).where("doc_id > group_id").select("doc_id", "group_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents of which none earlier is a near-duplicate.

    Rows without id stay, and so do all rows of an id that has several texts; repeated rows of one id
    and text stay or go together. Null and empty texts are one text. Other columns may have any name.
    """
    name = fresh(docs.columns, "gone")
    gone = near_duplicates(docs, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(options.get("doc_id", "doc_id")) == F.col(name), "left_anti")
