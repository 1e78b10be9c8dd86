"""Ranked lexical search by MaxScore over shards of documents.

Every document is read once for its length and its counts of the terms that queries ask for; these
rows are the index. A task turns them into shards of inverted lists, each list with the greatest share
it can add to a score. For a query the lists are ordered by that bound: as long as the bounds of the
least ones together stay below the score that the best documents so far have, those are non-essential,
and a document that only they hold can't come in. Documents of the essential lists are scored; the
non-essential lists are probed for them from the greatest bound down, and only for documents that
can still reach the threshold, which is carried from shard to shard. What is left of each task, k rows
a query, is ranked at last.

Queries go through the documents in blocks of about BLOCK_TERMS terms, whose vocabulary every task
gets; the block of a single longer query is as large as its text. Terms are compared by 64-bit hashes.

Null and empty texts have no terms and count nowhere. Rows of documents that repeat an id are documents of
their own; a null id comes after all others among equal scores. Rows of one query id (null too) are one
query of all their terms. Empty tables give no rows; very long texts are counted whole. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import stored
from lineagraph.llm.common import LOWER, blocks, documents, prepare, span_hashes, text_passes, tidy, utf8_of, word_spans

#: Terms of queries that go through the documents together.
BLOCK_TERMS = 500_000
#: Entries of the inverted lists that make a shard.
SHARD_POSTINGS = 1_000_000

#: Lower-case letters, digits and all beyond ASCII as they are; a space for what parts terms.
_TERM = LOWER.copy()
_TERM[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of every term of a text column."""
    flat, offsets = utf8_of(column)
    flat = _TERM[flat]
    starts, ends, rows = word_spans(flat, offsets)
    return span_hashes(flat, starts, ends, lower=False).view(np.int64), rows


def query_terms(queries: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): each term of each query once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch):
                terms, rows = term_hashes(part.column("text"))
                pairs = np.unique(np.stack([rows, terms]), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(pairs[0])), pa.array(pairs[1])], names=["item", "term"])

    return queries.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).mapInArrow(tidy(run), "item long, term long").distinct()


def index_of(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its length, and its counts of the vocabulary (sorted hashes) by place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch):
                terms, rows = term_hashes(part.column("text"))
                n = np.bincount(rows, minlength=part.num_rows)
                place = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                hit = vocabulary[place] == terms
                found, tf = np.unique(rows[hit] * len(vocabulary) + place[hit], return_counts=True)
                ends = np.searchsorted(found, np.arange(part.num_rows + 1) * len(vocabulary)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (found % len(vocabulary), tf)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Inverted lists of some documents: by term the documents (ascending), what each adds to a score, and the most any adds."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """``sizes``: how many terms each document has in ``terms`` and ``tfs``."""
        self.n = len(lengths)
        m = 100 - 50 + (50 * lengths * n_docs) // n_terms
        order = np.argsort(terms, kind="stable")
        docs, tfs, by = np.repeat(np.arange(self.n), sizes)[order], tfs[order].astype(np.int64), terms[order]
        adds = weights[by] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[docs]))
        held, starts = np.unique(by, return_index=True)
        bounds = np.maximum.reduceat(adds, starts) if len(starts) else adds
        ends = [*starts[1:].tolist(), len(by)]
        self.lists = {t: (docs[a:b], adds[a:b], bound) for t, a, b, bound in zip(held.tolist(), starts.tolist(), ends, bounds.tolist()) if bound > 0}
        self.probes = 0

    def search(self, terms: list[int], k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that can be among the best k; ``best`` has the k highest scores of other shards."""
        lists = sorted((self.lists[t] for t in terms if t in self.lists), key=lambda x: x[2])
        below = [0]  # how much the least lists can add together
        for *_, bound in lists:
            below.append(below[-1] + bound)
        threshold = max(1, int(best.min())) if len(best) >= k else 1
        if below[-1] < threshold:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        essential = next(i for i in range(len(lists)) if below[i + 1] >= threshold)
        scores = np.zeros(self.n, np.int64)
        for docs, adds, _ in lists[essential:]:
            scores[docs] += adds  # a list holds a document once
        found = np.flatnonzero(scores)
        for i in range(essential, 0, -1):
            known = np.concatenate([best, scores[found]])
            if len(known) >= k:  # scores so far are lower bounds of those of k documents
                threshold = max(threshold, int(np.partition(known, len(known) - k)[len(known) - k]))
            found = found[scores[found] + below[i] >= threshold]
            docs, adds, _ = lists[i - 1]
            self.probes += len(found)
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            hit = docs[at] == found
            scores[found[hit]] += adds[at[hit]]
        found = found[scores[found] >= threshold]
        return found, scores[found]


def _best(ids: np.ndarray, missing: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest scores, of equal ones the least ids, missing ids last."""
    return np.lexsort((ids, missing, -scores))[:k]


def best_of_shards(index: DataFrame, queries: list[tuple[int | None, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of each task for each query (id, places of its terms)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        kept = [(none, none.astype(bool), none)] * len(queries)
        for ids, missing, lengths, sizes, terms, tfs in _shards(batches):
            shard = Shard(lengths, sizes, terms, tfs, weights, n_docs, n_terms)
            for q, (_, asked) in enumerate(queries):
                docs, scores = shard.search(asked, k, kept[q][2])
                if len(docs):
                    joined = [np.concatenate(x) for x in zip(kept[q], (ids[docs], missing[docs], scores))]
                    first = _best(*joined, k)
                    kept[q] = tuple(x[first] for x in joined)
        items = pa.array([item for (item, _), found in zip(queries, kept) for _ in found[0]], pa.int64())
        ids, missing, scores = (np.concatenate(x) for x in zip((none, none.astype(bool), none), *kept))
        yield pa.RecordBatch.from_arrays([items, pa.array(ids, mask=missing), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(tidy(run), "item_id long, doc_id long, score long")


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Ids, whether they are missing, lengths, sizes, terms and counts of some SHARD_POSTINGS entries at a time."""
    held, entries = [], 0
    for batch in batches:
        ids, terms, tfs = batch.column("doc_id"), batch.column("terms"), batch.column("tfs")
        sizes = np.diff(terms.offsets.to_numpy())
        held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), sizes, terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
        entries += int(sizes.sum())
        if entries >= SHARD_POSTINGS:
            yield [np.concatenate(x) for x in zip(*held)]
            held, entries = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of documents (doc_id, text) for each query (item_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    asked = stored(query_terms(queries))
    n_blocks = blocks(asked.count(), BLOCK_TERMS)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).toArrow()
        if not mine.num_rows:
            continue
        vocabulary, places = np.unique(mine.column("term").to_numpy(), return_inverse=True)
        by_item: dict[int | None, list[int]] = {}
        for item, place in zip(mine.column("item").to_pylist(), places.tolist()):
            by_item.setdefault(item, []).append(place)
        index = stored(index_of(docs, vocabulary))
        n_docs, n_terms, entries = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():  # a row a term of the block
            weights[term] = weight(n_docs, df)
        tasks = max(spark.sparkContext.defaultParallelism, blocks(entries, SHARD_POSTINGS))
        out = out.unionByName(best_of_shards(index.coalesce(tasks), list(by_item.items()), weights, n_docs, n_terms, k))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = r"unnest(regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))".format(_LOWERED.format("text"))
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, doc_id, {_TERMS} AS term FROM d),
lengths AS (SELECT r, doc_id, count(*) AS n FROM words GROUP BY r, doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
counted AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, total GROUP BY term),
adds AS (SELECT c.r, l.doc_id, c.term, w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + (50 * l.n * t.n_docs) // t.n_terms))) AS points
         FROM counted c JOIN lengths l ON l.r = c.r JOIN weights w ON w.term = c.term, total t),
scored AS (SELECT a.item_id, x.r, x.doc_id, sum(x.points)::BIGINT AS score FROM asked a JOIN adds x ON x.term = a.term GROUP BY a.item_id, x.r, x.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
