"""Host-level quality rules.

Every document is measured and meets or fails the base rules. Failures are summed by host, the
host's failure rate is shrunk by a beta prior fitted to all hosts (method of moments), and hosts
whose shrunk rate is over the limit lose all their documents.

A null text has no words and fails. A null host counts as the host with the empty name. Repeated
rows are measured each. An empty table gives an empty result. Other columns than the id, the text
and the host are not used, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.llm.common import documents, materialize, mix64, prepare, shingle_hashes, span_hashes, text_passes, utf8_of, word_spans

#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[back] > 1


def measure(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document of a batch."""
    n = len(offsets) - 1
    starts, ends, row = word_spans(flat, offsets)
    words = np.bincount(row, minlength=n).astype(np.int64)
    before = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    chars = np.bincount(row, weights=before[ends] - before[starts], minlength=n).astype(np.int64)
    symbols = _per_row(_IS_SYMBOL[flat], offsets)

    breaks = np.flatnonzero(flat == 0x0A)
    line_row = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((line_start, line_row))
    line_row, line_start = line_row[order], line_start[order]
    line_end = np.concatenate([line_start[1:] - 1, [len(flat)]]) if n else line_start
    last = np.concatenate([line_row[1:] != line_row[:-1], [True]]) if n else np.zeros(0, bool)
    line_end = np.where(last, offsets[1:][line_row], line_end) if n else line_end
    first_word = np.searchsorted(starts, line_start)
    with_word = (first_word < len(starts)) & (np.append(starts, len(flat) + 1)[first_word] < line_end)
    keys = mix64(span_hashes(flat, line_start[with_word], line_end[with_word], lower=False) + line_row[with_word].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, firsts = np.unique(keys, return_index=True)
    dup_lines = np.bincount(line_row[with_word], minlength=n) - np.bincount(line_row[with_word][firsts], minlength=n)

    windows = shingle_hashes(span_hashes(flat, starts, ends, lower=False), WINDOW)
    whole = row[: len(windows)] == row[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    again = at[_repeated(mix64(windows[at] + row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))] if len(at) else at
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    repeat = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=n)
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: id, ``host`` and the base counts."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch):
                counts = measure(*utf8_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", "host", *COUNTS])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def host_verdicts(failures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """From rows (host, failed): per host ``host_docs``, ``host_rate`` (shrunk) and ``host_rejected``."""
    hosts = failures.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    # three numbers over all hosts: mean failure rate, its variance among hosts, mean sampling variance
    of_all = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("mean"),
        F.sum(F.col("host_docs") * rate * rate).alias("square"),
        F.sum("host_docs").alias("docs"),
        F.count("*").alias("hosts"),
    ).first()
    mean = of_all["mean"] or 0.0
    spread = max(0.0, (of_all["square"] or 0.0) / max(1, of_all["docs"] or 1) - mean * mean)
    sampling = mean * (1 - mean) * of_all["hosts"] / max(1, of_all["docs"] or 1)
    between = max(spread - sampling, 1e-6)
    strength = max(2.0, mean * (1 - mean) / between - 1)
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.select("host", "host_docs", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_rejected"))


def apply_host_rules(docs: DataFrame, max_rate: float = MAX_HOST_RATE, **columns: str) -> DataFrame:
    """Base counts, ``base_failed``, the host's figures and ``kept`` of every document."""
    counts = materialize(rule_counts(docs, **columns))
    counts = counts.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    hosts = host_verdicts(counts.select("host", F.col("base_failed").alias("failed")), max_rate)
    return counts.join(hosts, "host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_host_rules(documents(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), pos AS (
  SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8
), win AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM pos
), again AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid
), ln AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), base AS (
  SELECT w.doc_id, w.host, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
  SELECT host, count(*) AS n, sum(base_failed::INT)::DOUBLE AS k FROM f GROUP BY host
), m AS (
  SELECT sum(k) / sum(n) AS mean, sum(n * (k / n) * (k / n)) / sum(n) AS sq, count(*)::DOUBLE / sum(n) AS per FROM hosts
), prior AS (
  SELECT mean, greatest(2.0, mean * (1 - mean) / greatest(1e-6, greatest(0.0, sq - mean * mean) - mean * (1 - mean) * per) - 1) AS strength FROM m
), bad AS (
  SELECT host, (k + mean * strength) / (n + strength) > 0.5 AS rejected FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN bad USING (host)
"""
