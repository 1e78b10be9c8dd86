"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles. For each of four hash functions, a Cartesian tree over
the shingles' hashes groups all subsequences of at least ``LEAST`` shingles by the shingle with the
least hash: a node with at least so many shingles in its interval is a compact window, and all
subsequences in it around the node share its min-hash. The min-hash is a key.

How many hashes are enough depends on how common they are. Documents that share a key of up to
``PAIRS_UP_TO`` documents are candidates by that one hash. Windows of more common keys are joined, in
their own text, with those of the other functions where their intervals share a subsequence that
holds both nodes; the two min-hashes together are a key. Of each key, all documents are compared with
the first one, a stretch of a document with the least of its firsts before all others. Where no passage covers a document's window then, it is compared with all documents of
a key of up to ``PAIRS_UP_TO``. Of more, a pair that is similar around this window either shares a
shingle that stands in no more than so many of the documents that still wait, and is compared for
that, or at least four in five of its shingles there are common ones: those documents are compared
with further ones of the key in rounds, until none waits; first with those that have the most common shingles
there, as they are like the most others. So a passage that many documents share makes no pairs among them.

Candidates are verified on the shingles of all their windows with shared keys: a passage has at
least ``LEAST`` of them and a Jaccard similarity of 0.8 or more to its counterpart. At that similarity
two passages of the least length share one of four min-hashes with a probability of 0.998 or more, and
two with one of 0.97.

Null and empty texts, and texts of fewer than 50 words, have no window and no repeat. Very long texts
are taken whole. Rows with one id and one text are one document; rows with one id and several texts, and
rows without id, are not linked. Equal texts are found by their digests: a copy has one passage, all of it. The first document by id keeps a passage. An empty table gives an empty result. Only the
id and the text are used; other columns do no harm, and ``cut_repeats`` keeps them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import stored
from lineagraph.llm.common import documents, fresh, mix64, prepare, shingle_hashes, span_hashes, text_passes, tidy, utf8_of, word_spans
from lineagraph.llm.graph import all_pairs

WIDTH = 5
#: Shingles of the shortest passage: 50 words.
LEAST = 46
SIMILARITY = 0.8
#: Documents of a key that are all compared with each other.
PAIRS_UP_TO = 8
#: Documents of a common key that the others are compared with in the first of these rounds; twice as many in each further one.
LEADERS = 16
#: Shingles of a document that are first compared with one document, the first of all that share a key there.
STRETCH = 256
#: So many document ids are sent to the texts at most; of more, the texts are shuffled to them.
SENT_IDS = 200_000
#: A window is kept up to so many shingles to both sides of its node; runs of the least length that hold it lie within.
REACH = 127
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)


def tree_intervals(places: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For nodes in order of place: the interval in which each one's value is the least (first and last place).

    The stack holds the right edge of the Cartesian tree. Barriers have the value 0 and come first and last.
    """
    n = len(places)
    left, right = [0] * n, [0] * n
    stack = [0]
    for i in range(1, n):
        v = values[i]
        while values[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        left[i] = places[stack[-1]] + 1
        if v == 0:
            stack = [i]
        else:
            stack.append(i)
    return np.array(left), np.array(right)


def compact_windows(hashes: np.ndarray, text_of: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """From the shingle hashes of several texts (in order): per function the least node of every run
    of ``least`` shingles, and each node's interval. Places count a barrier before each text."""
    change = np.concatenate([[True], text_of[1:] != text_of[:-1]])
    place = np.arange(len(hashes)) + np.cumsum(change)
    size = int(place[-1]) + 2
    bits = np.uint64(size.bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    index = np.arange(size, dtype=np.uint64)
    out = []
    for seed in _SEEDS:
        drawn = mix64(hashes ^ seed)
        key = index.copy()  # a barrier is less than all else
        key[place] = (drawn | (mask + np.uint64(1))) & ~mask | index[place]
        run, width = key, 1
        while 2 * width <= least:
            run, width = np.minimum(run[:-width], run[width:]), 2 * width
        if width < least:
            run = np.minimum(run[: len(run) - (least - width)], run[least - width :])
        node = np.where(run > mask, (run & mask).astype(np.int64), -1)
        kept = np.zeros(size, bool)
        kept[node[node >= 0]] = True
        kept[key <= mask] = True
        at = np.flatnonzero(kept)
        first, last = tree_intervals(at.tolist(), np.where(key[at] > mask, key[at], 0).tolist())
        left, right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        left[at], right[at] = first, last
        value = np.zeros(size, np.uint64)
        value[place] = drawn
        out.append((node, left, right, value))
    return place, out


def window_keys(flat: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(key, row, span) of the compact windows. The last two bits of a key are its function. A span is
    the node's place in the shingles of the row's text, the reach to both sides (8 bits each, 127 at most), and
    a bit for the first window of the row with that key."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    starts, ends, row = word_spans(flat, offsets)
    if len(starts) < WIDTH:
        return none
    shingles = shingle_hashes(span_hashes(flat, starts, ends), WIDTH)
    whole = np.flatnonzero(row[: len(shingles)] == row[WIDTH - 1 :])
    enough = np.bincount(row[whole], minlength=len(offsets) - 1) >= least
    whole = whole[enough[row[whole]]]
    if not len(whole):
        return none
    text_of = row[whole]
    place, functions = compact_windows(shingles[whole], text_of, least)
    back = np.zeros(int(place[-1]) + 2, np.int64)
    back[place] = np.arange(len(place))
    first_of = np.searchsorted(text_of, text_of)  # of each shingle: where its text begins
    found = []
    for f, (node, left, right, value) in enumerate(functions):
        x = np.unique(node[node >= 0])
        key = (mix64(value[x] + np.uint64(f)) & ~np.uint64(3)) | np.uint64(f)
        i = back[x]
        of = text_of[i]
        order = np.lexsort((x, key, of))
        head = np.ones(len(x), np.int64)
        head[order[1:]] = (key[order[1:]] != key[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
        before, after = np.minimum(x - left[x], REACH), np.minimum(right[x] - x, REACH)
        found.append((key.view(np.int64), of, (i - first_of[i]) << 17 | before << 9 | after << 1 | head))
    return tuple(np.concatenate(c) for c in zip(*found))


def compact_window_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, doc, span): a row for each compact window."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch):
                key, row, span = window_keys(*utf8_of(part.column("text")), least)
                doc = part.column("doc").to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc.astype(np.int64)), pa.array(span)], names=["key", "doc", "span"])

    return docs.mapInArrow(tidy(run), "key long, doc long, span long")


def shared_windows(windows: DataFrame) -> DataFrame:
    """The windows whose key stands in several documents, their number n and the first of them."""
    of_key = Window.partitionBy("key")
    counted = windows.withColumn("n", F.sum(F.col("span").bitwiseAND(F.lit(1))).over(of_key)).withColumn("rep", F.min("doc").over(of_key))
    return counted.where("n > 1")


def interval_pairs(key: np.ndarray, span: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(key, doc, place) of the pairs of windows of two functions, in one document, whose intervals share
    a run of ``least`` shingles that holds both nodes. Documents are numbered from 0, in order."""
    place, before, after, function = span >> 17, span >> 9 & REACH, span >> 1 & REACH, key & 3
    longest = np.zeros(int(doc[-1]) + 1 if len(doc) else 1, np.int64)
    np.maximum.at(longest, doc, place + 2 * least)
    at = place + (np.cumsum(longest) - longest)[doc]
    of = [order[np.argsort(at[order])] for order in (np.flatnonzero(function == f) for f in range(4))]
    found = [tuple(np.zeros(0, np.int64) for _ in range(3))]
    for f in range(4):
        for g in range(f + 1, 4):
            x, y = of[f], of[g]
            low, high = np.searchsorted(at[y], at[x] - least + 1), np.searchsorted(at[y], at[x] + least - 1, "right")
            n = high - low
            a = np.repeat(x, n)
            b = y[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            left, right = np.maximum(at[a] - before[a], at[b] - before[b]), np.minimum(at[a] + after[a], at[b] + after[b])
            ok = (doc[a] == doc[b]) & (right - left + 1 >= least) & (left <= np.minimum(at[a], at[b])) & (np.maximum(at[a], at[b]) <= right)
            a, b = a[ok], b[ok]
            joined = mix64(key[a].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(key[b].view(np.uint64)))
            found.append((joined.view(np.int64), doc[a], place[a]))
    return tuple(np.concatenate(c) for c in zip(*found))


def joined_windows(windows: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, doc, place): pairs of windows (key, doc, span) of one document that share a subsequence, the first place of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, names = batch.column("own"), batch.column("doc").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(names)), np.diff(own.offsets.to_numpy()))
            flat = own.flatten()
            key, row, place = interval_pairs(flat.field("key").to_numpy(zero_copy_only=False), flat.field("span").to_numpy(zero_copy_only=False), doc, least)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(names[row] if len(row) else row), pa.array(place)], names=["key", "doc", "place"])

    own = windows.groupBy("doc").agg(F.collect_list(F.struct("key", "span")).alias("own"))
    return own.mapInArrow(tidy(run), "key long, doc long, place long").groupBy("key", "doc").agg(F.min("place").alias("place"))


def _in_order(pairs: DataFrame, other: str) -> DataFrame:
    """(doc, rep), rep before doc, of pairs (doc, other), once each."""
    return pairs.where(F.col("doc") != F.col(other)).select(F.greatest("doc", other).alias("doc"), F.least("doc", other).alias("rep")).distinct()


def uncovered(waiting: DataFrame, passages: DataFrame) -> DataFrame:
    """The windows (key, doc, place, ...) whose node lies in no passage of their document, here or as a source."""
    here = passages.select(F.col("doc_id").alias("doc"), "start_word", "end_word")
    there = passages.select(F.col("source_doc_id").alias("doc"), F.col("source_start_word").alias("start_word"), F.col("source_end_word").alias("end_word"))
    longest = here.unionByName(there).groupBy("doc", "start_word").agg(F.max("end_word").alias("end_word"))  # one a place, however many share it
    held = longest.groupBy("doc").agg(F.collect_list(F.struct("start_word", "end_word")).alias("held"))
    inside = "held is not null and exists(held, x -> x.start_word <= place and place < x.end_word)"
    return waiting.join(held, "doc", "left").where(f"not ({inside})").select(*waiting.columns)


def shingles_around(waiting: DataFrame, slices: DataFrame, least: int) -> DataFrame:
    """(doc, place, h): the shingles in reach of a run of ``least`` that holds a waiting window's node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data, nodes in zip(*(batch.column(c).to_pylist() for c in ("doc", "slice", "nodes"))):
                hashes, places = opened(data)
                near = np.zeros(int(places[-1]) + least + 1 if len(places) else 1, np.int64)
                for x in nodes:
                    near[max(0, x - least + 1)] += 1
                    near[min(x + least, len(near) - 1)] -= 1
                ok = np.cumsum(near)[places] > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), doc)), pa.array(places[ok].astype(np.int64)), pa.array(hashes[ok].astype(np.int64))], names=["doc", "place", "h"])

    asked = waiting.groupBy("doc").agg(F.collect_set("place").alias("nodes"))
    return asked.join(slices, "doc").select("doc", "slice", "nodes").mapInArrow(tidy(run), "doc long, place long, h long")


def common_around(nodes: DataFrame, common: DataFrame, least: int) -> DataFrame:
    """(doc, place, n): the nodes (doc, place) that stand in a run, of ``least`` or more and in their reach, of which four in five
    shingles are common ones (doc, place); n: how many more there are than these four in five at most, times five."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, nodes, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "nodes", "places"))):
                at, places = np.array(nodes, np.int64), np.array(places, np.int64) + least
                gain = np.full(int(at.max()) + 2 * least, -4)
                gain[places[places < len(gain)]] = 1
                upto = np.concatenate([[0], np.cumsum(gain)])
                beside = np.arange(least)
                begins, ends = upto[at[:, None] + 1 + beside], upto[at[:, None] + 1 + least + beside]
                most = (np.maximum.accumulate(ends[:, ::-1], axis=1)[:, ::-1] - begins).max(1)
                at, most = at[most >= 0], most[most >= 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), pa.array(at), pa.array(most)], names=["doc", "place", "n"])

    asked = nodes.groupBy("doc").agg(F.collect_set("place").alias("nodes"))
    held = common.groupBy("doc").agg(F.collect_set("place").alias("places"))
    return asked.join(held, "doc").mapInArrow(tidy(run), "doc long, place long, n long")


def linked_passages(members: DataFrame, slices: DataFrame, verify: Callable[[DataFrame], DataFrame], least: int = LEAST) -> DataFrame:
    """What ``verify`` finds for the pairs (doc, rep) of documents that the shared windows make candidates."""
    joined = stored(joined_windows(members.where(f"n > {PAIRS_UP_TO}"), least))
    sizes = joined.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("rep")).where("n > 1")
    cold = members.where(f"n <= {PAIRS_UP_TO} and span % 2 = 1").select("key", "doc", F.shiftright("span", 17).alias("place"), "n", "rep")
    keyed = stored(cold.unionByName(joined.join(sizes, "key").select("key", "doc", "place", "n", "rep")))
    # each stretch of a document with one of its firsts, then what is left with all of them
    nearest = keyed.where("doc <> rep").groupBy("doc", F.expr(f"place div {STRETCH}").alias("stretch")).agg(F.min("rep").alias("rep"))
    asked = stored(_in_order(nearest, "rep"))
    found = [stored(verify(asked))]
    waiting = stored(uncovered(keyed.where("doc <> rep"), found[0]))
    further = stored(_in_order(waiting, "rep").join(asked, ["doc", "rep"], "left_anti"))
    found.append(stored(verify(further)))
    asked = asked.unionByName(further)
    waiting = stored(uncovered(waiting, found[1]).select("key", "doc", "place", "n"))

    few = waiting.where(f"n <= {PAIRS_UP_TO}").select("key", "doc").distinct().join(keyed.where(f"n <= {PAIRS_UP_TO}").select("key", F.col("doc").alias("other")), "key")
    waiting = waiting.where(f"n > {PAIRS_UP_TO}").select("key", "doc", "place")
    around = stored(shingles_around(waiting, slices, least))
    holders = around.select("h", "doc").distinct().groupBy("h").agg(F.count("*").alias("n"))
    rare = around.join(holders.where(f"n > 1 and n <= {PAIRS_UP_TO}"), "h").select(F.col("h").alias("key"), F.col("doc").alias("node"))
    pairs = few.select("doc", "other").unionByName(all_pairs(rare).select(F.col("v").alias("doc"), F.col("u").alias("other")))
    pairs = stored(_in_order(pairs, "other").join(asked, ["doc", "rep"], "left_anti"))
    found.append(stored(verify(pairs)))

    common = around.join(holders.where(f"n > {PAIRS_UP_TO}").select("h"), "h").select("doc", "place")
    clear = common_around(waiting.select("doc", "place").distinct(), common, least)
    waiting = stored(uncovered(waiting.join(clear, ["doc", "place"]).select("key", "doc", "place", "n"), found[2]))
    asked, leaders = asked.unionByName(pairs), LEADERS
    while waiting.limit(1).count():
        # who has the most common shingles in a run there is like the most others
        held = waiting.groupBy("key", "doc").agg(F.max("n").alias("n"))
        part = F.pmod(F.xxhash64("doc"), F.lit(leaders))
        chosen = stored(held.groupBy("key", part.alias("part")).agg(F.max_by("doc", F.struct("n", F.negative("doc"))).alias("rep")).select("key", "rep"))
        of_key = chosen.groupBy("key").agg(F.collect_list("rep").alias("reps"))  # as many as leaders at most
        meets = held.join(of_key, "key").groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_set("reps"))).alias("reps"))
        pairs = stored(_in_order(meets.select("doc", F.explode("reps").alias("rep")), "rep").join(asked, ["doc", "rep"], "left_anti"))
        found.append(stored(verify(pairs)))
        asked = asked.unionByName(pairs)
        followers = waiting.join(chosen.withColumnRenamed("rep", "doc"), ["key", "doc"], "left_anti")  # who led leaves
        waiting = stored(uncovered(followers, found[-1]))
        leaders *= 2
    return functools.reduce(DataFrame.unionByName, found)


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals (first, last) that cover all of them."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def best_segments(match: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The longest stretches, from left to right, of at least ``least`` places of which four in five match.

    Passages of a Jaccard similarity of 0.8 have at least so many matches. A stretch begins and ends with a match,
    unless it is too short without the places beside it.
    """
    edges = np.flatnonzero(np.diff(np.concatenate([[0], match.astype(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return []
    running = np.concatenate([[0], np.cumsum(np.where(match, 1, -4))])
    furthest = np.maximum.accumulate(running[ends][::-1])  # of the last runs: the greatest sum at an end among them
    out, i = [], 0
    while i < len(starts):
        # the last run that ends with a sum no less than at this start
        j = len(ends) - 1 - int(np.searchsorted(furthest, running[starts[i]]))
        first, end = int(starts[i]), int(ends[j])
        lacking = max(0, least - (end - first))
        right = min(lacking, len(match) - end)
        left = min(lacking - right, first)
        if left + right == lacking and 4 * lacking <= running[end] - running[first]:
            out.append((first - left, end + right))
            i = j + 1
        else:
            i += 1
    return out


def text_shingles(text: str | None) -> np.ndarray:
    flat = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, ends, _ = word_spans(flat, np.array([0, len(flat)]))
    return shingle_hashes(span_hashes(flat, starts, ends), WIDTH)


def _holds(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values stand among the sorted ones."""
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def verified(own: np.ndarray, own_at: np.ndarray, rep: np.ndarray, rep_at: np.ndarray, least: int, similarity: float) -> Iterator[tuple[int, int, int, int]]:
    """Passages (first and end word here, first and end word there) of the linked places that are near-duplicates."""
    all_match = _holds(np.sort(rep), own)
    if all_match.sum() < similarity * least:
        return
    breaks = np.flatnonzero(np.diff(own_at) != 1) + 1
    for low, high in zip(np.append(0, breaks).tolist(), np.append(breaks, len(own_at)).tolist()):
        here, match = own[low:high], all_match[low:high]
        todo = best_segments(match, least)
        while todo:
            a, b = todo.pop()
            if found := _counterpart(here[a:b], rep, least, similarity):
                c, d = found
                yield int(own_at[low + a]), int(own_at[low + b - 1]) + WIDTH, int(rep_at[c]), int(rep_at[d - 1]) + WIDTH
            elif not match[a:b].all():  # too unlike as a whole: try both sides of the longest stretch without a match
                gaps = np.flatnonzero(np.diff(np.concatenate([[1], match[a:b].astype(np.int8), [1]])))
                k = 2 * int(np.argmax(gaps[1::2] - gaps[::2]))
                todo += [(c, d) for c, d in ((a, a + int(gaps[k])), (a + int(gaps[k + 1]), b)) if d - c >= least]


def _counterpart(mine: np.ndarray, rep: np.ndarray, least: int, similarity: float) -> tuple[int, int] | None:
    """The stretch of ``rep`` that is similar enough to these shingles, if there is one."""
    mine = np.unique(mine)
    for c, d in best_segments(_holds(mine, rep), least // 2):
        other = np.unique(rep[c:d])
        both = int(_holds(mine, other).sum())
        if both >= similarity * (len(mine) + len(other) - both):
            return c, d
    return None


def opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of a slice, and their places."""
    n = int(np.frombuffer(data, "<i4", 1)[0])
    runs = np.frombuffer(data, "<i4", 2 * n, 4).reshape(n, 2)
    places = np.concatenate([np.arange(a, a + k) for a, k in runs.tolist()]) if n else np.zeros(0, np.int64)
    return np.frombuffer(data, "<u4", offset=4 + 8 * n), places


def without_covered(passages: DataFrame) -> DataFrame:
    """The passages but for those that lie within what smaller sources hold of the same document."""
    columns = passages.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for own in batch.column("own").to_pylist():
                held: list[tuple[int, int]] = []
                for p in own:  # by source, then place
                    first, last = p["start_word"], p["end_word"] - 1
                    if not any(a <= first and last <= b for a, b in held):
                        out.append(tuple(p[c] for c in columns))
                        held = _merged([*held, (first, last)])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(columns), names=columns)

    order = ["doc_id", "source_doc_id", *(c for c in columns if c not in ("doc_id", "source_doc_id"))]
    own = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("own"))
    return own.select("own").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in columns))


def set_aside(known: DataFrame) -> DataFrame:
    """(doc, rep, words) of the documents whose text an earlier one has, with the words of the text;
    and of those with several texts, without rep."""
    words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    hashed = known.select("doc", F.md5(F.coalesce("text", F.lit(""))).alias("m"), words.alias("words"))
    each = hashed.groupBy("doc").agg(F.min("m").alias("m"), F.max("m").alias("other"), F.first("words").alias("words"))
    clear = each.where("m = other").select("m", "doc", "words")
    firsts = clear.groupBy("m").agg(F.min("doc").alias("rep"), F.max("doc").alias("last")).where("rep < last").select("m", "rep")
    copies = clear.join(firsts, "m").where("doc > rep").select("doc", "rep", "words")
    return copies.unionByName(each.where("m <> other").select("doc", F.lit(None).cast("long").alias("rep"), "words"))


def with_slices(pairs: DataFrame, slices: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(doc, rep, own, other): the slices (doc, slice) of both documents of each pair (doc, rep). Of a pair the smaller slice goes
    to the larger one, so that long documents, which have many pairs, are not sent for each of these. Where the ids of a side are
    few, only their slices are shuffled; few pairs go to the slices. ``sizes`` (doc, size) is made if it isn't given."""
    sizes = slices.select("doc", F.octet_length("slice").alias("size")) if sizes is None else sizes
    of = lambda c: sizes.select(F.col("doc").alias(c), F.col("size").alias(f"{c}_size"))
    met = pairs.join(of("doc"), "doc").join(of("rep"), "rep").withColumn("stays", F.col("doc_size") > F.col("rep_size"))
    by_side = lambda yes, no: F.when(F.col("stays"), F.col(yes)).otherwise(F.col(no))
    sent = stored(met.select("stays", by_side("rep", "doc").alias("guest"), by_side("doc", "rep").alias("home")))
    few = sent.count() <= SENT_IDS

    def cut(side: str) -> DataFrame | None:
        ids = sent.select(side).distinct()
        return F.broadcast(ids) if few or ids.count() <= SENT_IDS else None

    smaller, larger = (slices.select(F.col("doc").alias(side), F.col("slice").alias(c)) for side, c in (("guest", "smaller"), ("home", "larger")))
    if few:
        smaller = smaller.join(F.broadcast(sent), "guest")
    else:
        smaller = (smaller if (ids := cut("guest")) is None else smaller.join(ids, "guest")).join(sent, "guest")  # an id is there once
    larger = larger if (ids := cut("home")) is None else larger.join(ids, "home", "left_semi")
    named = (("home", "guest", "doc"), ("guest", "home", "rep"), ("larger", "smaller", "own"), ("smaller", "larger", "other"))
    return smaller.join(larger, "home").select(*(by_side(yes, no).alias(c) for yes, no, c in named))


PASSAGE = ["doc_id", "source_doc_id", "start_word", "end_word", "source_start_word", "source_end_word"]


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST + WIDTH - 1, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, source_doc_id, start_word, end_word, source_start_word, source_end_word): passages of an earlier document."""
    least = least_words - WIDTH + 1
    known = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    copies = stored(set_aside(known))
    few = copies.count() <= SENT_IDS
    later = copies.select("doc")
    known = known.join(F.broadcast(later) if few else later, "doc", "left_anti")
    members = stored(shared_windows(compact_window_rows(known, least)))

    def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replace a text by the runs of its windows (their number, first places and lengths) and 32 bits of each shingle's hash."""
        for batch in batches:
            for part in text_passes(batch):
                out = []
                for t, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    all_of = text_shingles(t)
                    intervals = _merged({((s >> 17) - (s >> 9 & REACH), (s >> 17) + (s >> 1 & REACH)) for s in spans})
                    runs = [(a, min(b + 1, len(all_of)) - a) for a, b in intervals if a < len(all_of)]
                    parts = [(all_of[a : a + n] >> np.uint64(32)).astype("<u4") for a, n in runs]
                    out.append(np.array([len(runs), *(x for r in runs for x in r)], "<i4").tobytes() + b"".join(x.tobytes() for x in parts))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(out, pa.binary())], names=["doc", "slice"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, rep, own, other in zip(*(batch.column(c).to_pylist() for c in ("doc", "rep", "own", "other"))):
                out += [(doc, rep, *x) for x in verified(*opened(own), *opened(other), least, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6, names=PASSAGE)

    # each text meets its windows once, and only the shingles in them go on
    asked = members.groupBy("doc").agg(F.collect_set(F.col("span").bitwiseAND(F.lit(~1))).alias("spans"))
    texts = known
    if (ids := members.select("doc").distinct()).count() <= SENT_IDS:
        texts = texts.join(F.broadcast(ids), "doc", "left_semi")
    slices = stored(asked.join(texts, "doc").select("doc", "spans", "text").mapInArrow(tidy(sliced), "doc long, slice binary"))
    sizes = stored(slices.select("doc", F.octet_length("slice").alias("size")))

    def found(pairs: DataFrame) -> DataFrame:
        return with_slices(pairs, slices, sizes).mapInArrow(tidy(verify), ", ".join(f"{c} long" for c in PASSAGE))

    whole = copies.where(f"rep is not null and words >= {least_words}").select(F.col("doc").alias("doc_id"), F.col("rep").alias("source_doc_id"), F.lit(0).cast("long").alias("start_word"), F.col("words").alias("end_word"), F.lit(0).cast("long").alias("source_start_word"), F.col("words").alias("source_end_word"))
    return without_covered(linked_passages(members, slices, found, least).distinct()).unionByName(whole)


def cut_repeats(docs: DataFrame, repeats: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the words of their repeated passages; white space before a cut stays."""
    fields = docs.schema.fields
    own, doc = fresh(docs.columns, "own"), fresh(docs.columns, "doc")
    spans = repeats.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(own))

    def without(t: str, passages: list[dict]) -> str:
        flat = np.frombuffer(t.encode(), dtype=np.uint8)
        starts, _, _ = word_spans(flat, np.array([0, len(flat)]))
        gone = np.zeros(len(flat) + 1, np.int64)
        stops = np.append(starts, len(flat))
        for s in passages:
            gone[stops[min(s["start_word"], len(starts))]] += 1
            gone[stops[min(s["end_word"], len(starts))]] -= 1
        return flat[np.cumsum(gone)[:-1] == 0].tobytes().decode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch, text):
                cut = [t if t is None or not p else without(t, p) for t, p in zip(part.column(text).to_pylist(), part.column(own).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()) if f.name == text else part.column(f.name) for f in fields], names=[f.name for f in fields])

    joined = docs.join(spans, F.col(f"`{doc_id}`") == F.col(doc), "left").select(*(F.col(f"`{f.name}`") for f in fields), own)
    return joined.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
