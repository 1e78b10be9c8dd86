import hashlib
import random
import zlib

import duckdb
import pytest
from lineagraph.llm.conversation_trie import OP12_SQL, _digest, ordered_turns, prefix_trie, rebuilt_turns

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    """Every prefix by itself, subtrees by looking at all nodes."""
    own = {}
    tie = lambda r: hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, tie(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in below)]
        ends = sorted(c for c in held if paths[c] == node)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        children = sum(len(n) == len(node) + 1 for n in below)
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children, len(childless), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(table):
    return sorted((tuple(r) for r in prefix_trie(rebuilt_turns(ordered_turns(table))).select(*COLUMNS).collect()), key=str)


def by_sql(table):
    conversations = table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    found = duckdb.connect()
    found.register("conversations", conversations)
    return sorted(found.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall(), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, seed):
    """Few texts, so that many prefixes are shared; missing first conversations, long and one-turn ones."""
    draw, rows = random.Random(seed), []
    for c in draw.sample(range(-20, 400), 120):
        for t in range(draw.choice([1, 2, 3, 8, 12])):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "é ü", "long " * 9])))
    table = spark.createDataFrame(rows, SCHEMA)
    assert trie(table) == brute_force(rows) == by_sql(table)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(0, None, None, "x"), (0, 0, "user", None), (0, 0, "user", None), (1, 3, "a", "b"), (1, 3, "a:", ""), (2, None, None, None), (None, 0, "user", "lost"), (7, 1, "user", "z" * 200_000)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert trie(table) == brute_force(rows) == by_sql(table)


def test_role_and_text_are_kept_apart(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc"), (None, "abc")], "role string, text string")
    assert rows.select(_digest()).distinct().count() == 3


def test_hot_first_turn_and_copies(spark):
    """Over a third of the conversations are one, and most begin alike: heavy nodes are joined by broadcast."""
    rows = [(c, t, "user", f"copy {t}") for c in range(0, 2000, 5) for t in range(3)]
    rows += [(c, t, "user", f"copy {t}" if t == 0 else f"own {c} {t}") for c in range(1, 2000, 5) for t in range(3)]
    assert trie(spark.createDataFrame(rows, SCHEMA)) == brute_force_quick(rows)


def brute_force_quick(rows):
    """The same by counting prefixes upwards."""
    own = {}
    for c, _, role, text in rows:
        own.setdefault(c, []).append((role, text))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        kids, leaves, saved = sums.get(node, (0, 0, 0))
        saved += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (kids, leaves or 1, saved)
        if node:
            up = sums.get(node[:-1], (0, 0, 0))
            sums[node[:-1]] = (up[0] + 1, up[1] + (leaves or 1), up[2] + saved)
    out = [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), *sums[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items()]
    return sorted(out, key=str)


def test_empty_table_and_clashing_columns(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    clash = spark.createDataFrame([(5, 0, "user", "x", "k", 1, 2)], SCHEMA + ", k1 string, depth long, grp long")
    assert [r[:4] for r in trie(clash)] == [r[:4] for r in brute_force([(5, 0, "user", "x")])]
