"""Control-flow edges against a walk of the nested program that the statements were written from."""

import random

import pytest

from lineagraph.operators.control_flow import AFTER, NODE, control_flow, function_boxes, resolved

SCHEMA = "trial_id long, id long, line long, col int, kind string"


class Program:
    """A random program as nested blocks; a compound is a list of clauses (kind, id, block)."""

    def __init__(self, draw):
        self.draw, self.next = draw, 0
        self.rows = []

    def id(self, depth, kind):
        self.next += 1
        self.rows.append((self.next, self.next, depth * 4, kind))
        return self.next

    def block(self, depth, budget):
        out = []
        for _ in range(self.draw.randint(1, 3)):
            kind = self.draw.choice(["assign", "call", "if", "for", "while", "try", "function_def", "return", "with"]) if budget else "assign"
            if kind in ("assign", "call", "return"):
                out.append((kind, self.id(depth, kind), None))
                continue
            shapes = {
                "if": ["if"] + ["elif"] * self.draw.randint(0, 2) + ["else"] * self.draw.randint(0, 1),
                "for": ["for"] + ["else"] * self.draw.randint(0, 1),
                "while": ["while"],
                "try": self.draw.choice([["try", "finally"], ["try", "except"], ["try", "except", "except", "else"], ["try", "except", "finally"], ["try", "except", "else", "finally"]]),
                "function_def": ["function_def"],
                "with": ["with"],
            }
            out.append((kind, None, [(k, self.id(depth, k), self.block(depth + 1, budget - 1)) for k in shapes[kind]]))
        return out


def walk(block, ends, edges):
    """Adds the edges of a block that is entered from ``ends`` (source, kind); gives from where it goes on."""
    to = lambda sources, target, kind=None: edges.update((s, target, kind if kind and k == "next" else k) for s, k in sources)
    for kind, id_, clauses in block:
        if clauses is None:
            to(ends, id_)
            ends = [(id_, "next")]
            continue
        first = clauses[0][1]
        by = {}
        for k, i, b in clauses:
            by.setdefault(k, []).append((i, b))
        if kind == "function_def":
            for s, k in walk(clauses[0][2], [(first, "body")], edges):
                edges.add((s, None, "leave"))
            continue
        to(ends, first)
        if kind == "if":
            out, before = [], None
            for k, i, b in clauses:
                if before:
                    edges.add((before, i, "false"))
                out += walk(b, [(i, "true" if k != "else" else "next")], edges)
                before = i if k != "else" else None
            ends = out + ([(before, "false")] if before else [])
        elif kind in ("for", "while"):
            to(walk(clauses[0][2], [(first, "body")], edges), first, "back")
            ends = [(first, "exit")]
            if "else" in by:
                i, b = by["else"][0]
                edges.add((first, i, "exit"))
                ends = walk(b, [(i, "next")], edges)
        elif kind == "try":
            done = walk(clauses[0][2], [(first, "next")], edges)
            handled = []
            for i, b in by.get("except", []):
                edges.add((first, i, "exception"))
                handled += walk(b, [(i, "next")], edges)
            if "else" in by:
                i, b = by["else"][0]
                to(done, i)
                done = walk(b, [(i, "next")], edges)
            ends = done + handled
            if "finally" in by:
                i, b = by["finally"][0]
                to(ends, i)
                if "except" not in by:
                    edges.add((first, i, "exception"))
                ends = walk(b, [(i, "next")], edges)
        else:
            ends = walk(clauses[0][2], [(first, "next")], edges)
    return ends


def expected(block):
    edges = set()
    for s, k in walk(block, [(None, "start")], edges):
        edges.add((s, None, k if s is None else "end"))
    return edges


def flow(spark, rows):
    out = {}
    for r in control_flow(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r.trial_id, []).append((r.source, r.target, r.kind))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_programs(spark, seed):
    draw, rows, wanted = random.Random(seed), [], {}
    for trial in range(60):
        program = Program(draw)
        block = program.block(0, draw.randint(0, 4))
        rows += [(trial, *r) for r in program.rows]
        wanted[trial] = expected(block)
    draw.shuffle(rows)
    got = flow(spark, rows)
    for trial, edges in wanted.items():
        assert sorted(got[trial], key=str) == sorted(edges, key=str)


def program(*lines):
    return [(0, i, i, len(text) - len(text.lstrip()), text.strip()) for i, text in enumerate(lines, 1)]


def test_each_statement(spark):
    """if / elif / else, a loop that ends a branch, try with all clauses."""
    got = flow(spark, program("if", "    call", "elif", "    for", "        call", "else", "    call", "call"))[0]
    assert set(got) == {(None, 1, "start"), (1, 2, "true"), (1, 3, "false"), (2, 8, "next"), (3, 4, "true"), (4, 5, "body"), (5, 4, "back"), (4, 8, "exit"), (3, 6, "false"), (6, 7, "next"), (7, 8, "next"), (8, None, "end")}
    got = flow(spark, program("try", "    call", "except", "    call", "else", "    call", "finally", "    call"))[0]
    assert set(got) == {(None, 1, "start"), (1, 2, "next"), (1, 3, "exception"), (3, 4, "next"), (2, 5, "next"), (5, 6, "next"), (4, 7, "next"), (6, 7, "next"), (7, 8, "next"), (8, None, "end")}
    got = flow(spark, program("while", "    if", "        call"))[0]
    assert set(got) == {(None, 1, "start"), (1, 2, "body"), (2, 3, "true"), (3, 1, "back"), (2, 1, "false"), (1, None, "end")}
    got = flow(spark, program("function_def", "    return", "call"))[0]
    assert set(got) == {(1, 2, "body"), (2, None, "leave"), (None, 3, "start"), (3, None, "end")}


def test_clauses_without_a_header_and_odd_columns(spark):
    got = flow(spark, program("else", "      call", "  finally", "if", "call", "elif"))[0]
    assert set(got) == {(None, 1, "start"), (1, 2, "next"), (2, 3, "next"), (3, 4, "next"), (4, 5, "false"), (4, 5, "true"), (5, 6, "next"), (6, None, "end")}


def test_deep_nesting_and_long_chains(spark):
    """300 nested conditions, and 2000 clauses of one, all lead to the last statement."""
    rows = [(0, i, i, i, "if") for i in range(300)] + [(0, 300, 300, 300, "call"), (0, 301, 301, 0, "call")]
    got = flow(spark, rows)[0]
    assert {(i, 301, "false") for i in range(300)} | {(300, 301, "next")} <= set(got) and len(got) == 1 + 300 + 300 + 1 + 1
    chain = [(0, 0, 0, 0, "if"), (0, 1, 1, 1, "call")] + [x for i in range(1, 1000) for x in ((0, 2 * i, 2 * i, 0, "elif"), (0, 2 * i + 1, 2 * i + 1, 1, "call"))] + [(0, 2000, 2000, 0, "call")]
    got = flow(spark, chain)[0]
    assert sum(t == 2000 for _, t, _ in got) == 1001


def test_trials_that_are_not_held_whole(spark):
    draw, rows = random.Random(3), []
    for trial in range(20):
        made = Program(draw)
        made.block(0, 4)
        rows += [(trial, *r) for r in made.rows]
    made = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, control_flow(made).collect()), key=str)
    assert all(sorted(map(tuple, control_flow(made, held).collect()), key=str) == whole for held in (0, 15))


def test_long_chains_of_places_are_followed_once():
    n = 30_000
    places = [(AFTER, i, AFTER, i + 1, "next") for i in range(n)] + [(AFTER, n, NODE, -1, "back")]
    assert resolved([(i, AFTER, i, "next" if i % 2 else "true") for i in range(n)], places) == {(i, NODE, -1, "back" if i % 2 else "true") for i in range(n)}


def test_boxes_and_empty(spark):
    rows = spark.createDataFrame(program("call", "function_def", "    call", "    function_def", "        call", "    call", "call"), SCHEMA)
    got = {(r.function_id, r.id) for r in function_boxes(rows).collect()}
    assert got == {(2, i) for i in range(2, 7)} | {(4, 4), (4, 5)}
    assert control_flow(rows.limit(0)).count() == function_boxes(rows.limit(0)).count() == 0
