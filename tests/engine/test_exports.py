"""Documents of dataflow graphs: a parser takes the DOT text apart again, and a small trial's PROV-N is written out."""

import random
import re

from lineagraph.operators import exports as ex

PARTS = "trial_id long, kind string, id long, cluster_id long"
FACTS = "kind string, id long, name string, value string, line long, checkpoint string"
EDGES = "trial_id long, source string, target string, style string"
LETTER = {"activation": "c_", "evaluation": "e_", "access": "a_"}


def random_parts(draw, trials):
    rows, facts, ids = [], [], iter(range(1, 10**6))
    for t in range(trials):
        clusters = []
        for k in range(draw.randint(1, 12)):
            i = next(ids)
            rows.append((t, "activation", i, draw.choice(clusters) if k else None))
            facts.append(("activation", i, f'f"{i}' + "x" * draw.choice([0, 80]), None, i % 9, str(i)))
            if k == 0 or draw.random() < 0.6:
                clusters.append(i)
        for kind, n in (("evaluation", 15), ("access", 5)):
            for _ in range(draw.randint(0, n)):
                i = next(ids)
                rows.append((t, kind, i, draw.choice(clusters)))
                facts.append((kind, i, f"n{i}", draw.choice([None, "", f"v{i}"]), i % 4, str(i)))
    return rows, facts


def parse(lines):
    """Parent of every node and cluster, ranks, edges; every line must be one of the known forms."""
    opened, parent, ranks, edges, ended = [], {}, [], [], False
    for line in lines:
        assert not ended
        depth, text = (len(line) - len(line.lstrip(" "))) // 4, line.strip()
        if m := re.fullmatch(r"(?:digraph|subgraph) cluster_(\d+) \{", text):
            assert depth == len(opened)
            parent["c_" + m[1]] = opened[-1] if opened else None
            opened.append("c_" + m[1])
        elif text == "}":
            assert depth == len(opened) - 1
            opened.pop()
            ended = not opened
        elif m := re.fullmatch(r"\{rank=same (.*)\}", text):
            ranks.append((opened[-1], m[1].split(" ")))
        elif m := re.fullmatch(r"(\w+) -> (\w+) (\[\w+=\"\w+\"\])?;", text):
            assert len(opened) == 1
            edges.append((m[1], m[2]))
        elif m := re.fullmatch(r'(\w_\d+) \[label="((?:[^"\\]|\\.)*)"( \w+="[^"]*")+\];', text):
            assert depth == len(opened)
            if m[1] != opened[-1]:
                assert m[1] not in parent
                parent[m[1]] = opened[-1]
        else:
            assert re.fullmatch(r'rankdir=RL;|node\[fontsize=20\]|color="#3A85B9";|fontsize=30;|label = "(?:[^"\\]|\\.)*";', text), text
    assert ended
    return parent, ranks, edges


def test_dot_has_the_graph_s_clusters(spark):
    draw = random.Random(3)
    rows, facts = random_parts(draw, 12)
    graph = ex.graph_nodes(spark.createDataFrame(rows, PARTS), spark.createDataFrame(facts, FACTS))
    names = {t: [LETTER[k] + str(i) for u, k, i, _ in rows if u == t] for t in range(12)}
    edges = [(t, draw.choice(names[t]), draw.choice(names[t]), draw.choice(["", '[style="dashed"]'])) for t in range(12) for _ in range(6)] + [(0, "e_999999", names[0][0], "")]
    got = {}
    for r in ex.dot_document(graph, spark.createDataFrame(edges, EDGES)).collect():
        got.setdefault(r.trial_id, {})[r.line_no] = r.text
    for t in range(12):
        assert sorted(got[t]) == list(range(len(got[t])))  # every line once
        parent, ranks, found = parse([got[t][i] for i in range(len(got[t]))])
        assert parent == {LETTER[k] + str(i): None if c is None else f"c_{c}" for u, k, i, c in rows if u == t}
        assert sorted(found) == sorted((s, d) for u, s, d, _ in edges if u == t and s != "e_999999")
        assert sorted(n for _, held in ranks for n in held) == sorted(n for n in names[t] if n[0] == "e")
        assert all(parent[n] == c for c, held in ranks for n in held) and all(len({int(n[2:]) % 4 for n in held}) == 1 for _, held in ranks)


def test_parts(spark):
    draw = random.Random(4)
    rows, facts = random_parts(draw, 10)
    graph = ex.graph_nodes(spark.createDataFrame(rows, PARTS), spark.createDataFrame(facts, FACTS))
    above = {LETTER[k] + str(i): None if c is None else f"c_{c}" for _, k, i, c in rows}
    wanted = set()
    for node in above:
        top = node
        while top:
            wanted.add((top, node))
            top = above[top]
    asked = [i for _, k, i, _ in rows if k == "activation"][::2]
    got = {(r.top, r.node) for r in ex.part_of(graph, spark.createDataFrame([(i,) for i in asked], "id long")).collect()}
    assert got == {(top, node) for top, node in wanted if top[0] == "c" and int(top[2:]) in asked}
    sizes = {r.node: r.size for r in ex.cluster_parts(graph).collect()}
    assert all(sizes[top] == sum(t == top for t, _ in wanted) for top in sizes)


def test_prov_of_a_call(spark):
    """b = f(a): the call is its activity, what it returns is derived by an operation, a list has a member."""
    rows = [(1, "activation", 1, None), (1, "activation", 2, 1), (1, "evaluation", 3, 1), (1, "evaluation", 4, 1), (1, "access", 5, 1)]
    facts = [("activation", 1, "main", None, 0, "1"), ("activation", 2, "f", "[1]", 2, "8"), ("evaluation", 3, "a", "[1]", 1, "4"), ("evaluation", 4, "b", "[1]", 2, "14"), ("access", 5, "file.txt", None, None, None)]
    graph = ex.graph_nodes(spark.createDataFrame(rows, PARTS), spark.createDataFrame(facts, FACTS))
    used = spark.createDataFrame([(1, "e_4", "c_2", "assign", "14", True), (1, "c_2", "e_3", "argument", "8", False), (1, "e_4", "e_9", "assign", "14", False)], "trial_id long, source string, target string, type string, checkpoint string, reference boolean")
    members = spark.createDataFrame([(1, "e_3", "[0]", "e_4", "4")], "trial_id long, collection string, key string, member string, checkpoint string")
    lines = [r.text for r in ex.prov_document(graph, used, members).orderBy("line_no").collect()]
    assert lines == [
        *ex.PREFIXES,
        'entity(e_3, [value="[1]", type="script:eval", script:line="1", label="a"])',
        'entity(e_4, [value="[1]", type="script:eval", script:line="2", label="b"])',
        'entity(c_2, [value="[1]", type="script:eval", script:line="2", label="f"])',
        'activity(call_2, [type="script:call", label="f"])',
        'wasGeneratedBy(g_c_2; c_2, call_2, -,[version:checkpoint="8"])',
        'entity(a_5, [type="script:access", label="file.txt"])',
        'used(u_argument_c_2_e_3; call_2, e_3, -,[version:checkpoint="8"])',
        'wasDerivedFrom(c_2, e_3, call_2, g_c_2, u_argument_c_2_e_3, [version:checkpoint="8"])',
        'activity(assign_e_4, [type="script:operation"])',
        'wasGeneratedBy(g_assign_e_4; e_4, assign_e_4, -,[version:checkpoint="14"])',
        'used(u_assign_e_4_c_2; assign_e_4, c_2, -,[version:checkpoint="14"])',
        'wasDerivedFrom(e_4, c_2, assign_e_4, g_assign_e_4, u_assign_e_4_c_2, [version:checkpoint="14", type="version:Reference"])',
        'hadMember(e_3, e_4, [type="version:Put", version:key="[0]", version:checkpoint="4"])',
    ]


def test_empty(spark):
    graph = ex.graph_nodes(spark.createDataFrame([], PARTS), spark.createDataFrame([], FACTS))
    assert ex.dot_document(graph, spark.createDataFrame([], EDGES)).count() == ex.cluster_parts(graph).count() == 0
