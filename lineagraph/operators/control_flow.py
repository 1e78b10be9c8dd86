"""Control-flow graphs of scripts: edges between statements in code order.

A statement is in the body of the nearest header above it that begins further left; ``elif``, ``else``,
``except`` and ``finally`` go on with the header at their own column. A trial's statements go by in
code order once, and what is remembered is the headers around the present one, however long the
bodies are. Where an edge leads is often not known yet then: it leads to what comes after some header,
and the statements are put in at the end of the trial, or by joins once all is read if it has more edges than are held.

Edges have these kinds: ``start`` (no source) and ``end`` (no target), ``next``, ``true`` and ``false`` from
conditions, ``body``, ``back`` and ``exit`` of loops, ``exception`` from ``try`` to its handlers (to ``finally`` if it has none),
and ``leave`` (no target) from the end of a function. The flow goes past function definitions; they lead
to their bodies. ``return``, ``break`` and ``continue`` are statements like others. A clause without a
header is a statement like others. Rows without a trial are left out, a missing column is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import settle, stored

# The statements that have a body, and the clauses that may go on with each.
CONDITIONS, LOOPS, FUNCTIONS = ("if", "elif"), ("for", "while"), ("function_def",)
HEADERS = (*CONDITIONS, *LOOPS, *FUNCTIONS, "else", "try", "except", "finally", "with", "class_def")
CLAUSES = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "try", "except"), "except": ("try", "except"), "finally": ("try", "except", "else")}

#: A place in the flow: a statement, or what comes after, or after all is done but ``finally`` in, the header of that number.
NODE, AFTER, DONE, FINAL, END, LEAVE = "node", "after", "done", "final", "end", "leave"


@dataclass
class Header:
    """An open header: its first clause's id names the whole of it, and ``last`` is from where its body goes on."""

    kind: str
    id: int
    column: int
    first: int = 0
    in_try: bool = False
    handled: bool = False
    last: list[tuple[str, int, str]] = field(default_factory=list)  # at most one place: (what, of which, kind of the edge on)


class Machine:
    """The flow of one trial; ``edges`` (source, what, of, kind) and ``places`` (what, of, to what, to which, kind) are taken away as they come."""

    def __init__(self) -> None:
        self.edges: list[tuple] = []
        self.places: list[tuple] = []
        self.module = Header("module", 0, -1, last=[("start", 0, "start")])
        self.stack = [self.module]

    def _go_on(self, last: list[tuple[str, int, str]], what: str, of: int, kind: str | None = None) -> None:
        for source, at, plain in last:
            if source == NODE:
                self.edges.append((at, what, of, plain if kind is None or plain != "next" else kind))
            elif source == "start":
                self.edges.append((None, what, of, "start"))
            else:
                self.places.append((source, at, what, of, kind or "next"))

    def _end_body(self, h: Header) -> None:
        if h.kind in LOOPS:
            self._go_on(h.last, NODE, h.id, "back")
        elif h.kind in FUNCTIONS:
            self._go_on(h.last, LEAVE, 0, "leave")
        elif h.kind == "try":
            self._go_on(h.last, DONE, h.first)
        elif h.in_try and h.kind in ("except", "else"):
            self._go_on(h.last, FINAL, h.first)
        else:
            self._go_on(h.last, AFTER, h.first)

    def _close(self) -> None:
        """The innermost header ends, and its block goes on from what comes after it."""
        h = self.stack.pop()
        self._end_body(h)
        if h.kind in CONDITIONS:
            self.edges.append((h.id, AFTER, h.first, "false"))
        if h.kind in LOOPS:
            self.edges.append((h.id, AFTER, h.first, "exit"))
        if h.in_try and h.kind != "finally":
            self.places += [(DONE, h.first, FINAL, h.first, "next")] * (h.kind != "else") + [(FINAL, h.first, AFTER, h.first, "next")]
        if h.kind not in FUNCTIONS:
            self.stack[-1].last = [(AFTER, h.first, "next")]

    def _clause(self, h: Header, kind: str, id_: int) -> None:
        """Another clause of the innermost header, in its place."""
        self._end_body(h)
        new = Header(kind, id_, h.column, h.first, h.in_try, h.handled or kind == "except")
        if kind == "except":
            self.edges.append((h.first, NODE, id_, "exception"))
        elif kind == "finally":
            self.places.append((FINAL, h.first, NODE, id_, "next"))
            if h.kind != "else":
                self.places.append((DONE, h.first, FINAL, h.first, "next"))
            if not h.handled:
                self.edges.append((h.first, NODE, id_, "exception"))
        elif h.in_try:
            self.places.append((DONE, h.first, NODE, id_, "next"))
        else:
            self.edges.append((h.id, NODE, id_, "false" if h.kind in CONDITIONS else "exit"))
        new.last = [(NODE, id_, "true" if kind in CONDITIONS else "next")]
        self.stack[-1] = new

    def step(self, id_: int, column: int, kind: str) -> None:
        while (top := self.stack[-1]).column > column or (top.column == column and top is not self.module and not self._goes_on(top, kind)):
            self._close()
        if top.column == column and top is not self.module:
            self._clause(top, kind, id_)
            return
        if kind not in FUNCTIONS:
            self._go_on(top.last, NODE, id_)
            top.last = [(NODE, id_, "next")]
        if kind in HEADERS and kind not in CLAUSES:
            out = "true" if kind in CONDITIONS else "body" if kind in LOOPS or kind in FUNCTIONS else "next"
            self.stack.append(Header(kind, id_, column, id_, kind == "try", last=[(NODE, id_, out)]))

    @staticmethod
    def _goes_on(h: Header, kind: str) -> bool:
        if h.kind not in CLAUSES.get(kind, ()):
            return False
        return h.in_try if kind in ("except", "finally") else kind == "elif" or not h.in_try or h.kind != "try" or h.handled or kind == "else"

    def finish(self) -> None:
        while self.stack[-1] is not self.module:
            self._close()
        self._go_on(self.module.last, END, 0, "end")


#: Edges and places of a trial that are held at most; a trial with more is put together by joins.
HELD = 50_000


def resolved(edges: list[tuple], places: list[tuple]) -> set[tuple]:
    """The edges (source, what, of, kind) of a whole trial once each, places replaced by what they lead to."""
    on: dict[tuple, tuple] = {}
    for what, of, to, to_of, how in reversed(places):  # what a place leads to is known after it, so its end is found before
        while (step := on.get((to, to_of))) is not None:
            to, to_of, how = *step[:2], step[2] if how == "next" else how
        on[what, of] = to, to_of, how
    out = set()
    for source, what, of, kind in edges:
        while (step := on.get((what, of))) is not None:
            what, of, how = step
            kind = how if kind == "next" else kind
        if what in (END, LEAVE) and kind != "start":
            kind = what
        out.add((source, what, of, kind))
    return out


def control_flow(statements: DataFrame, held: int = HELD) -> DataFrame:
    """(trial_id, source, target, kind) of statements (trial_id, id, line, col, kind); ``held``: edges and places of a trial in memory."""

    known = (NODE, END, LEAVE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trial, machine, whole = None, None, True

        def taken(m: Machine, of_trial: int) -> list[tuple]:
            out = [(of_trial, s, None, None, w, of, k, False) for s, w, of, k in m.edges] + [(of_trial, None, w, of, to, to_of, k, False) for w, of, to, to_of, k in m.places]
            m.edges, m.places = [], []
            return out

        def ended(m: Machine, of_trial: int, whole: bool) -> list[tuple]:
            m.finish()
            return [(of_trial, s, None, None, w, of, k, True) for s, w, of, k in resolved(m.edges, m.places)] if whole else taken(m, of_trial)

        def put(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=NAMES)

        for batch in batches:
            rows = []
            for t, id_, column, kind in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if machine is None or t != trial:
                    if machine is not None:
                        rows += ended(machine, trial, whole)
                    trial, machine, whole = t, Machine(), True
                machine.step(id_, column, kind)
                if len(machine.edges) + len(machine.places) > held:
                    whole = False
                    rows += taken(machine, trial)
            yield put(rows)
        if machine is not None:
            yield put(ended(machine, trial, whole))

    NAMES = ["trial_id", "source", "place", "of", "to", "to_of", "kind", "whole"]
    order = statements.select("trial_id", "id", F.coalesce(F.col("col").cast("int"), F.lit(0)).alias("col"), "kind", "line").where("trial_id is not null").repartition("trial_id").sortWithinPartitions("trial_id", "line", "col", "id").drop("line")
    found = stored(order.mapInArrow(run, "trial_id long, source long, place string, of long, to string, to_of long, kind string, whole boolean"))
    places = settle(found.where("place is not null").select("trial_id", "place", "of", "to", "to_of", F.col("kind").alias("how")))
    while places.where(~F.col("to").isin(*known)).limit(1).count():  # what comes after one may be what comes after another: pointers double
        on = places.select("trial_id", F.col("place").alias("to"), F.col("of").alias("to_of"), F.col("to").alias("next_to"), F.col("to_of").alias("next_of"), F.col("how").alias("next_how"))
        stepped = places.join(on, ["trial_id", "to", "to_of"], "left")
        how = F.when(F.col("how") == "next", F.coalesce("next_how", "how")).otherwise(F.col("how"))
        places = settle(stepped.select("trial_id", "place", "of", F.coalesce("next_to", "to").alias("to"), F.coalesce("next_of", "to_of").alias("to_of"), how.alias("how")))
    edges = found.where("place is null and not whole").select("trial_id", "source", F.col("to").alias("place"), F.col("to_of").alias("of"), "kind")
    met = edges.join(places, ["trial_id", "place", "of"], "left").select("trial_id", "source", F.coalesce("to", "place").alias("to"), F.coalesce("to_of", "of").alias("to_of"), "kind", "how")
    target = F.when(F.col("to") == NODE, F.col("to_of")).alias("target")
    last = F.when(F.col("to").isin(END, LEAVE) & (F.col("kind") != "start"), F.col("to")).when((F.col("kind") == "next") & F.col("how").isNotNull(), F.col("how")).otherwise(F.col("kind"))
    ready = found.where("whole").select("trial_id", "source", target, "kind")  # each edge once
    return ready.unionByName(met.select("trial_id", "source", target, last.alias("kind")).distinct())


def function_boxes(statements: DataFrame) -> DataFrame:
    """(trial_id, function_id, id): each function's statements, those of functions inside it too.

    A definition reaches to the next statement that is not further right. Its span of places in code
    order is found with the open definitions as the only memory; the join is on these spans.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trial, opened, place = None, [], 0
        for batch in batches:
            spans = []
            for t, id_, column, kind, at in zip(*(batch.column(i).to_pylist() for i in range(5))):
                while opened and (t != trial or opened[-1][0] >= column):
                    _, function, since = opened.pop()
                    spans.append((trial, function, since, place))
                trial, place = t, at
                if kind in FUNCTIONS:
                    opened.append((column, id_, at))
            yield put(spans)
        yield put([(trial, function, since, place) for _, function, since in opened])

    def put(spans: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in spans], pa.int64()) for i in range(4)], names=["trial_id", "function_id", "since", "upto"])

    order = Window.partitionBy("trial_id").orderBy("line", "col", "id")
    placed = stored(statements.where("trial_id is not null").select("trial_id", "id", F.coalesce(F.col("col").cast("int"), F.lit(0)).alias("col"), "kind", F.row_number().over(order).cast("long").alias("place")))
    spans = placed.repartition("trial_id").sortWithinPartitions("trial_id", "place").mapInArrow(run, "trial_id long, function_id long, since long, upto long")
    return spans.join(placed, "trial_id").where("place between since and upto").select("trial_id", "function_id", "id")
