"""Registered queries of control-flow graphs."""

from __future__ import annotations

from lineagraph.operators import control_flow as cf
from lineagraph.plans.queries import query

# a machine with a stack is beyond SQL; the tests hold the edges against walks of nested programs
query("psp_06_control_flow", "statement", None)(lambda s: cf.control_flow(s.statement))
query("psp_07_conditions", "statement", None)(lambda s: cf.control_flow(s.statement).where("kind in ('true', 'false')"))
query(
    "psp_06_function_boxes",
    "statement",
    ", placed AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY line, col, id) AS place FROM statement), "
    "ends AS (SELECT f.trial_id, f.id, f.place, min(n.place) AS until FROM placed f LEFT JOIN placed n ON n.trial_id = f.trial_id AND n.place > f.place AND n.col <= f.col WHERE f.kind = 'function_def' GROUP BY 1, 2, 3) "
    "SELECT e.trial_id, e.id AS function_id, p.id FROM ends e JOIN placed p ON p.trial_id = e.trial_id AND p.place >= e.place AND (e.until IS NULL OR p.place < e.until)",
)(lambda s: cf.function_boxes(s.statement))
