"""The driver-table adapter written as DuckDB SQL common table expressions, for
the independent oracles. Mirrors ``tables.py`` definition by definition."""

from __future__ import annotations

from sigframe.plans.tables import ANCHOR, CHUNK_S, EPOCH_N
from sigframe.schemas import STAGE_MAP

N = EPOCH_N


def stage_case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in STAGE_MAP.items())
    return f"CAST(CASE {col} {whens} ELSE -1 END AS INTEGER)"


COND = """CASE WHEN event_id % 4 = 0 THEN 'Sleep stage ?'
  WHEN event_type = 'view' THEN 'Sleep stage W'
  WHEN event_type = 'click' THEN 'Sleep stage 1'
  WHEN event_type = 'purchase' THEN 'Sleep stage 2'
  WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Sleep stage 3' ELSE 'Sleep stage 4' END
  WHEN event_type = 'error' THEN 'Sleep stage R' END"""

SECONDS = f"(date_diff('microsecond', TIMESTAMP '{ANCHOR}', ts) / 1e6)"

VIEWS: dict[str, tuple[list[str], str]] = {
    "ev_idx": ([], """SELECT *, 'P' || CAST(user_id AS VARCHAR) AS patient,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS timestep
        FROM events"""),
    "signals": (["ev_idx"], """SELECT patient, timestep, CAST(timestep / 100 AS FLOAT) AS "time",
        CAST(value AS FLOAT) AS "EEG Fpz-Cz",
        CAST(json_extract_string(props, '$.k') AS FLOAT) AS "EEG Pz-Oz",
        CAST(event_id % 97 AS FLOAT) AS "EOG horizontal",
        CAST(value / 2 AS FLOAT) AS "EMG submental" FROM ev_idx"""),
    "labels_raw": (["ev_idx"], f"""SELECT patient, timestep, CAST(timestep / 100 AS FLOAT) AS "time",
        {COND} AS condition FROM ev_idx"""),
    "samples": (["signals"], """SELECT patient, timestep, "time", "EEG Fpz-Cz" AS fpzcz,
        "EEG Pz-Oz" AS pzoz, "EOG horizontal" AS horizontal FROM signals"""),
    "labeled": (["samples", "labels_raw"], f"""SELECT s.*, {stage_case('l.condition')} AS label
        FROM samples s JOIN labels_raw l ON s.patient = l.patient AND s.timestep = l.timestep"""),
    "prep": (["labeled"], f"""SELECT *, CAST(floor(timestep / {N}) AS BIGINT) AS epoch,
        CAST(timestep - floor(timestep / {N}) * {N} AS INTEGER) AS pos
        FROM labeled WHERE label <> -1"""),
    "annotations": (["ev_idx"], f"""SELECT patient, onset,
        COALESCE(lead(onset) OVER (PARTITION BY patient ORDER BY timestep) - onset, 0.0) AS duration,
        description FROM (SELECT patient, timestep, {SECONDS} AS onset, {COND} AS description FROM ev_idx)"""),
    "event_times": ([], f"""SELECT 'P' || CAST(user_id AS VARCHAR) AS patient, event_id,
        {SECONDS} AS t FROM events"""),
    "preds": (["ev_idx"], f"""SELECT patient, timestep, CAST(floor(timestep / {N}) AS BIGINT) AS epoch, label,
        CAST((label + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 5 AS INTEGER) AS y_pred
        FROM (SELECT patient, timestep, event_id, {stage_case(COND)} AS label FROM ev_idx)
        WHERE label <> -1"""),
    "chunks": (["annotations"], f"""SELECT patient, onset, description, CAST(k AS BIGINT) AS chunk_idx,
        onset + k * {CHUNK_S} AS chunk_onset
        FROM annotations, LATERAL (SELECT unnest(range(0, CAST(floor(duration / {CHUNK_S}) AS BIGINT))) AS k)
        WHERE floor(duration / {CHUNK_S}) >= 1"""),
}


def with_views(body: str, *names: str, extra: str = "") -> str:
    """Prefix ``body`` with the named views, everything they depend on, and the
    ``extra`` CTE text (``name AS (...), ...``) that may use them."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    if extra:
        parts.append(extra.strip())
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
