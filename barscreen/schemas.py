"""Explicit schemas of the stored tables."""

from __future__ import annotations

PRICES = "symbol string, trade_date date, isin string, series string, open double, high double, low double, close double, prev_close double, volume bigint, turnover double, trades bigint"
INGEST_LOG = "trade_date date, source string, status string, row_count int, content_sha string, fetched_at timestamp_ntz, note string, commit_id string"
CORPORATE_ACTIONS = (
    "symbol string, ex_date date, isin string, series string, action_type string, subject string, face_value double, adj_factor double, "
    "observed double, deviation double, verification string, note string"
)
QUARANTINE = "symbol string, from_date date, to_date date, reason string"
POSITIONS = "position_id int, symbol string, entry_date date, entry_price double, quantity int, exit_date date, exit_price double, exit_reason string, note string"
SHORTLIST_LOG = "as_of_date date, symbol string, rank int, preset string, payload string"
REJECTS = "path string, source string, expected date, note string, rejected_at timestamp_ntz"
ADJ_INTERVALS = "symbol string, start_date date, end_date date, cum_factor double"

#: Stored tables, their schemas and keys.
TABLES = {
    "ingest_log": (INGEST_LOG, ("trade_date",)),
    "corporate_actions": (CORPORATE_ACTIONS, ("symbol", "ex_date", "subject")),
    "quarantine": (QUARANTINE, ("symbol", "from_date", "reason")),
    "positions": (POSITIONS, ("position_id",)),
    "shortlist_log": (SHORTLIST_LOG, ("as_of_date", "symbol", "preset")),
    "rejects": (REJECTS, ("path",)),
    "adj_intervals": (ADJ_INTERVALS, ("symbol", "start_date")),
}

#: Columns that keep their last value when a later row of the key has none: a session that fails anew keeps its bars.
LASTING = {"ingest_log": ("commit_id",)}
