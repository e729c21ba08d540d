"""Canonical schemas. Missing values are NULL; bar times are epoch milliseconds, news times epoch seconds."""

BAR = "symbol string, ts long, interval_seconds int, open double, high double, low double, close double, volume double, available_time long, source string, source_version string"
PIT = BAR + ", exchange string, ingestion_time long, adjustment_factor double, quality_flags array<string>"
NEWS = "item_id long, event_time long, publication_time long, retrieval_time long, decision_time long, headline string, entities array<string>, sentiment double, source string"
ISSUE = "symbol string, code string, severity string, message string, idx long"
SIGNAL = "run_id string, bar_index int, ts long, symbol string, target_weight double, reason string"
EVENT = (
    "run_id string, seq long, type string, ts long, bar_index int, symbol string, order_id int, side string, quantity double, price double, "
    "commission double, requested double, partial boolean, target_weight double, reason string, equity double, cash double, leverage double, "
    "kind string, limit_price double, stop_price double, eligible_from int, positions string, params string"
)
DAY_MS = 86_400_000
