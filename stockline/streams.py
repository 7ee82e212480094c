"""Every streaming view: ``streams.<key>(ledger_stream, ...) -> DataFrame``."""

from stockline.streaming.ledger import (  # noqa: F401
    read_ledger_stream, stream_burn_rate, stream_dedup_ledger, stream_movements_by_day, stream_stock_balance,
)
from stockline.streaming.requests import read_state, stream_requests, write_state  # noqa: F401
from stockline.streaming.sinks import (  # noqa: F401
    append_sink, compact, latest, order_rejects, stream_backorder_allocation, stream_order_states, update_sink,
)
from stockline.streaming.stateful import stream_low_stock_alerts  # noqa: F401
