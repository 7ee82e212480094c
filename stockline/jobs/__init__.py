"""Every batch job: ``jobs.<key>(tables, requests, ...) -> JobResult``."""

from stockline.jobs.common import JobResult, nested_lines  # noqa: F401
from stockline.jobs.customers import ingest_customers, ingest_invoices, patch_customers  # noqa: F401
from stockline.jobs.orders import (  # noqa: F401
    advance_orders, allocate_backorders, check_credit, create_orders, eligible_backorders, review_decisions,
)
from stockline.jobs.purchasing import (  # noqa: F401
    auto_reorder, create_purchase_orders, delete_draft_pos, ingest_suppliers, receive_goods, submit_pos,
    update_lead_times,
)
from stockline.jobs.stock import (  # noqa: F401
    abc_apply, adjust_stock, complete_cycle_counts, create_cycle_counts, create_returns, process_returns,
    record_counts, returns_disposition, schedule_cycle_counts, start_counts,
)
from stockline.jobs.transfers import create_transfers, dispatch_transfers, receive_transfers  # noqa: F401
from stockline.operators.numbering import assign_refs  # noqa: F401
from stockline.plans.pricing import check_moq, price_order_lines  # noqa: F401
from stockline.sources.snapshots import append_ledger as ledger_append  # noqa: F401
