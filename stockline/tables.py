"""The data model: table schemas and the ``Tables`` bundle that queries receive."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

# Schemas in DDL form, as ``spark.read.schema`` takes them. Identifiers are opaque; they are strings here, but every query also accepts
# numeric identifiers because no arithmetic is ever done on them.
SCHEMAS: dict[str, str] = {
    "warehouses": "code string, name string, currency string",
    "suppliers": (
        "id string, name string, contact_email string, lead_time_days int, "
        "actual_lead_time_days decimal(6,1), currency string, notes string"
    ),
    "products": (
        "id string, name string, sku string, barcode string, brand string, supplier_id string, "
        "cost_price_gbp decimal(12,2), sell_price_gbp decimal(12,2), case_pack int, moq int, abc_class string"
    ),
    "warehouse_stock": (
        "id string, product_id string, warehouse string, qty_on_hand int, qty_reserved int, "
        "reorder_point int, max_stock int, location string"
    ),
    "price_tiers": "id string, product_id string, min_qty int, discount_pct decimal(5,2)",
    "price_history": (
        "id string, product_id string, field string, old_value decimal(12,2), "
        "new_value decimal(12,2), changed_at timestamp_ntz"
    ),
    "customers": (
        "id string, company_name string, contact_name string, email string, billing_address string, "
        "currency_preference string, vat_number string, notes string, region string, customer_type string, "
        "payment_terms string, credit_limit_gbp decimal(12,2), credit_used_gbp decimal(12,2), "
        "default_discount_pct decimal(5,2)"
    ),
    "orders": (
        "id string, order_ref string, customer_id string, customer_name string, status string, "
        "fulfilment_status string, warehouse_code string, currency string, fx_rate decimal(12,6), "
        "total_gbp decimal(12,2), notes string, requires_review boolean, created_at timestamp_ntz"
    ),
    "order_lines": (
        "id string, order_id string, product_id string, product_name string, sku string, qty_ordered int, "
        "qty_requested int, unit_price_gbp decimal(12,2), warehouse_allocated string, fulfilment_status string, "
        "fulfilment_decision string, qty_to_ship int, qty_to_backorder int, qty_fulfilled int, qty_backordered int"
    ),
    "purchase_orders": (
        "id string, po_ref string, supplier_id string, warehouse_code string, status string, notes string, "
        "created_at timestamp_ntz, submitted_at timestamp_ntz, received_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "po_lines": (
        "id string, po_id string, product_id string, qty_ordered int, qty_received int, unit_cost_gbp decimal(12,2)"
    ),
    "stock_transfers": (
        "id string, transfer_ref string, from_warehouse string, to_warehouse string, status string, "
        "notes string, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "transfer_lines": "id string, transfer_id string, product_id string, qty int",
    "returns": (
        "id string, rma_ref string, order_id string, customer_id string, product_id string, warehouse_code string, "
        "qty int, reason string, reason_code string, action string, status string, created_at timestamp_ntz"
    ),
    "cycle_counts": (
        "id string, count_ref string, warehouse_code string, scope string, scope_filter string, notes string, "
        "planned_date date, status string, created_at timestamp_ntz, updated_at timestamp_ntz, "
        "completed_at timestamp_ntz"
    ),
    "cycle_count_lines": (
        "id string, cycle_count_id string, product_id string, warehouse_stock_id string, expected_qty int, "
        "counted_qty int, variance int, location string, notes string, counted_at timestamp_ntz"
    ),
    "audit_log": (
        "id string, created_at timestamp_ntz, action string, entity_type string, entity_id string, "
        "warehouse_code string, product_id string, qty_change int, balance_after int, notes string"
    ),
    "invoices": (
        "id string, customer_id string, order_number string, order_date date, invoice_date date, "
        "total_units int, total_value_gbp decimal(12,2), source_filename string"
    ),
    "invoice_lines": (
        "id string, invoice_id string, product_id string, sku string, description string, barcode string, "
        "trade_price_gbp decimal(12,2), quantity int, subtotal_gbp decimal(12,2), fulfilment_status string, "
        "qty_fulfilled int, qty_backordered int, created_at timestamp_ntz"
    ),
    "stock": (
        "brand string, title string, sku string, ean string, asin string, rrp_gbp decimal(12,2), "
        "buy_cost_gbp decimal(12,2), case_pack int, available_uk boolean, available_us boolean"
    ),
}


class Tables(Mapping[str, DataFrame]):
    """A read-only bundle of DataFrames addressed by table name (``tables.orders``).

    A frame may be given as a function, which is called when the table is first used.
    """

    def __init__(self, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._frames = dict(frames)

    def __getitem__(self, name: str) -> DataFrame:
        frame = self._frames[name]
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(f"no table named {name!r}; have {sorted(self._frames)}") from None

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def replace(self, **frames: DataFrame) -> "Tables":
        """The same bundle with some tables swapped, e.g. for a job's new state."""
        return Tables({**self._frames, **frames})
