"""Views that need their own state: threshold crossings, order stages, backorders served as stock arrives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stockline.sources.staging import stage
from stockline.streaming.ledger import KEY, wall_time, with_event_time, with_reorder_points
from stockline.tables import Tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(df: DataFrame) -> None:
    """Own state needs the RocksDB store; the default store cannot hold it."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


ALERTS = (
    "warehouse_code string, product_id string, at timestamp_ntz, balance bigint, reorder_point int, alert_type string"
)


class _Crossings(StatefulProcessor):
    """Keeps a stock row's balance and whether it was low at the last look."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "balance bigint, low boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One row per poll interval arrives for a key, whatever its traffic.
        polls = pd.concat(list(rows)).sort_values("at")
        if self.level.exists():
            balance, low = self.level.get()
        else:
            balance = int(polls["opening"].iloc[0])
            low = balance <= int(polls["reorder_point"].iloc[0])
        out = []
        for at, change, point in zip(polls["at"], polls["change"], polls["reorder_point"]):
            balance += int(change)
            now_low = balance <= int(point)
            if now_low != low:
                kind = ("out_of_stock" if balance <= 0 else "low_stock") if now_low else "recovered"
                out.append((str(key[0]), str(key[1]), at, balance, int(point), kind))
            low = now_low
        self.level.update((balance, low))
        yield pd.DataFrame(out, columns=["warehouse_code", "product_id", "at", "balance", "reorder_point", "alert_type"])

    def close(self) -> None:
        pass


def stream_low_stock_alerts(ledger: DataFrame, t: Tables, every: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """One row whenever a stock row falls to its reorder point or recovers; run in append mode.

    The reference looked once a minute. Movements are summed per minute before
    they reach the state, so a busy product costs one row per minute there.
    """
    _use_rocksdb(ledger)
    polled = (
        with_event_time(ledger, delay)
        .groupBy(F.window("_at", every).alias("w"), *KEY)
        .agg(F.sum("qty_change").alias("change"))
        .select(F.window_time("w").alias("_end"), *KEY, "change")
        .withColumn("at", wall_time(F.col("_end")))
    )
    return with_reorder_points(polled, t).groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=_Crossings(), outputStructType=ALERTS, outputMode="Append", timeMode="None"
    )


# What an action needs, and what it leads to.
MOVES = {"pick": (("confirmed",), "picking"), "pack": (("picking", "picked"), "packing"), "ship": (("packing", "packed"), "shipped")}

_STATUSES = [*dict.fromkeys(x for needs, leads in MOVES.values() for x in (*needs, leads))]
# Where an action leads from a status, as positions in _STATUSES; -1 where it is refused. The last row and column stand for all others.
_LEADS = np.full((len(_STATUSES) + 1, len(MOVES) + 1), -1)
for _action, (_needs, _to) in enumerate(MOVES.values()):
    _LEADS[[_STATUSES.index(n) for n in _needs], _action] = _STATUSES.index(_to)

# Keys per group of state. A call of the state's handlers costs milliseconds, so a group holds many keys, and few enough to fit a task at any table size.
SHARD_KEYS = 4096


def shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def _shard(shards: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(shards)).cast("int").alias("shard")


def _packed(df: pd.DataFrame) -> tuple[bytes]:
    """A frame as one value of state."""
    table, sink = pa.Table.from_pandas(df, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value: tuple[bytes]) -> pd.DataFrame:
    return pa.ipc.open_stream(value[0]).read_all().to_pandas()


def judged(due: pd.DataFrame, stages: pd.Series) -> tuple[pd.DataFrame, pd.Series]:
    """The verdicts on actions, which are in the order they count in, and the new stages of the orders that moved.

    ``stages`` has one status per order id. Each round accepts the first action of every order that its stage allows
    and that comes after those accepted before, so there are as many rounds as an order has stages.
    """
    group, orders = pd.factorize(due["order_id"])
    was = stages.reindex(orders).to_numpy(dtype=object)
    now = np.array([_STATUSES.index(x) if x in _STATUSES else -1 for x in was], dtype=int)
    action = due["action"].map({a: i for i, a in enumerate(MOVES)}).fillna(-1).astype(int).to_numpy()
    reached, last = np.full(len(due), -1), np.full(len(orders), -1)
    while len(hits := np.flatnonzero((_LEADS[now[group], action] >= 0) & (np.arange(len(due)) > last[group]))):
        moved, first = np.unique(group[hits], return_index=True)
        last[moved] = hits[first]
        reached[last[moved]] = now[moved] = _LEADS[now[moved], action[last[moved]]]
    to = pd.Series(reached).where(reached >= 0).groupby(group).ffill()
    names = np.array([*_STATUSES, None], dtype=object)

    def named(code: pd.Series) -> np.ndarray:
        return np.where(code.isna(), was[group], names[code.fillna(-1).astype(int)])

    out = pd.DataFrame({
        "request_id": due["request_id"].to_numpy(), "known": due["known"].to_numpy(), "order_id": due["order_id"].to_numpy(), "action": due["action"].to_numpy(),
        "from_status": named(to.groupby(group).shift()), "to_status": named(to), "accepted": reached >= 0,
        "error_code": np.where(reached >= 0, None, "invalid_transition"), "late": due["late"].to_numpy()})
    return out, pd.Series(names[now[last >= 0]], index=orders[last >= 0], dtype=object)


class _OrderStages(StatefulProcessor):
    """Keeps the stages of a shard of orders, and their actions until no earlier one can come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getValueState("stages", "orders binary")
        self.waiting = handle.getListState("waiting", "actions binary")

    def _known(self) -> pd.Series:
        if not self.stages.exists():
            return pd.Series(dtype=object)
        kept = _unpacked(self.stages.get())
        return pd.Series(kept["status"].to_numpy(dtype=object), index=pd.Index(kept["order_id"]))

    def _keep(self, new: pd.Series) -> None:
        old = self._known()
        all_ = pd.concat([old[~old.index.isin(new.index)], new]) if len(old) else new
        self.stages.update(_packed(pd.DataFrame({"order_id": all_.index, "status": all_.to_numpy()})))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.drop_duplicates("order_id", keep="last")
        self._keep(pd.Series(first["fulfilment_status"].to_numpy(dtype=object), index=pd.Index(first["order_id"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).drop(columns="shard")
        new["late"] = new["at"] // 1000 < timerValues.getCurrentWatermarkInMs()
        self.waiting.appendValue(_packed(new))
        self.handle.registerTimer(int(new["at"].min()) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        rows = pd.concat([_unpacked(r) for r in self.waiting.get()], ignore_index=True)
        passed = rows["at"] // 1000 <= timerValues.getCurrentWatermarkInMs()
        if not passed.any():  # an earlier timer of this batch has taken them; the next one is set
            return
        rest = rows[~passed]
        if len(rest):
            self.waiting.put([_packed(rest)])
            self.handle.registerTimer(int(rest["at"].min()) // 1000)
        else:
            self.waiting.clear()
        out, moved = judged(rows[passed].sort_values(["at", "known", "request_id"], kind="stable"), self._known())
        if len(moved):
            self._keep(moved)
        yield out

    def close(self) -> None:
        pass


def order_stages(actions: DataFrame, t: Tables, delay: str, shards: int | None = None) -> DataFrame:
    """One verdict per action, in the order of ``requested_at`` and ``request_id``; run in append mode.

    An action waits until the watermark has passed its time, so one that arrives up to ``delay`` late is judged
    where it belongs. A later one is judged when it comes, from the stage reached by then, and marked ``late``.
    The orders' stages are read once, as initial state. State is kept by shards of orders, which are judged as
    frames; their number belongs to the checkpoint, so a stream that is started again must be given the same.
    """
    _use_rocksdb(actions)
    kinds = dict(actions.dtypes)
    # The time without its watermark: rows behind the watermark must reach the state, too.
    timed = with_event_time(actions.where(F.col("requested_at").isNotNull() & F.col("order_id").isNotNull()), delay, "requested_at")
    # Initial state travels with the query, so it has to be a plain scan.
    opening = t.orders.where("id IS NOT NULL").select(F.col("id").alias("order_id"), "fulfilment_status")
    shards = shards or shards_for(opening.count())
    first = stage(opening.select(_shard(shards, "order_id"), "*"), "opening-stages")
    # A number without a value would come as a float.
    whole = kinds["request_id"] in ("tinyint", "smallint", "int", "bigint")
    asked = timed.select(
        _shard(shards, "order_id"), "order_id", (F.coalesce("request_id", F.lit(0)) if whole else F.col("request_id")).alias("request_id"),
        F.col("request_id").isNotNull().alias("known"), "action",
        F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("requested_at")).alias("at"))
    moves = asked.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=_OrderStages(), outputMode="Append", timeMode="EventTime", initialState=first.groupBy("shard"),
        outputStructType=f"request_id {kinds['request_id']}, known boolean, order_id {kinds['order_id']}, action string, from_status string, "
                         "to_status string, accepted boolean, error_code string, late boolean")
    return moves.withColumn("request_id", F.when(F.col("known"), F.col("request_id"))).drop("known")


class _Queues(StatefulProcessor):
    """Keeps three numbers per stock row with backorders: units free, units ever queued, units of the queue served; a shard's rows as one frame."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queues", "queues binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.drop(columns="shard").assign(served=0)
        if self.state.exists():
            first = pd.concat([_unpacked(self.state.get()), first], ignore_index=True)
        self.state.update(_packed(first.drop_duplicates(_STOCK_ROW, keep="last")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        if not self.state.exists():
            return
        moved = new.groupby(_STOCK_ROW, as_index=False).agg(change=("change", "sum"), received=("received", "any"), at=("at", "max"))
        held = _unpacked(self.state.get())
        met = held.reset_index().merge(moved, on=_STOCK_ROW).set_index("index")
        if met.empty:
            return
        free = met["free"] + met["change"]
        upto = met["served"].where(~met["received"], np.maximum(met["served"], np.minimum(met["queued"], met["served"] + free)))
        out = met.assign(served_from=met["served"], served_to=upto)[met["served"] < upto]
        held.loc[met.index, "free"] = free - (upto - met["served"])
        held.loc[met.index, "served"] = upto
        self.state.update(_packed(held))
        yield out[[*_STOCK_ROW, "served_from", "served_to", "at"]].reset_index(drop=True)

    def close(self) -> None:
        pass


_STOCK_ROW = ["product_id", "warehouse"]


def served_units(ledger: DataFrame, opening: DataFrame, shards: int | None = None) -> DataFrame:
    """Which units of each stock row's backorder queue a micro-batch serves: ``served_from`` up to ``served_to``.

    ``opening``: product_id, warehouse, free, queued. A row is served when a micro-batch brings it
    received stock, from what is free after all of the batch's movements. State is three numbers per
    stock row with backorders, kept by shards of stock rows; nothing else is kept or looked at. Their number
    belongs to the checkpoint, as in ``order_stages``.
    """
    _use_rocksdb(ledger)
    shards = shards or shards_for(opening.count())
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    moves = ledger.where(F.col("product_id").isNotNull() & F.col("warehouse_code").isNotNull()).select(
        "product_id", F.col("warehouse_code").alias("warehouse"), F.coalesce("qty_change", F.lit(0)).cast("bigint").alias("change"),
        F.coalesce(F.col("action") == "stock_received", F.lit(False)).alias("received"),
        F.timestamp_diff("MICROSECOND", epoch, F.coalesce("created_at", epoch)).alias("at"),
    ).select(_shard(shards, *_STOCK_ROW), "*")
    kinds = dict(opening.dtypes)
    # Stock of unknown quantity serves nobody.
    first = stage(opening.where("free IS NOT NULL").select(_shard(shards, *_STOCK_ROW), *_STOCK_ROW, "free", "queued"), "opening-shards")
    served = moves.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=_Queues(), outputMode="Append", timeMode="None", initialState=first.groupBy("shard"),
        outputStructType=f"product_id {kinds['product_id']}, warehouse {kinds['warehouse']}, served_from bigint, served_to bigint, at bigint")
    return served.withColumn("at", F.timestamp_add("MICROSECOND", F.col("at"), epoch))
