"""State processors for the ordered streams. One small state per key; rows of a micro-batch are put
into arrival order before they are applied, so results do not depend on how Spark delivers them."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from bookweave.operators.pnl import apply_fill


def _batch(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    frames = [r for r in rows if len(r)]
    if not frames:
        return pd.DataFrame()
    return pd.concat(frames, ignore_index=True).sort_values(order, kind="stable")


def sorted_blocks(frames: Iterator[pd.DataFrame], types: dict[str, pa.DataType], order: list[str], run_rows: int = 200_000, block_rows: int = 4_096) -> Iterator[pa.Table]:
    """The rows of all frames in blocks, sorted by the two columns of ``order`` (nulls last). Memory holds one run, or
    later a block of each run: runs are sorted and, if there is more than one, written to the task's own temporary
    folder and merged."""
    by = [(c, "ascending") for c in order]
    first, second = order

    def taken() -> Iterator[pa.Table]:
        parts, rows = [], 0
        for f in frames:
            if len(f):
                parts.append(pa.table({c: pa.array(f[c], from_pandas=True).cast(t) for c, t in types.items()}))
                rows += len(f)
            if rows >= run_rows:
                yield pa.concat_tables(parts).sort_by(by)
                parts, rows = [], 0
        if parts:
            yield pa.concat_tables(parts).sort_by(by)

    def last(t: pa.Table) -> tuple:
        a, b = t[first][-1].as_py(), t[second][-1].as_py()
        return (a is None, 0 if a is None else a, b is None, "" if b is None else b)

    def up_to(t: pa.Table, bound: tuple) -> int:
        a, b = t[first], t[second]
        tie = pc.less_equal(b, bound[3]).fill_null(False) if not bound[2] else pa.scalar(True)
        if bound[0]:
            return pc.sum(pc.or_(pc.is_valid(a), tie)).as_py()
        return pc.sum(pc.or_(pc.less(a, bound[1]).fill_null(False), pc.and_(pc.equal(a, bound[1]).fill_null(False), tie))).as_py()

    runs = taken()
    one, more = next(runs, None), next(runs, None)
    if more is None:
        if one is not None:
            yield from (one.slice(i, block_rows) for i in range(0, one.num_rows, block_rows))
        return
    with tempfile.TemporaryDirectory(prefix="sorted-") as folder:
        sources = []

        def kept(run: pa.Table) -> None:
            path = f"{folder}/{len(sources)}"
            with pa.OSFile(path, "wb") as out, pa.ipc.new_stream(out, run.schema) as writer:
                writer.write_table(run, max_chunksize=block_rows)
            sources.append(path)

        kept(one)
        kept(more)
        del one, more
        for run in runs:
            kept(run)
        files = [pa.OSFile(path, "rb") for path in sources]
        readers = [pa.ipc.open_stream(f) for f in files]
        heads: dict[int, pa.Table] = {}

        def refill(i: int) -> None:
            try:
                heads[i] = pa.Table.from_batches([readers[i].read_next_batch()])
            except StopIteration:
                heads.pop(i, None)

        for i in range(len(readers)):
            refill(i)
        while heads:
            bound = min(map(last, heads.values()))  # what comes up to here is in the heads
            parts = []
            for i, t in list(heads.items()):
                n = up_to(t, bound)
                if n:
                    parts.append(t.slice(0, n))
                    heads[i] = t.slice(n)
                    if n == t.num_rows:
                        refill(i)
            yield pa.concat_tables(parts).sort_by(by)
        for f in files:
            f.close()


class ReorderProcessor(StatefulProcessor):
    """Holds events until the newest time seen is ``tolerance`` ahead, then lets them go in
    (time, seq) order. Over ``capacity`` the oldest leave early, down to three quarters. An event older
    than what has left goes out at once and is marked late; nothing is dropped. A row with ``flush`` set
    lets everything go after it; without an event_id it is no event itself."""

    SCHEMA = "key int, event_id string, ts_exchange_ns bigint, seq bigint, release_no bigint, late boolean"
    ORDER = ["arrival", "event_id"]
    COLUMNS = {"arrival": pa.int64(), "event_id": pa.string(), "ts_exchange_ns": pa.int64(), "seq": pa.int64(), "flush": pa.bool_()}
    #: Rows of one frame that goes out.
    OUT_ROWS = 50_000

    def __init__(self, tolerance_ns: int, capacity: int):
        self.tolerance, self.capacity = tolerance_ns, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "ts bigint, seq bigint, event_id string")
        self.marks = handle.getValueState("marks", "newest bigint, released bigint, count bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, released, count = self.marks.get() if self.marks.exists() else (None, None, 0)
        heap = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        heapq.heapify(heap)
        out = []

        def let_go() -> None:
            nonlocal released, count
            ts, seq, event_id = heapq.heappop(heap)
            late = released is not None and ts < released
            released = ts if released is None else max(released, ts)
            count += 1
            out.append((key[0], event_id, ts, seq, count, late))

        def gone() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["key", "event_id", "ts_exchange_ns", "seq", "release_no", "late"])

        for block in sorted_blocks(rows, self.COLUMNS, self.ORDER):
            for ts, seq, event_id, flush in zip(*(block[c].to_pylist() for c in ("ts_exchange_ns", "seq", "event_id", "flush"))):
                if event_id is not None:
                    heapq.heappush(heap, (int(ts), int(seq), event_id))
                    newest = int(ts) if newest is None else max(newest, int(ts))
                while heap and heap[0][0] <= newest - self.tolerance:
                    let_go()
                if len(heap) > self.capacity:
                    while len(heap) > int(self.capacity * 0.75):
                        let_go()
                if flush:
                    while heap:
                        let_go()
            if len(out) >= self.OUT_ROWS:
                yield gone()
                out.clear()
        self.marks.update((newest, released, count))
        if heap:
            self.held.put(heap)
        else:
            self.held.clear()
        if out:
            yield gone()

    def close(self) -> None:
        pass


class SequencerProcessor(StatefulProcessor):
    """Last seq per (venue, symbol); gap rows out. A row with ``reset`` set forgets the last seq."""

    SCHEMA = "venue_id int, symbol_id int, expected_seq bigint, received_seq bigint, gap_class string"
    ORDER = ["ts_ingest_ns", "event_id"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, self.ORDER)
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for seq, reset in zip(batch.seq, batch.reset):
            if reset:
                last = None
            if last is not None and seq != last + 1:
                size = seq - last - 1
                kind = "large_gap" if size > 100 else "gap" if size > 0 else "out_of_order"
                out.append((*key, last + 1, int(seq), kind))
            last = int(seq)
        self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["venue_id", "symbol_id", "expected_seq", "received_seq", "gap_class"])

    def close(self) -> None:
        pass


class PositionProcessor(StatefulProcessor):
    """Position per symbol after every micro-batch, by the same step as the batch fold."""

    SCHEMA = "symbol_id int, net_qty_fp bigint, avg_entry_price_fp bigint, realized_pnl_fp bigint, last_fill_ts_ns bigint"
    ORDER = ["ts_ns", "seq"]

    def __init__(self, scale: int = 1_000_000):
        self.scale = scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "net bigint, avg bigint, pnl bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, self.ORDER)
        net, avg, pnl = self.state.get() if self.state.exists() else (0, 0, 0)
        last = 0
        for side, price, qty, ts in zip(batch.side, batch.price_fp, batch.qty_fp, batch.ts_ns):
            net, avg, pnl = apply_fill(net, avg, pnl, int(side), int(price), int(qty), self.scale)
            last = int(ts)
        self.state.update((net, avg, pnl))
        yield pd.DataFrame([(key[0], net, avg, pnl, last)], columns=[c.split()[0] for c in self.SCHEMA.split(", ")])

    def close(self) -> None:
        pass


class CooldownProcessor(StatefulProcessor):
    """An alert goes out when none of its type did within the cooldown."""

    SCHEMA = "alert_type int, seq bigint, sent boolean"
    ORDER = ["ts_ns", "seq"]

    def __init__(self, cooldown_ns: int):
        self.cooldown = cooldown_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expiry = handle.getValueState("expiry", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, self.ORDER)
        expiry = self.expiry.get()[0] if self.expiry.exists() else -(2**63)
        out = []
        for ts, seq in zip(batch.ts_ns, batch.seq):
            sent = int(ts) >= expiry
            if sent:
                expiry = int(ts) + self.cooldown
            out.append((key[0], int(seq), sent))
        self.expiry.update((expiry,))
        yield pd.DataFrame(out, columns=["alert_type", "seq", "sent"])

    def close(self) -> None:
        pass


class RetentionProcessor(StatefulProcessor):
    """Nodes of the sliding window. Rows are sights of a node (kind, time, and what they set: ``depth`` or nothing,
    ``cancel`` 0 or 1). Out goes a row for each node that the retention lets go: events, trades and time buckets by
    their first sight, orders that are empty or cancelled and empty price levels by their last. Other kinds stay.
    A node that is seen again afterwards begins anew. What happens depends on event time only: a later sight or,
    without one, the watermark brings a removal out.

    A key is a share of all nodes: their states are read and written together, with one timer for the next node that
    leaves, since a call per node and state takes far longer than the fold itself."""

    SCHEMA = "id string, kind int, created_at_ns bigint, updated_at_ns bigint, removed_at_ns bigint"
    ORDER = ["ts_ns", "seq"]

    def __init__(self, retention_ns: int, by_creation: list[int], order: int, level: int):
        self.retention, self.by_creation, self.order, self.level = retention_ns, set(by_creation), order, level

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # id -> (kind, created, updated, depth, cancel), pickled
        self.share = handle.getValueState("share", "nodes binary")

    def _leaves(self, node: tuple) -> int | None:
        """The last moment at which the node is there, if nothing happens to it; None if it stays."""
        kind, created, updated, depth, cancel = node
        if kind in self.by_creation:
            return created + self.retention
        if (kind == self.order and (depth == 0 or cancel >= 1)) or (kind == self.level and depth == 0):
            return updated + self.retention
        return None

    def _read(self) -> dict:
        return pickle.loads(bytes(self.share.get()[0])) if self.share.exists() else {}

    def _write(self, nodes: dict) -> None:
        if nodes:
            self.share.update((pickle.dumps(nodes),))
        else:
            self.share.clear()
        leaves = [at for at in map(self._leaves, nodes.values()) if at is not None]
        if leaves:
            self.handle.registerTimer(min(leaves) // 1_000_000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, self.ORDER)
        if not len(batch):
            return
        nodes = self._read()
        out = []
        columns = (batch.id.tolist(), batch.kind.tolist(), batch.ts_ns.tolist(), batch.depth.astype("float64").tolist(), batch.cancel.tolist())
        for name, kind, ts, depth, cancel in zip(*columns):
            ts = int(ts)
            node = nodes.get(name)
            leaves = self._leaves(node) if node else None
            if leaves is not None and leaves < ts:
                out.append((name, node[0], node[1], node[2], leaves + 1))
                node = None
            _, created, updated, held, cancelled = node or (None, ts, ts, 0.0, 0)
            nodes[name] = (int(kind), created, max(updated, ts), held if depth != depth else depth, max(cancelled, int(cancel)))
        self._write(nodes)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        nodes, now = self._read(), timerValues.getCurrentWatermarkInMs()
        ends = [(name, node, leaves) for name, node in nodes.items() if (leaves := self._leaves(node)) is not None and leaves // 1_000_000 + 1 <= now]
        for name, _, _ in ends:
            del nodes[name]
        if ends:
            self._write(nodes)
            yield self._rows([(name, node[0], node[1], node[2], leaves + 1) for name, node, leaves in ends])

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in self.SCHEMA.split(", ")])

    def close(self) -> None:
        pass
