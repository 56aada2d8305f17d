"""Account histories as keyed state of a stream: what a batch reads grows with the batch, not with the window.

Two stateful operators follow each other. ``Histories`` keeps each account's live transfers of both directions and its
lifetime totals; for every account that a batch touches it hands on what it has kept, the batch's own rows, and the names of the
accounts that have lately paid it. ``Receivers`` keeps what each account has sent, and hands it on for accounts so named. The
batch plans then run over those rows as they do over a whole history.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.adjacency import TOTALS, account_rows
from ..schema import Config

#: Kinds of rows: kept from earlier batches, new in this one, totals of what is no longer kept, an account asked for, what such an account has sent.
KEPT, NEW, TOTAL, WANTED, SENT = "kept", "new", "total", "wanted", "sent"
_ENTRY = ("dir", "peer", "seq", "m", "amount", "ach")


def _millis(m: int) -> int:
    return m * 60_000


class Histories(StatefulProcessor):
    """An account's last ``cap`` transfers of each direction within the window, and totals over what came before them.

    An event-time timer drops the entries of an account that went quiet; its totals stay.
    """

    def __init__(self, kind: str, cfg: Config):
        self.kind, self.cfg = kind, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", f"dir string, peer {self.kind}, seq long, m long, amount double, ach int")
        self.totals = handle.getValueState("totals", "history long, total_out long, total_in long, first_seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = [tuple(x) for x in self.entries.get()] if self.entries.exists() else []
        before = tuple(self.totals.get()) if self.totals.exists() else None
        new = sorted(rows, key=lambda r: r.seq)
        cfg, acct = self.cfg, key[0]
        if before:
            yield self._row(acct, TOTAL, totals=before)
        for x in kept:
            yield self._row(acct, KEPT, x)
        for r in new:
            yield self._row(acct, NEW, tuple(r[c] for c in _ENTRY), transfer=r.transfer)
        now = new[-1].m
        if any(r.dir == "O" for r in new):
            payers = {x[1]: x[3] for x in [*kept, *(tuple(r[c] for c in _ENTRY) for r in new)] if x[0] == "I" and x[3] >= new[0].m - cfg.window}
            for payer in payers:
                yield self._row(payer, WANTED, (None, None, new[0].seq, now, None, None))
        self._keep(kept + [tuple(r[c] for c in _ENTRY) for r in new], before, now)
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(_millis(now + cfg.window + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() // 60_000
        kept = [tuple(x) for x in self.entries.get()] if self.entries.exists() else []
        left = self._keep(kept, tuple(self.totals.get()) if self.totals.exists() else None, now)
        if left:
            self.handle.registerTimer(_millis(max(x[3] for x in left) + self.cfg.window + 1))
        return iter(())

    def close(self) -> None:
        pass

    def _keep(self, entries: list[tuple], before: tuple | None, now: int) -> list[tuple]:
        """Store what a later transfer, at ``now`` or after, can still see; the rest goes into the totals."""
        left, gone = [], []
        for d in ("O", "I"):
            own = [x for x in entries if x[0] == d]
            live = [x for x in own[-self.cfg.cap :] if x[3] >= now - self.cfg.window]
            left += live
            gone += own[: len(own) - len(live)]
        gone += [x for x in entries if x[0] == "S"]
        if gone:
            sent, got = (sum(x[0] == d for x in gone) for d in ("O", "I"))
            first = min(x[3] for x in gone)
            h, o, i, f = before or (0, 0, 0, first)
            self.totals.update((h + sent + got, o + sent, i + got, min(f, first)))
        if left:
            self.entries.put(sorted(left, key=lambda x: x[2]))
        else:
            self.entries.clear()
        return left

    @staticmethod
    def _row(acct, kind: str, entry: tuple = (None,) * 6, totals: tuple = (None,) * 4, transfer: Row | None = None) -> Row:
        return Row(acct=acct, kind=kind, **dict(zip(_ENTRY, entry)), **dict(zip(TOTALS, totals)), transfer=transfer)


class Receivers(StatefulProcessor):
    """An account's last ``cap`` outgoing transfers within the window, numbered from its first one on."""

    def __init__(self, kind: str, cfg: Config):
        self.kind, self.cfg = kind, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getListState("sent", f"peer {self.kind}, seq long, m long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new, wanted, now = [], False, 0
        for r in rows:
            if r.kind == WANTED:
                wanted, now = True, max(now, r.m)
            else:
                if r.kind == NEW and r.dir == "O":
                    new.append((r.peer, r.seq, r.m))
                yield r
        sent = [tuple(x) for x in self.sent.get()] if self.sent.exists() else []
        last = sent[-1][3] if sent else 0
        sent += [(*x, last + k) for k, x in enumerate(sorted(new, key=lambda x: x[1]), 1)]
        if wanted:
            for peer, seq, m, n in sent:
                yield Histories._row(key[0], SENT, ("O", peer, seq, m, None, None), (None, n, None, None))
        now = max([now, *(x[2] for x in new)])
        if sent:
            # The last one carries the number on, however old it is.
            self.sent.put([x for x in sent[-self.cfg.cap : -1] if x[2] >= now - self.cfg.window] + sent[-1:])

    def close(self) -> None:
        pass


def histories(stamped: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The keyed rows of a stream of transfers whose minute ``m`` never falls from one batch to the next.

    Columns: ``acct``, ``kind``, an entry (``dir``, ``peer``, ``seq``, ``m``, ``amount``, ``ach``), totals, and for new rows of a
    sender the ``transfer`` itself. An account's rows of one batch meet in one task; what a task keeps of it is bounded by the cap.
    """
    acct = stamped.schema["src"].dataType.simpleString()
    each = account_rows(stamped.withColumn("transfer", F.struct(*stamped.columns)), ("transfer",))
    each = each.withColumn("transfer", F.when(F.col("dir") != "I", F.col("transfer"))).withColumn("at", F.timestamp_seconds(F.col("m") * 60)).withWatermark("at", "1 minute")
    held = each.schema["transfer"].dataType.simpleString()
    out = f"acct {acct}, kind string, dir string, peer {acct}, seq long, m long, amount double, ach int, history long, total_out long, total_in long, first_seen long, transfer {held}"
    kept = each.groupBy("acct").transformWithState(Histories(acct, cfg), out, "append", "EventTime")
    return kept.groupBy("acct").transformWithState(Receivers(acct, cfg), out, "append", "None")
