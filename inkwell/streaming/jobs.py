"""Streams: the issue lifecycle as scans arrive, and guardrails on requests as they come.

Scans carry their findings as an array, so that an empty scan still resolves what it no longer finds. The state of a page
are its issues with their latest scan, open and resolved apart; a micro-batch is applied to it in order of scan_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import guard

ISSUE = "times_seen long, first_scan long, last_scan long, status string, resolved_scan long, message string"
ISSUES = f"page_id long, rule_code string, element_selector string, {ISSUE}, dropped long"
KEY = "rule_code string, element_selector string"


class IssueLifecycle(StatefulProcessor):
    """State of one page: its open issues, its resolved ones, and the newest scan applied.

    A scan reads the open issues and those resolved ones that it finds again; only issues that it changes are given out. Scans that
    are not newer than the newest are dropped and counted: a row with status LATE and without an issue tells how many. With ``keep_ms`` an issue that was resolved by a scan so long ago, in event
    time, is forgotten by a timer, and counts as new if it comes again.
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", KEY, ISSUE)
        self.resolved = handle.getMapState("resolved", KEY, f"{ISSUE}, forget_at long")
        self.newest = handle.getValueState("newest", "scan_id long, dropped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scans = pd.concat(list(rows)).sort_values("scan_id", kind="stable")
        newest, dropped = self.newest.get() if self.newest.exists() else (None, 0)
        touched: dict[tuple[str, str], tuple] = {}
        times = scans["scanned_at"].tolist() if "scanned_at" in scans else [None] * len(scans)
        for scan_id, status, findings, at in zip(scans["scan_id"].tolist(), scans["status"].tolist(), scans["findings"].tolist(), times):
            if newest is not None and scan_id <= newest:
                dropped += 1
                continue
            newest = scan_id
            if status == "COMPLETED":
                self._apply(scan_id, findings if findings is not None else [], at, touched)
        late = dropped - (self.newest.get()[1] if self.newest.exists() else 0)
        self.newest.update((newest, dropped))
        if late:
            touched[None, None] = (late, None, None, "LATE", None, None)
        yield self._rows(key, touched, dropped)

    def _apply(self, scan_id: int, findings, at, touched: dict) -> None:
        seen: dict[tuple[str, str], str] = {}
        for f in findings:
            k = (f["rule_code"], f["element_selector"])
            seen[k] = max(seen.get(k, ""), f["message"] or "")
        for k, v in [(tuple(k), tuple(v)) for k, v in self.open.iterator()]:
            if k not in seen:
                self.open.removeKey(k)
                touched[k] = (*v[:3], "RESOLVED", scan_id, v[5])
                self.resolved.updateValue(k, (*touched[k], self._due(at)))
        for k, message in seen.items():
            if self.open.containsKey(k):
                times, first, _, status, _, _ = tuple(self.open.getValue(k))
                touched[k] = (times + 1, first, scan_id, status, None, message)
            elif self.resolved.containsKey(k):
                times, first = tuple(self.resolved.getValue(k))[:2]
                self.resolved.removeKey(k)
                touched[k] = (times + 1, first, scan_id, "REOPENED", None, message)
            else:
                touched[k] = (1, scan_id, scan_id, "OPEN", None, message)
            self.open.updateValue(k, touched[k])

    def _due(self, at) -> int | None:
        if self.keep_ms is None or at is None:
            return None
        due = int(pd.Timestamp(at).timestamp() * 1000) + self.keep_ms
        self.handle.registerTimer(due)
        return due

    def _rows(self, key, touched: dict, dropped: int) -> pd.DataFrame:
        out = [(key[0], *k, *v, dropped) for k, v in touched.items()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ISSUES.split(", ")]).astype(dict.fromkeys(("first_scan", "last_scan", "resolved_scan"), "Int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for k, v in [(tuple(k), tuple(v)) for k, v in self.resolved.iterator()]:
            if v[-1] is not None and v[-1] <= now:
                self.resolved.removeKey(k)
                _, dropped = self.newest.get()
                yield self._rows(key, {k: (*v[:3], "EXPIRED", v[4], v[5])}, dropped)

    def close(self) -> None:
        pass


def issue_lifecycle_stream(scans: DataFrame, keep: timedelta | None = None, lateness: str = "0 seconds") -> DataFrame:
    """The issues that a micro-batch's scans change, and, if they don't stay for ever, those that it lets expire.

    scans: page_id, scan_id, status, findings (array of rule_code, element_selector, message), and scanned_at with ``keep``: resolved
    issues leave the state when event time is so far past the scan that resolved them, as status EXPIRED. Scans later than
    ``lateness`` behind the latest are not read then.
    """
    timed = keep is not None
    rows = scans.withWatermark("scanned_at", lateness) if timed else scans
    processor = IssueLifecycle(int(keep.total_seconds() * 1000) if timed else None)
    return rows.groupBy("page_id").transformWithStateInPandas(processor, outputStructType=StructType.fromDDL(ISSUES), outputMode="Update", timeMode="EventTime" if timed else "None")


def guardrail_stream(requests: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """One row per request; all checks of a request stay in its row, so that no state is kept."""
    return guard.guardrail_rows(requests, policies)


def start_guardrails(requests: DataFrame, path: str, checkpoint: str, policies: list[str] | None = None) -> StreamingQuery:
    """Appends results as Parquet; the file sink's log makes a repeated micro-batch harmless."""
    return guardrail_stream(requests, policies).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
