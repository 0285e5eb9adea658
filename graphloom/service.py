"""One entry for all operations: requests are checked against their limits, dispatched, and answered with a body or an error."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions import values
from graphloom.operators import retrieval, search
from graphloom.streaming import watch

#: Operations, error codes, limits of requests, and how many may run at once.
OPERATIONS = ("capabilities", "status", "search", "suggest", "references", "reindex_admit", "reindex_status", "reindex_wait", "reindex_cancel", "shutdown")
ERRORS = ("invalid_request", "invalid_cursor", "stale_cursor", "incompatible_protocol", "peer_rejected", "busy", "not_ready", "revision_mismatch", "index_build_failed", "idempotency_conflict", "operation_not_found", "operation_control_forbidden", "internal")
RETRYABLE = ("busy", "not_ready", "revision_mismatch", "index_build_failed")
MAX_QUERY_BYTES, MAX_HITS, MAX_SUGGESTIONS, MAX_REFERENCES, IN_FLIGHT = 4096, 1000, 50, 500, 16
CAPABILITIES = ("inspect", "search", "suggest", "references", "extract", "plan", "prepare", "preview", "commit", "recover")
MUTATIONS = ("field_replace", "reference_replace", "schema_replace", "resource_replace", "sequence_edit", "unsafe_raw_replace")
PROTOCOL = 1


class ApiError(Exception):
    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code, self.retryable = code, code in RETRYABLE


@dataclass
class Operation:
    key: str | None
    scope: str
    states: list[str] = field(default_factory=lambda: ["Queued"])

    def move(self, state: str) -> None:
        if state not in watch.NEXT.get(self.states[-1], ()):
            raise ApiError("operation_control_forbidden", f"{self.states[-1]} to {state}")
        self.states.append(state)


@dataclass
class Service:
    """Search over one published index. ``reindex(scope)`` makes the next one and returns its tables."""

    spark: SparkSession
    reindex: Callable[[str], tuple[DataFrame, DataFrame, DataFrame]]
    generation: int = 0
    _tables: tuple[DataFrame, DataFrame, DataFrame] | None = None
    _n: int = 0
    _operations: dict[str, Operation] = field(default_factory=dict)
    _closed: bool = False
    _slots: threading.BoundedSemaphore = field(default_factory=lambda: threading.BoundedSemaphore(IN_FLIGHT))

    def call(self, request: dict) -> dict:
        """{"ok": body} or {"error": {code, message, retryable}}; never raises."""
        if not self._slots.acquire(blocking=False):
            return self._error(ApiError("busy"))
        try:
            if request.get("protocol", PROTOCOL) != PROTOCOL:
                raise ApiError("incompatible_protocol")
            name = request.get("operation")
            if name not in OPERATIONS:
                raise ApiError("invalid_request", f"operation {name!r}")
            if self._closed:
                raise ApiError("not_ready", "shut down")
            return {"ok": getattr(self, f"_{name}")(request)}
        except ApiError as e:
            return self._error(e)
        except Exception as e:  # whatever else goes wrong is an answer, too
            return self._error(ApiError("internal", f"{type(e).__name__}: {e}"))
        finally:
            self._slots.release()

    @staticmethod
    def _error(e: ApiError) -> dict:
        return {"error": {"code": e.code, "message": str(e), "retryable": e.retryable}}

    def _ready(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        if self._tables is None:
            raise ApiError("not_ready", "no index yet")
        return self._tables

    def _capabilities(self, request: dict) -> dict:
        return {"protocol": PROTOCOL, "operations": list(OPERATIONS), "capabilities": list(CAPABILITIES), "mutations": list(MUTATIONS)}

    def _status(self, request: dict) -> dict:
        running = [k for k, o in self._operations.items() if o.states[-1] not in watch.FINAL]
        return {"generation": self.generation, "ready": self._tables is not None, "documents": self._n, "running": sorted(running)}

    @staticmethod
    def _limit(request: dict, default: int, most: int) -> int:
        limit = request.get("limit", default)
        if not isinstance(limit, int) or isinstance(limit, bool) or not 0 <= limit <= most:
            raise ApiError("invalid_request", f"limit {limit!r}")
        return limit

    def _search(self, request: dict) -> dict:
        raw = request.get("query")
        if not isinstance(raw, str) or len(raw.encode()) > MAX_QUERY_BYTES:
            raise ApiError("invalid_request", "query")
        table, postings, _ = self._ready()
        found = retrieval.execute(table, postings, self._n, raw, self._limit(request, 25, MAX_HITS))
        hits = [r.asDict(recursive=True) for r in found.matches.orderBy("rank").collect()]  # at most MAX_HITS rows
        return {"hits": hits, "count": found.count, "relation": found.relation, "fallback": found.fallback_used, "diagnostics": [{"code": c, "severity": retrieval.severity(c)} for c in found.diagnostics]}

    def _suggest(self, request: dict) -> dict:
        prefix, limit = request.get("prefix", ""), self._limit(request, 10, MAX_SUGGESTIONS)
        name, colon, rest = prefix.partition(":")
        kinds = search.suggest_kinds(rest if colon and name in ("t", "type") else prefix, limit) if not (colon and name == "in") else []
        paths = []
        if len(kinds) < limit and not (colon and name in ("t", "type")):
            table, _, _ = self._ready()
            paths = [r[0] for r in search.suggest_paths(table, rest if colon else prefix, limit - len(kinds)).collect()]
        return {"suggestions": kinds + paths}

    def _references(self, request: dict) -> dict:
        key, direction, limit = request.get("key"), request.get("direction"), self._limit(request, 100, MAX_REFERENCES)
        if not isinstance(key, str) or direction not in ("in", "out"):
            raise ApiError("invalid_request", "key or direction")
        _, _, keys = self._ready()
        query, after = f"{direction}|{key}", ""
        if token := request.get("cursor"):
            state, last = values.continued(token, str(self.generation), "v1", query)
            if state != "ok":
                raise ApiError({"StaleCursor": "stale_cursor"}.get(state, "invalid_cursor"))
            after = last or ""
        from graphloom.operators.resolution import reference_page

        rows = reference_page(keys, key, direction, after, limit).orderBy("rank").collect()  # at most MAX_REFERENCES rows
        more = bool(rows) and rows[0].truncated
        out = {"hits": [r.stable_id for r in rows], "total": rows[0].total if rows else 0, "complete": not more}
        return out | ({"cursor": values.cursor(str(self.generation), "v1", query, rows[-1].stable_id)} if more else {})

    def _reindex_admit(self, request: dict) -> dict:
        scope, key = request.get("scope", "reconcile"), request.get("idempotency_key")
        if scope not in ("full", "reconcile", "changed_paths"):
            raise ApiError("invalid_request", f"scope {scope!r}")
        for name, o in self._operations.items():
            if key is not None and o.key == key:
                if o.scope != scope:
                    raise ApiError("idempotency_conflict")
                return {"id": name, "state": o.states[-1]}
        name = uuid.uuid4().hex
        self._operations[name] = o = Operation(key, scope)
        if request.get("run", True):
            self._run(o)
        return {"id": name, "state": o.states[-1]}

    def _run(self, o: Operation) -> None:
        o.move("Running")
        try:
            tables = self.reindex(o.scope)
            self._n = tables[0].count()
        except Exception as e:
            o.move("Failed")
            raise ApiError("index_build_failed", str(e)) from e
        self._tables, self.generation = tables, self.generation + 1
        o.move("Succeeded")

    def _operation(self, request: dict) -> Operation:
        if request.get("id") not in self._operations:
            raise ApiError("operation_not_found")
        return self._operations[request["id"]]

    def _reindex_status(self, request: dict) -> dict:
        o = self._operation(request)
        return {"state": o.states[-1], "states": list(o.states)}

    def _reindex_wait(self, request: dict) -> dict:
        o, end = self._operation(request), time.monotonic() + min(request.get("seconds", 10), 60)
        while o.states[-1] not in watch.FINAL and time.monotonic() < end:
            time.sleep(0.05)
        return {"state": o.states[-1]}

    def _reindex_cancel(self, request: dict) -> dict:
        o = self._operation(request)
        o.move("Cancelled")
        return {"state": o.states[-1]}

    def _shutdown(self, request: dict) -> dict:
        self._closed = True
        return {}
