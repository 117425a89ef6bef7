"""A small JSON service over the stored tables; every request reads the last version that was written to the end."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscreen.config import Config
from barscreen.plans import report
from barscreen.sources.store import Store

SYMBOL = re.compile(r"[A-Z0-9&#._-]{1,32}")


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _plain(value: object) -> object:
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def records(found: DataFrame) -> list[dict]:
    return [{k: _plain(v) for k, v in r.asDict().items()} for r in found.collect()]


class Service:
    def __init__(self, store: Store, config: Config):
        self.store, self.config = store, config
        self.writing = threading.Lock()  # spares writers of this service the tries that they would lose to each other

    def _indicators(self) -> DataFrame:
        try:
            return self.store.table("indicators")
        except FileNotFoundError:
            raise Refused(503, "there are no indicators yet") from None

    def _symbol(self, raw: str) -> str:
        symbol = raw.upper().strip()
        if not SYMBOL.fullmatch(symbol):
            raise Refused(400, "bad symbol")
        return symbol

    def meta(self, query: dict) -> dict:
        c, bars = self.config, self._indicators()
        rules = {k: getattr(c.rules, k) for k in ("initial_stop_atr", "trailing_stop_atr", "max_hold_days", "min_hold_days")}
        quarantined = self.store.table("quarantine").select("symbol").distinct().count()
        return records(report.summary(bars))[0] | {"presets": sorted(c.presets), "default_preset": c.portfolio.default_preset, "exit_rules": rules, "slots": c.portfolio.slots, "quarantined": quarantined}

    def dates(self, query: dict) -> list:
        return records(report.recent_dates(self._indicators(), int(query.get("limit", 120))))

    def shortlist(self, query: dict) -> dict:
        bars = self._indicators()
        try:
            preset = self.config.preset(query.get("preset"))
            day = dt.date.fromisoformat(query["date"]) if query.get("date") else report.latest_date(bars)
        except (KeyError, ValueError) as error:
            raise Refused(400, str(error)) from None
        found = report.shortlist(bars, self.store.table("quarantine"), preset, self.config.rules, self.config.portfolio.min_warmup_bars, day)
        return {"date": str(day), "preset": preset.name, "rank_by": preset.rank_by, "columns": list(report.SHORTLIST_COLUMNS), "rows": records(found)}

    def positions(self, query: dict) -> dict:
        bars, held = self._indicators(), self.store.table("positions")
        day = report.latest_date(bars)
        return {"as_of": str(day), "open": records(report.position_status(held, bars, self.config.rules, self.config.indicators.ema_mid, day)), "closed": records(report.closed_positions(held))}

    def symbols(self, query: dict) -> list:
        return records(report.search_symbols(self._indicators(), query.get("q", "")))

    def symbol(self, raw: str, query: dict) -> dict:
        symbol = self._symbol(raw)
        self._indicators()
        bars = records(report.symbol_bars(self.store.symbol_indicators(symbol), symbol, int(query.get("days", 260))))
        if not bars:
            raise Refused(404, f"no data for {symbol}")
        shut = self.store.table("quarantine").filter(F.col("symbol") == symbol).select("from_date", "to_date", "reason")
        return {"symbol": symbol, "bars": bars, "corporate_actions": records(report.symbol_actions(self.store.table("corporate_actions"), symbol)), "quarantined": records(shut)}

    def add_position(self, body: dict) -> dict:
        symbol = self._symbol(str(body.get("symbol", "")))
        try:
            price, quantity = float(body["entry_price"]), int(body["quantity"])
            day = dt.date.fromisoformat(body["entry_date"]) if body.get("entry_date") else dt.date.today()
        except (KeyError, TypeError, ValueError):
            raise Refused(400, "entry_price and quantity are needed, and a date that can be read") from None
        if price <= 0 or quantity <= 0:
            raise Refused(400, "entry_price and quantity must be positive")
        self._indicators()
        if self.store.symbol_indicators(symbol).filter(F.col("trade_date") == F.lit(day)).isEmpty():
            raise Refused(400, f"{symbol} has no bar on {day}")
        return {"position_id": self.store.add_position(symbol, day, price, quantity), "symbol": symbol}

    def close_position(self, body: dict) -> dict:
        try:
            key, price = int(body["position_id"]), float(body["exit_price"])
            day = dt.date.fromisoformat(body["exit_date"]) if body.get("exit_date") else dt.date.today()
        except (KeyError, TypeError, ValueError):
            raise Refused(400, "position_id and exit_price are needed") from None
        if not self.store.close_position(key, day, price, str(body.get("reason", "manual"))):
            raise Refused(404, f"position {key} is not there, or is closed")
        return {"position_id": key, "closed": True}

    def delete_position(self, body: dict) -> dict:
        try:
            key = int(body["position_id"])
        except (KeyError, TypeError, ValueError):
            raise Refused(400, "position_id is needed") from None
        if not self.store.delete_position(key):
            raise Refused(404, f"position {key} is not there")
        return {"position_id": key, "deleted": True}

    def get(self, path: str, query: dict) -> object:
        if path.startswith("/api/symbol/"):
            return self.symbol(unquote(path.removeprefix("/api/symbol/")), query)
        routes = {"/api/meta": self.meta, "/api/dates": self.dates, "/api/shortlist": self.shortlist, "/api/positions": self.positions, "/api/symbols": self.symbols}
        if path not in routes:
            raise Refused(404, "no such route")
        return routes[path](query)

    def post(self, path: str, body: dict) -> object:
        routes = {"/api/positions": self.add_position, "/api/positions/close": self.close_position, "/api/positions/delete": self.delete_position}
        if path not in routes:
            raise Refused(404, "no such route")
        with self.writing:
            return routes[path](body)


def server(store: Store, config: Config, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    service = Service(store, config)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, make) -> None:
            try:
                status, found = 200, make()
            except Refused as error:
                status, found = error.status, {"error": str(error)}
            except ValueError as error:
                status, found = 400, {"error": str(error)}
            content = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            self._answer(lambda: service.get(url.path, {k: v[0] for k, v in parse_qs(url.query).items()}))

        def do_POST(self) -> None:
            content = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            self._answer(lambda: service.post(urlsplit(self.path).path, json.loads(content or b"{}")))

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(store: Store, config: Config, host: str, port: int) -> None:
    server(store, config, host, port).serve_forever()
