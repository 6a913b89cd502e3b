"""Front ends of the engine: JSON-RPC over lines of text, a command line, plain-text output.

Tool names may get a prefix (``tool_prefix`` of the config) where a client expects one.
"""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
from collections.abc import Iterable
from typing import IO, Any

from pyspark.sql import SparkSession

from .engine import Engine
from .sources import config as C
from .sources.embedding import Service

# Protocol dates and error codes.
PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, REQUEST, METHOD, PARAMS = -32700, -32600, -32601, -32602


class ToolError(ValueError):
    """What the caller of a tool did wrong."""


def format_hits(found: dict) -> str:
    weights = f", coverage {found['lexical_coverage']}, vector weight {found['vec_weight']}" if found["mode"] == "hybrid" else ""
    head = f"{len(found['hits'])} hits, {found['mode']} ({found['lexical_backend']}{weights})" + (f" ({found['note']})" if found["note"] else "")
    rows = [f"{h['place']}. {h['ref']}:{h['line_start']}-{h['line_end']}" + (f"  {h['heading']}" if h["heading"] else "") + f"  [{h['score']}]\n   {h['snippet']}" for h in found["hits"]]
    return "\n".join([head, *rows])


def format_section(got: dict) -> str:
    if "error" in got:
        return "\n".join([got["error"], *(f"  {x}" for x in got.get("candidates") or got.get("headings") or [])])
    return f"{got['ref']}:{got['line_start']}-{got['line_end']}  {got['title']}\n\n{got['text']}" + ("\n[cut]" if got["truncated"] else "")


def format_recent(rows: list[dict]) -> str:
    return "\n".join(f"{r['modified']}  {r['ref']}  {r['chunks']} chunks, {r['size']} bytes" for r in rows) or "no files"


def format_status(s: dict) -> str:
    rows = [f"{c['name']}: {c['root']}, {'available' if c['available'] else 'not available'}, {c.get('files', 0)} files, {c.get('chunks', 0)} chunks" for c in s["corpora"]]
    age = "never indexed" if s["age_seconds"] is None else f"indexed {s['age_seconds']:.0f} s ago"
    hint = [] if s["corpora"] else [f"no corpora are configured: name some in {s['config_hint']}"]
    return "\n".join([f"{s['index']}: {age}", *rows, *hint, f"embedded: {s['embedded']} of {s['chunks']}" + (f" ({s['embedder_note']})" if s["embedder_note"] else "")])


def _schema(required: Iterable[str] = (), **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(required)}


class Service:
    def __init__(self, engine: Engine):
        self.engine, self.prefix = engine, engine.config.get("tool_prefix", "")
        self.stopping, self.worker, self.last_run = threading.Event(), None, None
        self.calls = {"search": self._search, "get": self._get, "recent": self._recent, "reindex": self._reindex, "status": self._status}

    def tools(self) -> list[dict]:
        names = [c.name for c in self.engine.corpora]
        text, whole = {"type": "string"}, lambda low, high: {"type": "integer", "minimum": low, "maximum": high}
        among = {"type": "array", "items": {**text, **({"enum": names} if names else {})}}
        told = {
            "search": ("Ranked excerpts for a query.", _schema(["query"], query=text, corpora=among, k=whole(1, 20), mode={**text, "enum": ["auto", "lexical", "hybrid"]})),
            "get": ("A file, or a section of it by a part of its heading.", _schema(["path"], path=text, heading=text, max_chars=whole(500, 100_000))),
            "recent": ("Files changed lately, newest first.", _schema(corpus=text, days={"type": "number"}, limit=whole(1, 100))),
            "reindex": ("Bring the index up to date.", _schema(full={"type": "boolean"}, corpora=among)),
            "status": ("What the index holds and how old it is.", _schema()),
        }
        return [{"name": self.prefix + n, "description": d, "inputSchema": s, "annotations": {"readOnlyHint": n != "reindex"}} for n, (d, s) in told.items()]

    def refresh(self, reason: str) -> bool:
        """Start an index run in the background if the index is older than ``auto_index_minutes``
        and none is running; whether one was started."""
        minutes = self.engine.config.get("auto_index_minutes")
        age = time.time() - self.engine.manifest().get("indexed_at", 0)
        if not minutes or self.stopping.is_set() or age <= 60 * minutes or (self.worker and self.worker.is_alive()):
            return False
        self.worker = threading.Thread(target=self._run, args=(reason,), name="index", daemon=True)
        self.worker.start()
        return True

    def _run(self, reason: str) -> None:
        try:
            self.last_run = {"trigger": reason, **self.engine.index(should_stop=self.stopping.is_set, stop_within=1.0)}
        except Exception as e:  # noqa: BLE001 - the session goes on with the index it has
            self.last_run = {"trigger": reason, "error": f"{type(e).__name__}: {e}"}

    def _search(self, query: str = "", corpora: list[str] | None = None, k: int = 6, mode: str = "auto") -> str:
        if not query.strip():
            raise ToolError("query is empty")
        unknown = sorted(set(corpora or ()) - {c.name for c in self.engine.corpora})
        if unknown:
            raise ToolError("unknown corpora: " + ", ".join(unknown))
        started = self.refresh("search")
        found = self.engine.search(query, corpora or (), k, mode)
        if started:
            found["note"] = "; ".join(filter(None, [found["note"], "the index is being brought up to date"]))
        return format_hits(found)

    def _get(self, path: str = "", heading: str | None = None, max_chars: int = 20_000) -> str:
        if not path:
            raise ToolError("path is empty")
        got = self.engine.get(path, heading, max_chars)
        if "error" in got:
            raise ToolError(format_section(got))
        return format_section(got)

    def _recent(self, corpus: str | None = None, days: float = 7, limit: int = 20) -> str:
        return format_recent(self.engine.recent(corpus, days, limit))

    def _reindex(self, full: bool = False, corpora: list[str] | None = None) -> str:
        return json.dumps(self.engine.index(full, corpora or ()))

    def _status(self) -> str:
        return format_status(self.engine.status())

    def call(self, name: str, arguments: dict) -> dict:
        """Errors of a tool are results; they don't end the session."""
        try:
            text, failed = self.calls[name.removeprefix(self.prefix)](**arguments), False
        except (ToolError, TypeError) as e:
            text, failed = str(e), True
        except Exception as e:  # noqa: BLE001 - whatever broke, the client gets an answer
            text, failed = f"{type(e).__name__}: {e}", True
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def handle(self, message: Any) -> Any:
        """The answer to one message or to a list of them; None where none is due."""
        if isinstance(message, list):
            if not message:
                return _failed(None, REQUEST, "empty batch")
            return [a for a in map(self.handle, message) if a is not None] or None
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return _failed(message.get("id") if isinstance(message, dict) else None, REQUEST, "not a request")
        id_, method, params = message.get("id"), message["method"], message.get("params") or {}
        if "id" not in message:
            return None
        if method == "initialize":
            asked = params.get("protocolVersion")
            result = {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "lodestack", "version": "0.1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": self.tools()}
        elif method in ("resources/list", "resources/templates/list", "prompts/list"):
            result = {{"resources/list": "resources", "prompts/list": "prompts"}.get(method, "resourceTemplates"): []}
        elif method == "tools/call":
            name = params.get("name")
            if not isinstance(name, str) or not name.startswith(self.prefix) or name.removeprefix(self.prefix) not in self.calls:
                return _failed(id_, PARAMS, f"unknown tool: {name}")
            result = self.call(name, params.get("arguments") or {})
        else:
            return _failed(id_, METHOD, f"unknown method: {method}")
        return {"jsonrpc": "2.0", "id": id_, "result": result}

    def serve(self, source: Iterable[str], sink: IO[str]) -> None:
        """One message a line, until the source ends; a run in the background is then stopped."""
        self.refresh("start")
        for line in source:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except json.JSONDecodeError as e:
                answer = _failed(None, PARSE, str(e))
            if answer is not None:
                sink.write(json.dumps(answer, ensure_ascii=False) + "\n")
                sink.flush()
        self.stopping.set()
        if self.worker:
            self.worker.join()


def _failed(id_: Any, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": text}}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestack")
    p.add_argument("--config", help="a configuration that is merged last")
    p.add_argument("--index", help="folder of the index")
    p.add_argument("--json", action="store_true", help="print JSON")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index")
    x.add_argument("--full", action="store_true")
    x.add_argument("--corpus", action="append", default=[])
    x.add_argument("--if-older-than", type=float, help="seconds")
    x.add_argument("--no-embed", action="store_true", help="leave embeddings for a later run")
    x = sub.add_parser("search")
    x.add_argument("query")
    x.add_argument("--corpus", action="append", default=[])
    x.add_argument("-k", type=int, default=6)
    x.add_argument("--mode", default="auto")
    x = sub.add_parser("get")
    x.add_argument("path")
    x.add_argument("--heading")
    x.add_argument("--max-chars", type=int, default=20_000)
    x = sub.add_parser("recent")
    x.add_argument("--corpus")
    x.add_argument("--days", type=float, default=7)
    x.add_argument("--limit", type=int, default=20)
    sub.add_parser("status").add_argument("--no-probe", action="store_true", help="don't ask the embedding service")
    sub.add_parser("config").add_argument("--init", action="store_true", help="make the user's file")
    sub.add_parser("serve")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, source: Iterable[str] = sys.stdin, sink: IO[str] | None = None) -> int:
    a, sink = _parser().parse_args(argv), sink or sys.stdout
    if a.command == "config" and a.init:
        path, made = C.init_user()
        print(f"{path} {'is new' if made else 'was there already'}", file=sink)
        return 0
    config = C.resolve(a.config)
    if a.command == "config":
        print(json.dumps(config, indent=2), file=sink)
        return 0
    embedder = Service.of(config["embedder"]) if config.get("embedder") else None
    index = a.index or config.get("index_path") or "lodestack-index"
    engine = Engine(spark or SparkSession.builder.appName("lodestack").getOrCreate(), config, index, embedder, embedder.signature if embedder else "default")
    if a.command == "serve":
        Service(engine).serve(source, sink)
        return 0
    show: Any = json.dumps
    if a.command == "index":
        got: Any = engine.index(a.full, a.corpus, a.if_older_than, embed=not a.no_embed)
    elif a.command == "search":
        got, show = engine.search(a.query, a.corpus, a.k, a.mode), format_hits
    elif a.command == "get":
        got, show = engine.get(a.path, a.heading, a.max_chars), format_section
    elif a.command == "recent":
        got, show = engine.recent(a.corpus, a.days, a.limit), format_recent
    else:
        got, show = engine.status(not a.no_probe), format_status
    print(json.dumps(got, default=str, ensure_ascii=False) if a.json else show(got), file=sink)
    return 1 if isinstance(got, dict) and "error" in got else 0
