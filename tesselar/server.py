"""The tools over lines of JSON-RPC: a request on each line in, a response on each line out."""

from __future__ import annotations

import json
import sys
from typing import IO, Any

from pyspark.sql import SparkSession

from tesselar import tools

PROTOCOL = "2024-11-05"


def answer(spark: SparkSession | None, request: dict[str, Any]) -> dict[str, Any] | None:
    """The response to a request; None for a notification."""
    method, number = request.get("method"), request.get("id")
    if number is None:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": number}
    params = request.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "serverInfo": {"name": "tesselar", "version": tools.VERSION}, "capabilities": {"tools": {}}}}
    if method == "tools/list":
        return reply | {"result": {"tools": tools.describe()}}
    if method == "tools/call":
        result = tools.call(spark, params.get("name", ""), params.get("arguments"))
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(result, default=str)}], "isError": result["status"] != "ok"}}
    return reply | {"error": {"code": -32601, "message": f"there is no method {method}"}}


def serve(spark: SparkSession | None, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Answers until the input ends. A line that isn't a request is reported and skipped."""
    for line in source:
        try:
            request = json.loads(line)
            if not isinstance(request, dict):
                raise ValueError("not an object")
        except ValueError as e:
            print(f"skipped a line: {e}", file=sys.stderr)
            continue
        if (reply := answer(spark, request)) is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()
