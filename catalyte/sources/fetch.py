"""Fetching images over HTTP inside tasks, with retries and a size limit."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib import error, request

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_BYTES, BACK_OFF, AGENTS = 10 << 20, (1.0, 3.0, 7.0), ("Mozilla/5.0", "curl/8")


def http_get(url: str, agent: str) -> tuple[int, str, bytes]:
    """(status, content type, content) of one request; content is cut one byte beyond the limit."""
    try:
        with request.urlopen(request.Request(url, headers={"User-Agent": agent}), timeout=30) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read(MOST_BYTES + 1)
    except error.HTTPError as e:
        return e.code, "", b""


def fetch_one(urls: list[str], get: Callable = http_get, sleep: Callable = time.sleep) -> tuple[bytes | None, int | None, str | None]:
    """Try each address in turn, each a few times with growing pauses; final answers are not retried."""
    status, problem = None, "no address"
    for url in urls:
        for turn, pause in enumerate((*BACK_OFF, None)):
            try:
                status, kind, content = get(url, AGENTS[turn % len(AGENTS)])
                if status == 200 and not kind.startswith("image/"):
                    problem = "not_an_image"
                elif status == 200 and len(content) > MOST_BYTES:
                    problem = "too_large"
                elif status == 200:
                    return content, status, None
                else:
                    problem = f"http_{status}"
                if status == 200 or 400 <= status < 500 and status != 429:
                    break
            except OSError as e:
                problem = f"{type(e).__name__}|{e}"[:2000]
            if pause is not None:
                sleep(pause)
    return None, status, problem


def fetched(images: DataFrame, key: str, url: str, fallback: str, get: Callable = http_get, sleep: Callable = time.sleep) -> DataFrame:
    """(key, content, status, error): one row an image, failures included."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: contents may be large
                row = batch.slice(k, 1)
                urls = [u for u in dict.fromkeys((row.column(1)[0].as_py(), row.column(2)[0].as_py())) if u]
                content, status, problem = fetch_one(urls, get, sleep)
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([content], pa.binary()), pa.array([status], pa.int32()), pa.array([problem], pa.string())], names=[key, "content", "status", "error"])

    return images.select(key, url, fallback).mapInArrow(run, f"{key} {kind}, content binary, status int, error string")
