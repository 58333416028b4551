"""Connection settings from the environment or a file of NAME=value lines."""

from __future__ import annotations

import csv
import json
import os
import ssl
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

TRUE = frozenset({"1", "true", "yes", "on"})


@dataclass(frozen=True)
class StoreSettings:
    url: str
    token: str
    org: str
    bucket: str
    verify_tls: bool = True


def read_lines(path: str) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and quotes around values go."""
    found = {}
    for line in Path(path).read_text().splitlines() if os.path.exists(path) else []:
        name, sep, value = line.strip().partition("=")
        if sep and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("'\"")
    return found


def load(prefix: str = "INFLUX", env: Mapping[str, str] | None = None, path: str = ".env") -> StoreSettings:
    """Settings by prefix; the environment wins over the file. The error names every missing one."""
    values = {**read_lines(path), **(os.environ if env is None else env)}
    names = {k: f"{prefix}_{k.upper()}" for k in ("url", "token", "org", "bucket")}
    missing = [n for n in names.values() if not values.get(n)]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return StoreSettings(**{k: values[n] for k, n in names.items()}, verify_tls=values.get(f"{prefix}_VERIFY_SSL", "true").lower() in TRUE)


def flux(bucket: str, start: str = "-30d") -> str:
    """The store's own query text: a time range, pushed down, and fields pivoted to columns."""
    return f'from(bucket: "{bucket}") |> range(start: {start}) |> pivot(rowKey: ["_time"], columnKey: ["_field"], valueColumn: "_value")'


def annotated(lines: Iterable[str]) -> Iterator[dict[str, str]]:
    """Records of the store's CSV answer: tables one after the other, each with its own header; time and measurement renamed, its own fields left out."""
    header: list[str] | None = None
    for row in csv.reader(lines):
        if not row or not any(row):
            header = None
        elif row[0].startswith("#"):
            continue
        elif header is None:
            header = row
        else:
            own = dict(zip(header, row, strict=False))
            yield {"time": own.get("_time", ""), "measurement": own.get("_measurement", ""), **{k: v for k, v in own.items() if k and not k.startswith("_") and k not in ("result", "table")}}


def export(records: Iterable[dict[str, str]], path: str) -> int:
    """Records as a CSV file with all their fields in order; it takes the place of an older one whole, and without records that one stays."""
    rows = list(records)
    if not rows:
        raise RuntimeError("the store returned no rows")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = Path(path).with_suffix(".tmp")
    with part.open("w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, fieldnames=sorted({k for r in rows for k in r}))
        writer.writeheader()
        writer.writerows(rows)
    part.replace(path)
    return len(rows)


def fetch(settings: StoreSettings, path: str, start: str = "-30d", timeout_s: float = 120.0) -> int:
    """Query the store over HTTP and export the answer; the number of records."""
    body = json.dumps({"query": flux(settings.bucket, start), "type": "flux", "dialect": {"header": True, "annotations": []}}).encode()
    headers = {"Authorization": f"Token {settings.token}", "Content-Type": "application/json", "Accept": "application/csv"}
    request = urllib.request.Request(f"{settings.url.rstrip('/')}/api/v2/query?org={urllib.parse.quote(settings.org)}", body, headers)
    context = None if settings.verify_tls else ssl._create_unverified_context()
    with urllib.request.urlopen(request, timeout=timeout_s, context=context) as answer:
        return export(annotated(line.decode() for line in answer), path)
