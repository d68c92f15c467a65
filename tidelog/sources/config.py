"""Settings read from text, strictly: what is set but malformed is an error, never a default."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from dataclasses import dataclass

from tidelog.sources.contract import identifier

MIB = 1 << 20
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
GREATEST = (1 << 63) - 1


def text(settings: Mapping[str, str], name: str, default: str) -> str:
    return (settings.get(name) or "").strip() or default


def whole_number(settings: Mapping[str, str], name: str, default: int) -> int:
    value = (settings.get(name) or "").strip()
    if value and not re.fullmatch(r"[+-]?\d+", value):
        raise ValueError(f"{name}: not a whole number: {value!r}")
    return int(value) if value else default


def flag(settings: Mapping[str, str], name: str, default: bool) -> bool:
    value = (settings.get(name) or "").strip().lower()
    if not value:
        return default
    if value in ("1", "true", "yes", "on"):
        return True
    if value in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"{name}: not a boolean: {value!r}")


def seconds(settings: Mapping[str, str], name: str, default: float) -> float:
    """A duration such as 1h30m or 250ms, in seconds."""
    value = (settings.get(name) or "").strip()
    if not value:
        return default
    if not re.fullmatch(r"-?(\d+(\.\d+)?(ns|us|µs|ms|s|m|h))+", value):
        raise ValueError(f"{name}: not a duration: {value!r}")
    total = sum(float(n) * UNITS[unit] for n, unit in re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", value))
    return -total if value.startswith("-") else total


def listed(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


def least_budget(workers: int) -> int:
    """One MiB a worker, or the greatest number where that would not fit 64 bits."""
    return min(workers * MIB, GREATEST)


def address_fingerprint(address: str) -> str:
    """SHA-256 of a connection string: jobs pin it without keeping what it says."""
    return hashlib.sha256(address.encode()).hexdigest()


@dataclass(frozen=True)
class BackfillConfig:
    """Limits of a backfill; what can't be safe to run raises before anything is touched."""

    source: str
    target: str
    key: str = ""
    chunk_size: int = 1000
    workers: int = 1
    max_candidates: int = 100_000
    max_candidate_bytes: int = 64 * MIB
    lease_seconds: float = 30.0
    heartbeat_seconds: float = 0.0  # 0: a third of the lease
    max_records: int = 100
    max_scans: int = 1
    max_lag: int = 0
    adaptive: bool = False

    def __post_init__(self):
        for name in (self.source, self.target, *([self.key] if self.key else [])):
            identifier(name)
        if self.adaptive:
            raise ValueError("chunk sizes that adapt bypass the sealed manifest")
        if min(self.chunk_size, self.workers, self.max_candidates) < 1 or self.chunk_size > self.max_candidates:
            raise ValueError("chunk size, workers and candidates must be positive, and a chunk no larger than the candidates allowed")
        if self.lease_seconds <= 0 or self.heartbeat_seconds < 0 or self.heartbeat_seconds >= self.lease_seconds:
            raise ValueError("the heartbeat must be shorter than the lease, and the lease positive")
        if min(self.max_records, self.max_scans) < 1 or self.max_lag < 0:
            raise ValueError("records and scans must be positive, and the lag not negative")
        if self.max_candidate_bytes < least_budget(self.workers):
            raise ValueError("the candidates' bytes must allow one MiB a worker")

    @classmethod
    def read(cls, settings: Mapping[str, str], prefix: str = "TIDELOG_") -> BackfillConfig:
        made = {}
        for name, field in cls.__dataclass_fields__.items():
            key = prefix + name.upper()
            default = field.default if isinstance(field.default, (str, int, float, bool)) else ""
            reader = {"str": text, "int": whole_number, "float": seconds, "bool": flag}[field.type]
            made[name] = reader(settings, key, default)
        return cls(**made)

    @property
    def heartbeat(self) -> float:
        return self.heartbeat_seconds or self.lease_seconds / 3


@dataclass(frozen=True)
class WarehouseConfig:
    """Names in a warehouse and how snapshots get there."""

    database: str
    schema: str
    internal_schema: str
    live_table: str
    stream: str
    topic: str
    partition: int = 0
    loader: str = "bulk"
    parallel: int = 4

    def __post_init__(self):
        for name in (self.database, self.schema, self.internal_schema, self.live_table):
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*", name):
                raise ValueError(f"not an identifier: {name!r}")
        if not self.stream.strip() or not self.topic.strip() or self.partition != 0:
            raise ValueError("a stream, a topic and partition 0 are required")
        if self.loader not in ("bulk", "sql") or not 1 <= self.parallel <= 99:
            raise ValueError("the loader is bulk or sql, with 1 to 99 uploads at once")
