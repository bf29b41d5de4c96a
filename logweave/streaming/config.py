"""Engine configuration, statuses and errors."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from importlib import import_module

from ..operators import weigher as W


class EngineError(Exception):
    """Base of all engine errors."""


class BadOffset(EngineError):
    pass


class BadStatus(EngineError):
    pass


class BadSubpartition(EngineError):
    pass


class FailedCommit(EngineError):
    pass


class ProcessingFailure(EngineError):
    pass


class ProcessingTimeout(EngineError):
    pass


class ConfigError(EngineError):
    pass


#: The statuses and which may follow which.
class Status(Enum):
    CREATED = "CREATED"
    STARTING = "STARTING"
    STARTED = "STARTED"
    SHUTDOWN = "SHUTDOWN"
    CLOSING = "CLOSING"
    CLOSED_GRACEFULLY = "CLOSED_GRACEFULLY"
    CLOSED_NOT_GRACEFULLY = "CLOSED_NOT_GRACEFULLY"
    CANNOT_STOP_THREADS = "CANNOT_STOP_THREADS"
    CLOSING_INTERRUPTED = "CLOSING_INTERRUPTED"


TRANSITIONS = {
    None: [Status.CREATED],
    Status.CREATED: [Status.STARTING],
    Status.STARTING: [Status.STARTED],
    Status.STARTED: [Status.SHUTDOWN],
    Status.SHUTDOWN: [Status.CLOSING],
    Status.CLOSING: [Status.CLOSED_GRACEFULLY, Status.CLOSED_NOT_GRACEFULLY, Status.CANNOT_STOP_THREADS, Status.CLOSING_INTERRUPTED],
}


def allowed(before: Status | None, after: Status) -> bool:
    return after in TRANSITIONS.get(before, [])


def terminal(status: Status) -> bool:
    return status not in TRANSITIONS


class Guarantee(Enum):
    NONE = "none"
    AT_LEAST_ONCE = "at_least_once"

    @classmethod
    def parse(cls, text: str) -> Guarantee:
        try:
            return cls(text.lower())
        except ValueError:
            raise ConfigError(f"unknown guarantee: {text}") from None


#: Weighers by short name; any other is ``module:function``, a function of a Column that gives bytes.
WEIGHERS = {"string": W.string, "byte_array": W.byte_array, "bytes": W.bytes_object}


def resolve(name: str, known: dict | None = None) -> Callable:
    """What a name in the configuration stands for: a known short name or ``module:attribute``."""
    if known and name in known:
        return known[name]
    module, _, attribute = name.partition(":")
    try:
        out = getattr(import_module(module), attribute)
    except (ImportError, AttributeError, ValueError):
        raise ConfigError(f"cannot resolve {name}") from None
    if not callable(out):
        raise ConfigError(f"{name} is not callable")
    return out


REQUIRED = object()
#: Keys, types and defaults of the configuration.
KEYS = {
    "consumer.topics": (list, REQUIRED), "consumer.poll.timeout.ms": (int, 1000), "consumer.commit.interval.ms": (int, 10000), "consumer.processing.timeout.ms": (int, 300000),
    "consumer.commit.retries": (int, 3), "worker.threads.num": (int, 1), "worker.sleep.ms": (int, 1000), "worker.shutdown.timeout.ms": (int, 60000),
    "worker.processing.guarantee": (Guarantee.parse, "AT_LEAST_ONCE"), "punctuator.interval.ms": (int, 1000), "record.key.weigher": (str, REQUIRED), "record.value.weigher": (str, REQUIRED),
    "queue.total.size.heap.ratio": (float, 0.5), "queue.resume.ratio": (float, 0.9), "metric.reporters": (list, []), "consumer.thread.closing.timeout.ms": (int, 20000), "punctuator.thread.closing.timeout.ms": (int, 20000),
}
RATIOS = ("queue.total.size.heap.ratio", "queue.resume.ratio")
#: An option of the source that the engine owns: a value that contradicts it is an error.
FINAL = {"enable.auto.commit": "false"}
OWN, SOURCE, TASK, MONITORING, SNAPSHOTS = "logweave.", "consumer.kafka.", "worker.task.", "monitoring.", "offsets-state."


class Config:
    """Typed values with defaults; keys with the prefix override bare ones."""

    def __init__(self, properties: dict, prefix: str = OWN):
        p = {k: v for k, v in properties.items() if not k.startswith(prefix)}
        p |= {k.removeprefix(prefix): v for k, v in properties.items() if k.startswith(prefix)}
        self.originals, self.values = p, {}
        for k, (kind, default) in KEYS.items():
            v = p.get(k, default)
            if v is REQUIRED:
                raise ConfigError(f"missing required key {k}")
            try:
                self.values[k] = [x.strip() for x in v.split(",") if x.strip()] if kind is list and isinstance(v, str) else v if isinstance(v, Guarantee) else kind(v)
            except (TypeError, ValueError):
                raise ConfigError(f"bad value for {k}: {v!r}") from None
            if kind is int and self.values[k] < 0 or k in RATIOS and not 0 <= self.values[k] <= 1:
                raise ConfigError(f"bad value for {k}: {v!r}")
        self.weighers = {k: resolve(self.values[f"record.{k}.weigher"], WEIGHERS) for k in ("key", "value")}
        self.reporters = [x if callable(x) else resolve(x) for x in self.values["metric.reporters"]]
        for k, v in FINAL.items():
            if str(p.get(SOURCE + k, v)).lower() != v:
                raise ConfigError(f"{SOURCE}{k} must be {v}")

    def __getitem__(self, key: str):
        return self.values[key]

    def source_options(self) -> dict:
        own = {k.removeprefix(SOURCE): v for k, v in self.originals.items() if k.startswith(SOURCE)}
        return own | {k: v for k, v in self.originals.items() if k.startswith(MONITORING)} | FINAL

    def task_options(self) -> dict:
        return {k.removeprefix(TASK): v for k, v in self.originals.items() if k.startswith(TASK)}

    def task_arguments(self) -> dict:
        """What ``run_stateful`` takes from the configuration."""
        return {
            "options": self.task_options(), "guarantee": self["worker.processing.guarantee"].value, "timeout_ms": self["consumer.processing.timeout.ms"],
            "punctuate_ms": self["punctuator.interval.ms"], "sleep_ms": self["worker.sleep.ms"],
        }

    def weight(self, key, value, topic, headers=None):
        """Weight of a record by the configured weighers of its key and value."""
        return W.record(self.weighers["key"](key), self.weighers["value"](value), topic, headers)

    def snapshot_arguments(self) -> dict | None:
        """What ``Snapshots`` takes from the configuration; None unless it is switched on."""
        if str(self.originals.get(f"{SNAPSHOTS}metric-infos.enabled", "false")).lower() != "true":
            return None
        names = {"delay_ms": "metric-infos.delay.ms", "warn_ms": "metric-infos.compute.warn.ms", "max_age_ms": "last-metric-infos.max.age.ms", "max_size": "last-metric-infos.max.size"}
        return {k: int(self.originals[SNAPSHOTS + v]) for k, v in names.items() if SNAPSHOTS + v in self.originals}
