"""What a run reports besides data: losses are counted, never silent."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Severity(IntEnum):
    INFO = 0
    WARNING = 1
    ERROR = 2
    FATAL = 3


MODES = ("normal", "degraded", "recovery", "isolation", "emergency", "halted")


@dataclass
class Event:
    severity: Severity
    scope: str
    message: str
    count: int = 1


class ContractHalted(RuntimeError):
    """A row broke a contract whose disposition is halt."""


@dataclass
class Ledger:
    """Events of a run. Counters ride on the data (``DataFrame.observe``) and are read after an action."""

    events: list[Event] = field(default_factory=list)
    mode: str = "normal"
    _pending: list[tuple[Observation, str, dict[str, tuple[Severity, str]]]] = field(default_factory=list)

    def add(self, severity: Severity, scope: str, message: str, count: int = 1) -> None:
        self.events.append(Event(severity, scope, message, count))

    def watch(self, df: DataFrame, scope: str, counters: dict[str, tuple[Severity, str, object]]) -> DataFrame:
        """Count the rows for which each condition holds, in the same pass as the data."""
        if not counters or df.isStreaming:
            return df
        observation = Observation()
        names = {f"c{i}": (severity, message) for i, (severity, message, _) in enumerate(counters.values())}
        self._pending.append((observation, scope, names))
        return df.observe(observation, *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, _, c) in enumerate(counters.values())])

    def collect(self) -> list[Event]:
        """Events with the counters of all actions so far; counters without an action are left for later."""
        left = []
        if self._pending and (spark := SparkSession.getActiveSession()):
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)  # counters arrive just after their action
        for observation, scope, names in self._pending:
            if not getattr(observation, "_jo", None) or not observation._jo.future().isCompleted():
                left.append((observation, scope, names))
                continue
            try:
                counts = observation.get
            except Py4JError:  # the optimiser saw that there are no rows to count
                continue
            for name, count in counts.items():
                if count:
                    severity, message = names[name]
                    self.add(severity, scope, message.format(n=count), count)
        self._pending = left
        return self.events
