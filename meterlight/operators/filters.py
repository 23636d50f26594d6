"""The filter that every usage query takes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.functions.expressions import model
from meterlight.operators import sessions
from meterlight.schema import SESSION_KEY


def _ms(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=at.tzinfo)) // timedelta(milliseconds=1)


@dataclass(frozen=True)
class UsageFilter:
    """Half-open time range in UTC, and optional constraints. Blank texts are none."""

    start: datetime
    end: datetime
    agent: str | None = None
    model: str | None = None
    project: str | None = None
    unidentified_project: bool = False
    root_agent: str | None = None
    root_instance: str | None = None
    root_session: str | None = None
    limit: int = 200
    offset: int = 0

    def __post_init__(self) -> None:
        for at in (self.start, self.end):
            if at.tzinfo is None or at.utcoffset() != timedelta(0):
                raise ValueError("times must be in UTC")
        if self.end <= self.start:
            raise ValueError("the end must be after the start")
        if not 1 <= self.limit <= 1000 or self.offset < 0:
            raise ValueError("limit is 1 to 1000 and offset 0 or more")
        for name in ("agent", "model", "project", "root_agent", "root_instance", "root_session"):
            value = getattr(self, name)
            object.__setattr__(self, name, value.strip() or None if value else None)
        if self.unidentified_project and self.project:
            raise ValueError("a project or the unidentified one, not both")
        if (self.root_agent or self.root_instance) and not (self.root_agent and self.root_instance and self.root_session):
            raise ValueError("agent and instance of a root need each other and its session")

    def predicate(self, ignore: str | None = None) -> Column:
        """Only the constraints that are set, so that they reach the scan."""
        out = (F.col("occurred_ms") >= _ms(self.start)) & (F.col("occurred_ms") < _ms(self.end))
        if self.agent and ignore != "agent":
            out &= F.col("agent_id") == self.agent
        if self.model and ignore != "model":
            out &= model() == self.model
        if self.unidentified_project and ignore != "project":
            out &= F.col("project_id").isNull()
        if self.project and ignore != "project":
            out &= F.col("project_id") == self.project
        return out

    def apply(self, events: DataFrame, session_rows: DataFrame | None = None, ignore: str | None = None) -> DataFrame:
        """Events that fit; a session filter takes that session, a root or not, and all
        below it, for which ``session_rows`` are needed."""
        out = events.where(self.predicate(ignore))
        if self.root_session:
            if session_rows is None:
                raise ValueError("a filter by session needs the session rows")
            below = sessions.descendants(session_rows, events, self.root_session, self.root_agent, self.root_instance)
            out = out.join(below.select(*SESSION_KEY), list(SESSION_KEY), "left_semi")
        return out
