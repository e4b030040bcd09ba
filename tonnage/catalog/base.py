"""Query registry: each entry pairs a Spark plan over a Build with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tonnage.functions.scalar import NUDGE
from tonnage.plans.build import Build
from tonnage.session import configure


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Callable[[Build], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: str, body: str) -> None:
    """A named CTE for oracle SQL; `needs` lists the CTEs it reads."""
    VIEWS[name] = (tuple(needs.split()), body)


def sql(needs: str, body: str) -> str:
    """`body` preceded by the CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in VIEWS[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs.split():
        visit(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered) + "\n" + body


def rnd(expression: str, digits: int = 6) -> str:
    """The SQL twin of `functions.scalar.rounded`."""
    return f"round(({expression}) * {NUDGE!r}::DOUBLE, {digits}) + 0.0::DOUBLE"


def cols(names: str, digits: int | None = None) -> str:
    """Column list; with `digits`, each is rounded (and negative zero removed)."""
    out = []
    for name in names.split():
        out.append(name if digits is None else f"{rnd(name, digits)} AS {name}")
    return ", ".join(out)


def query(name: str, oracle: str | None = None):
    def register(plan: Callable[[Build], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, plan, oracle)
        return plan

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES[name].plan(Build(configure(spark), sf_dir))
