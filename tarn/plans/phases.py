"""Phases in order, each behind a gate, and the command line over the registered queries."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class Phase:
    name: str
    work: Callable[[], object]
    #: Says why the phase must not run; empty if it may.
    gate: Callable[[], str] = str


def run(plan: list[Phase]) -> list[tuple[str, str]]:
    """What became of each phase; nothing runs after a closed gate."""
    seen = []
    for phase in plan:
        reason = phase.gate()
        if reason:
            return [*seen, (phase.name, f"stopped: {reason}")]
        phase.work()
        seen.append((phase.name, "done"))
    return seen


def main(arguments: list[str] | None = None) -> None:
    """``python -m tarn.plans.phases list`` or ``run NAME --data FOLDER [--out FOLDER]``."""
    from tarn.plans import registry
    from tarn.session import build_session

    parser = argparse.ArgumentParser(description="Runs registered queries.")
    parser.add_argument("mode", choices=["list", "run"])
    parser.add_argument("names", nargs="*")
    parser.add_argument("--data")
    parser.add_argument("--out")
    given = parser.parse_args(arguments)
    found = registry.queries()
    if given.mode == "list":
        print("\n".join(sorted(found)))
        return
    spark = build_session()
    for name in given.names:
        rows = found[name](spark, given.data)
        if given.out:
            rows.write.mode("errorifexists").parquet(f"{given.out}/{name}")
        else:
            rows.show(truncate=False)


if __name__ == "__main__":
    main()
