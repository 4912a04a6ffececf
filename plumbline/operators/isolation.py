"""Finding the few metrics that make a job fail, by group testing.

A group of metrics is one job. If it fails, its halves are run side by side, and so on down to the
metrics at fault; a half that finishes is kept and never run again. One bad metric among m costs
about 2 log2(m) scans instead of m.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import TypeVar

from plumbline.functions.text import sanitize_reason

T = TypeVar("T")
#: Jobs that run side by side.
WIDTH = 8


def outcomes(attempt: Callable[[Mapping[str, str]], T], groups: Sequence[Mapping[str, str]]) -> list[tuple[T | None, str | None]]:
    """What each group gives, or the (redacted) reason why it fails. Interrupts propagate."""

    def tried(group: Mapping[str, str]) -> tuple[T | None, str | None]:
        try:
            return attempt(group), None
        except Exception as error:  # isolation boundary of one group
            return None, sanitize_reason(error)

    if len(groups) == 1:
        return [tried(groups[0])]
    with ThreadPoolExecutor(min(WIDTH, max(len(groups), 1))) as pool:
        return list(pool.map(tried, groups))


@dataclass
class Isolated:
    """Results of the groups that work, and the reason of each metric that doesn't."""

    results: list = field(default_factory=list)
    failures: dict[str, str] = field(default_factory=dict)


def isolate(metrics: Mapping[str, str], attempt: Callable[[Mapping[str, str]], T], basic: str | None = None) -> Isolated:
    """Halve a group that is known to fail until the metrics at fault stand alone.

    ``basic`` names the metric that works whenever the table can be read at all: if both halves fail it is
    tried alone, and with it all metrics are given up.
    """
    found = Isolated()
    names = list(metrics)
    if len(names) == 1:
        outcome = outcomes(attempt, [metrics])
        _sort_out(found, [dict(metrics)], outcome, attempt)
        return found
    _halve(found, dict(metrics), attempt, basic)
    return found


def _halve(found: Isolated, metrics: dict[str, str], attempt: Callable, basic: str | None) -> None:
    names = list(metrics)
    halves = [{n: metrics[n] for n in part} for part in (names[: len(names) // 2], names[len(names) // 2 :])]
    seen = outcomes(attempt, halves)
    if basic in metrics and all(reason is not None for _, reason in seen):
        alone = outcomes(attempt, [{basic: metrics[basic]}])[0]
        if alone[1] is not None:
            found.failures.update(dict.fromkeys(metrics, alone[1]))
            return
    _sort_out(found, halves, seen, attempt)


def _sort_out(found: Isolated, groups: list[dict[str, str]], seen: list[tuple], attempt: Callable) -> None:
    for group, (result, reason) in zip(groups, seen, strict=True):
        if reason is None:
            found.results.append(result)
        elif len(group) == 1:
            found.failures.update(dict.fromkeys(group, reason))
        else:
            _halve(found, group, attempt, None)
