"""Promotion gate and the small file registry of model versions."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.sources.tables import read_json, write_json


def gate(challenger_auprc: Column, challenger_cost: Column, champion_auprc: Column, champion_cost: Column, has_champion: Column, auprc_tolerance: float = 0.0, cost_tolerance: float = 0.0) -> Column:
    """promote, reject or bootstrap: a challenger must be no worse in average precision and in cost, within tolerances.

    Without a champion it is bootstrapped. An undefined challenger is rejected; an undefined champion fails the query.
    """
    undefined = challenger_auprc.isNull() | F.isnan(challenger_auprc) | challenger_cost.isNull() | F.isnan(challenger_cost)
    broken = has_champion & (champion_auprc.isNull() | F.isnan(champion_auprc) | champion_cost.isNull() | F.isnan(champion_cost))
    wins = (challenger_auprc >= champion_auprc - auprc_tolerance) & (challenger_cost <= champion_cost + cost_tolerance)
    return F.when(undefined, "reject").when(~has_champion, "bootstrap").when(broken, F.raise_error(F.lit("champion metrics are undefined")).cast("string")).when(wins, "promote").otherwise("reject")


def decide(challenger: tuple[float, float], champion: tuple[float, float] | None, auprc_tolerance: float = 0.0, cost_tolerance: float = 0.0) -> str:
    """The same for driver values ``(auprc, cost)``; ValueError for an undefined champion."""
    if not all(map(math.isfinite, challenger)):
        return "reject"
    if champion is None:
        return "bootstrap"
    if not all(map(math.isfinite, champion)):
        raise ValueError("champion metrics are undefined")
    return "promote" if challenger[0] >= champion[0] - auprc_tolerance and challenger[1] <= champion[1] + cost_tolerance else "reject"


class Registry:
    """Versions with tags, and aliases, in one JSON file that is replaced whole."""

    def __init__(self, path: str):
        self.root, self.path = path, os.path.join(path, "registry.json")

    def _state(self) -> dict:
        return read_json(self.path, {"versions": {}, "aliases": {}})

    def add_version(self, run: str, tags: dict[str, str]) -> int:
        state = self._state()
        version = len(state["versions"]) + 1
        state["versions"][str(version)] = {"run": run, "tags": dict(tags)}
        write_json(state, self.path)
        return version

    def write_tags(self, version: int, tags: dict[str, str]) -> None:
        state = self._state()
        state["versions"][str(version)]["tags"].update(tags)
        write_json(state, self.path)

    def tags(self, version: int) -> dict[str, str]:
        return self._state()["versions"][str(version)]["tags"]

    def run_of(self, version: int) -> str:
        return self._state()["versions"][str(version)]["run"]

    def version_of(self, alias: str) -> int | None:
        return self._state()["aliases"].get(alias)

    def set_alias(self, alias: str, version: int) -> None:
        state = self._state()
        if str(version) not in state["versions"]:
            raise KeyError(version)
        state["aliases"][alias] = version
        write_json(state, self.path)

    def promote(self, version: int, auprc: float, cost: float, threshold: float) -> None:
        """Tags first, alias last: a reader never meets a champion without its metrics."""
        self.write_tags(version, {"auprc": f"{auprc:.6f}", "cost": f"{cost:.6f}", "threshold": f"{threshold:.6f}"})
        self.set_alias("champion", version)

    def champion_metrics(self) -> tuple[float, float] | None:
        """None without a champion; ValueError if its tags are missing or undefined."""
        version = self.version_of("champion")
        if version is None:
            return None
        tags = self.tags(version)
        try:
            values = float(tags["auprc"]), float(tags["cost"])
        except (KeyError, ValueError):
            raise ValueError("the champion lacks its metrics") from None
        if not all(map(math.isfinite, values)):
            raise ValueError("the champion's metrics are undefined")
        return values
