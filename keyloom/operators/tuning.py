"""Parameters: files, studies and searches over a grid or by a Parzen estimator, with pruning."""

from __future__ import annotations

import datetime
import json
import math
import os
import random
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from ..schema import TRIALS


@dataclass(frozen=True)
class Paths:
    """Where data and models lie; ``flat`` puts all files in one folder, and the suffix tells runs without a repeat key apart."""

    root: str
    flat: bool = False
    repeat_key: bool = True

    def enriched(self, name: str) -> str:
        return f"{self.root}/{name}" if self.flat else f"{self.root}/enriched/{name}"

    def models(self, model: str, part: str = "ensemble") -> str:
        return "/".join(x for x in (self.root, "models", model, part) if x)

    def abbreviations(self, name: str) -> str:
        stem, dot, ending = name.partition(".")
        return f"{self.root}/abbr_dict/{stem}{'' if self.repeat_key else '_rptoff'}{dot}{ending}"


def parameters(path: str) -> dict:
    """A JSON object of parameters."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} is not there; a search writes it")
    with open(path) as f:
        return json.load(f)


def study_name(prefix: str, back: int, ahead: int) -> str:
    return f"{prefix}{back}_a{ahead}"


class Grid:
    """All points of ``{name: [values]}``, in order."""

    def __init__(self, space: dict[str, list]) -> None:
        self.points = [dict(zip(space, point, strict=True)) for point in product(*space.values())]

    def __len__(self) -> int:
        return len(self.points)

    def next(self, trials: list[tuple[dict, float]]) -> dict:
        return self.points[len(trials)]


class Parzen:
    """Tree-structured Parzen estimator: points that are likely among the good trials and unlikely among the others.

    ``space`` gives a list of choices, or (low, high) or (low, high, "log") of a number, for each name. The first ``start``
    trials are random. Then the best quarter and the rest give a density each for every name, by kernels as wide as the
    neighbours are far; of ``draws`` points from the good density the one with the largest ratio is next.
    """

    def __init__(self, space: dict[str, list | tuple], trials: int, start: int = 10, draws: int = 24, seed: int = 42) -> None:
        self.space, self.trials, self.start, self.draws = space, trials, start, draws
        self.random = random.Random(seed)

    def __len__(self) -> int:
        return self.trials

    @staticmethod
    def _scaled(axis: tuple, value: float, back: bool = False) -> float:
        log = len(axis) > 2 and axis[2] == "log"
        return (math.exp(value) if back else math.log(value)) if log else value

    def _any(self, axis) -> object:
        if isinstance(axis, list):
            return self.random.choice(axis)
        return self._scaled(axis, self.random.uniform(self._scaled(axis, axis[0]), self._scaled(axis, axis[1])), back=True)

    def _kernels(self, axis: tuple, values: list[float]) -> list[tuple[float, float]]:
        """(middle, width) of a kernel for each value, and a wide one for the whole range."""
        low, high = self._scaled(axis, axis[0]), self._scaled(axis, axis[1])
        spots = sorted(self._scaled(axis, v) for v in values)
        edges = [low, *spots, high]
        least = (high - low) / min(100, len(spots) + 2)
        near = [max(edges[i] - edges[i - 1], edges[i + 1] - edges[i], least) for i in range(1, len(edges) - 1)]
        return [*zip(spots, near, strict=True), ((low + high) / 2, high - low)]

    def _likely(self, axis, values: list, x) -> float:
        """Log density of x under kernels at the values."""
        if isinstance(axis, list):
            return math.log((values.count(x) + 1) / (len(values) + len(axis)))
        kernels, at = self._kernels(axis, values), self._scaled(axis, x)
        return math.log(sum(math.exp(-0.5 * ((at - m) / w) ** 2) / w for m, w in kernels) / len(kernels) + 1e-300)

    def _draw(self, axis, values: list) -> object:
        if isinstance(axis, list):
            return self.random.choices(axis, [values.count(x) + 1 for x in axis])[0]
        low, high = self._scaled(axis, axis[0]), self._scaled(axis, axis[1])
        middle, width = self.random.choice(self._kernels(axis, values))
        return self._scaled(axis, min(max(self.random.gauss(middle, width), low), high), back=True)

    def next(self, trials: list[tuple[dict, float]]) -> dict:
        if len(trials) < self.start:
            return {name: self._any(axis) for name, axis in self.space.items()}
        ranked = sorted(trials, key=lambda t: t[1])
        cut = max(1, math.ceil(len(ranked) / 4))
        good, poor = ([p for p, _ in part] for part in (ranked[:cut], ranked[cut:]))
        out = {}
        for name, axis in self.space.items():
            mine, others = [p[name] for p in good], [p[name] for p in poor]
            out[name] = max((self._draw(axis, mine) for _ in range(self.draws)), key=lambda x: self._likely(axis, mine, x) - self._likely(axis, others, x))
        return out


def search(spark: SparkSession, study: str, space: dict[str, list] | Grid | Parzen, evaluate: Callable[[dict, int], float], folds: int, warm: int = 3) -> DataFrame:
    """A table of trials (schema.TRIALS, params as JSON in ``study_params``), one for each point of a grid or that a sampler asks for.

    ``evaluate(params, fold)`` gives a fold's error. Once there are ``warm`` finished trials, a trial whose mean error after a
    fold is above the median of the finished ones' at that fold is pruned.
    """
    done: list[list[float]] = []
    sampler = Grid(space) if isinstance(space, dict) else space
    rows, seen = [], []
    for n in range(len(sampler)):
        params, errors, state = sampler.next(seen), [], "COMPLETE"
        started = datetime.datetime.now(datetime.timezone.utc)
        for fold in range(folds):
            errors.append(evaluate(params, fold))
            so_far = sum(errors) / len(errors)
            if len(done) >= warm and fold + 1 < folds and so_far > median(sum(d[: fold + 1]) / (fold + 1) for d in done):
                state = "PRUNED"
                break
        if state == "COMPLETE":
            done.append(errors)
        seen.append((params, sum(errors) / len(errors)))
        rows.append((study, n, started, state, sum(errors) / len(errors), json.dumps(params)))
    return spark.createDataFrame(rows, f"{TRIALS}, study_params string")
