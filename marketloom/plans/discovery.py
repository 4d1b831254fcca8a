"""The discovery loop: hypotheses from any iterator, evaluated, gated, recorded, combined."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import forward_sum
from ..operators.decisions import GateThresholds, aggregate_boosted, aggregate_linear, gate, gate_reason
from ..operators.evaluation import as_dict, evaluate, preprocess, summary_text
from ..operators.scoring import SCORE_DIGITS
from ..sources.market import write_wide_csv
from ..sources.scratch import removed, written
from .compiler import with_formula

#: Formulas to start from.
SEEDS = ("neg(rank(realized_vol))", "rank(return_20d)", "diff(beta_60d, 20)", "neg(zscore(price_to_ma))", "rank(rolling_mean(return, 20))")


@dataclass(frozen=True)
class Settings:
    max_rounds: int = 10
    is_end: str = "2023-12-31"
    fwd_horizon: int = 10
    gate_t_ic_promote: float = 2.0
    gate_sharpe_promote: float = 1.0
    gate_t_ic_retire: float = 1.0
    gate_max_turnover: float = 0.6
    aggregation_method: str = "linear"
    purge: bool = False

    @classmethod
    def load(cls, path: str | None = None, **more) -> Settings:
        """Defaults, then the JSON file, then keywords; unknown keys are ignored."""
        given: dict = {}
        if path:
            with open(path, encoding="utf-8") as f:
                given |= json.load(f)
        given |= more
        return cls(**{f.name: given[f.name] for f in fields(cls) if given.get(f.name) is not None})

    def thresholds(self) -> GateThresholds:
        return GateThresholds(self.gate_t_ic_promote, self.gate_sharpe_promote, self.gate_t_ic_retire, self.gate_max_turnover)


@dataclass
class Memory:
    """What was tried: a record per round."""

    rounds: list[dict] = field(default_factory=list)

    def formulas(self, decision: str) -> list[str]:
        return [r["formula"] for r in self.rounds if r["decision"] == decision]

    def recent(self, n: int = 5) -> list[dict]:
        return self.rounds[-n:]

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.rounds, f, indent=2, default=str)


@dataclass
class Found:
    """What a run of ``discover`` leaves: the record, the promoted factors by name, and their composite.

    ``factors`` holds the panel with a scored column per promoted factor, as a written table.
    """

    memory: Memory
    library: dict[str, dict]
    composite: DataFrame | None
    method: str | None
    factors: DataFrame

    def __iter__(self):
        return iter((self.memory, self.composite))

    def write(self, path: str) -> None:
        """The library, the record and, a file per symbol's column, the composite; for small results, on the driver."""
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/factor_library.json", "w", encoding="utf-8") as f:
            json.dump(self.library, f, indent=2, default=str)
        self.memory.write(f"{path}/factor_discovery_log.json")
        if self.composite is not None:
            symbols = sorted(r.symbol for r in self.composite.select("symbol").distinct().collect())
            write_wide_csv(self.composite, f"{path}/composite_scores", symbols)


def discover(panel: DataFrame, hypotheses: Iterable[str] = SEEDS, settings: Settings | None = None) -> Found:
    """Evaluates up to ``max_rounds`` formulas in sample and gates each, also by its correlation with those promoted.

    The panel is a written table. A promoted factor's scored values become a column of it, written once, so a
    later round compares its factor with all of them in one pass and derives none of them again. A round that
    fails, whatever the reason, is recorded and the next one begins.
    """
    s = settings or Settings()
    end = F.lit(s.is_end).cast("date")
    target = panel.withColumn("fwd", forward_sum(F.col("ret"), s.fwd_horizon))
    if s.purge:  # forward returns that reach beyond the sample are dropped, not only its later rows
        target = panel.join(target.filter(F.col("date") <= end).select("date", "symbol", "fwd"), ["date", "symbol"], "left")
    memory, library = Memory(), {}
    target = written(target)
    for k, formula in zip(range(s.max_rounds), hypotheses, strict=False):
        names = list(library)
        try:
            whole = with_formula(target, formula)
            row = evaluate(whole.filter(F.col("date") <= end), s.fwd_horizon, existing=names)
            row = row.withColumn("decision", gate(s.thresholds(), existing=bool(names)))
            found = as_dict(row.withColumn("reason", gate_reason("decision", s.thresholds())).withColumn("summary", summary_text()))
            if found["decision"] == "promote":
                name = f"factor_{len(library) + 1}"
                wider = written(preprocess(whole).withColumn("f", F.round("f", SCORE_DIGITS)).withColumnRenamed("f", name))
                removed(target)
                target = wider
                library[name] = {"formula": formula, "metrics": {m: found[m] for m in found if m not in ("decision", "reason", "summary")}, "round": k + 1}
        except Exception as e:  # noqa: BLE001  a round stands for itself
            found = {"decision": "error", "reason": str(e)}
        memory.rounds.append({"round": k + 1, "formula": formula, **found})
    names = list(library)
    if not names:
        return Found(memory, library, None, None, target)
    if s.aggregation_method != "linear" and len(names) >= 2:
        try:
            return Found(memory, library, aggregate_boosted(target, names, "fwd", s.is_end), s.aggregation_method, target)
        except ValueError:  # too little to learn from
            pass
    return Found(memory, library, aggregate_linear(target, names).select("date", "symbol", "value"), "linear", target)


def read_json(path: str, default):
    """The library or log that an earlier run wrote, or ``default`` if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return default
