"""What ran: the physical operators of a DataFrame, cut at its exchanges."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class StageReport:
    stage: int
    operators: tuple[str, ...]
    exchange: str | None  # how the stage's output goes on

    def __str__(self) -> str:
        return f"stage {self.stage}: {' <- '.join(self.operators)}" + (f" => {self.exchange}" if self.exchange else "")


def stage_reports(df: DataFrame) -> list[StageReport]:
    """From the result back to the scans; the first stage gives the result."""
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("+- == Initial Plan ==")[0]
    stages: list[tuple[list[str], str | None]] = [([], None)]
    depth_of: list[tuple[int, int]] = [(-1, 0)]
    for line in final.splitlines():
        m = re.match(r"^([\s:|]*(?:[+:]- )?)\*?(?:\(\d+\) )?(\w[\w ]*?)(?=[\s(\[,]|$)(.*)$", line)
        if not m or line.startswith("AdaptiveSparkPlan") or m[2] in ("Final Plan",):
            continue
        depth, name = len(m[1]), m[2].strip()
        while depth_of[-1][0] >= depth:
            depth_of.pop()
        at = depth_of[-1][1]
        if name.endswith("Exchange"):
            kind = re.search(r"(hashpartitioning\(.*?\)|rangepartitioning\(.*?\)|SinglePartition|HashedRelationBroadcastMode|IdentityBroadcastMode|RoundRobinPartitioning\(\d+\))", m[3])
            stages.append(([], f"{name} {kind[1] if kind else ''}".strip()))
            depth_of.append((depth, len(stages) - 1))
        else:
            stages[at][0].append(name)
    return [StageReport(i, tuple(ops), exchange) for i, (ops, exchange) in enumerate(stages)]
