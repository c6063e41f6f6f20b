"""Coil inspection report: verdicts, roll-up, disposition, worst frames, documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import coil as c
from ..session import reuse
from ..sources import sinks


@dataclass(frozen=True)
class CoilReport:
    results: DataFrame
    coils: DataFrame
    worst: DataFrame
    coil_documents: DataFrame
    frame_documents: DataFrame

    def write(self, path: str) -> None:
        sinks.write_by(self.coil_documents, f"{path}/coils")
        sinks.write_by(self.frame_documents, f"{path}/frames")


def coil_report(frames: DataFrame, dets: DataFrame, conf: float, rules=c.DispositionRules(), worst_n: int = 5) -> CoilReport:
    kept = dets.where(dets["conf"] >= conf)
    results = reuse(c.frame_results(frames, kept))
    coils = c.disposition(c.coil_stats(results), rules)
    return CoilReport(results, coils, c.worst_frames(results, worst_n), sinks.coil_documents(coils), sinks.frame_documents(results, c.score_detections(frames, kept)))
