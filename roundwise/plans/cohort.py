"""Raw survey tables to the analysis panel, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundwise.operators import demographics as D
from roundwise.operators import panel as P


@dataclass(frozen=True)
class StudySettings:
    seed: int = 1984
    first_year: int = 1999
    min_age: int = 15
    max_age: int = 50
    residents_only: bool = False


def imputed_panel(status_raw: DataFrame, settings: StudySettings) -> DataFrame:
    """Complete the rounds, impute status between agreeing visits, fill visit days."""
    visits = D.clean_status_visits(status_raw, settings.first_year)
    round_days = P.mean_day_by_round(visits)
    panel = P.complete_rounds(visits)
    panel = P.impute_between(panel, "hivstatus", "hivstatus_imputed")
    return P.fill_visit_day(panel, round_days)


def event_panel(status_raw: DataFrame, settings: StudySettings) -> DataFrame:
    """Imputed panel with subject classes, drawn events and person-time."""
    panel = P.annotate_subjects(imputed_panel(status_raw, settings), settings.seed)
    return P.person_time(P.code_events(panel))


def analysis_panel(status_raw: DataFrame, eligibility_raw: DataFrame, questionnaire_raw: DataFrame, settings: StudySettings) -> DataFrame:
    """The panel all estimates start from.

    Same result as ``attach_demographics`` on ``event_panel``, with the steps ordered
    so that the tables meet before any window: everything that runs over a subject's
    rounds then shares one partitioning and one sort, and the windows that do not build
    on each other are evaluated together. The age filter comes after person-time.
    """
    visits = D.clean_status_visits(status_raw, settings.first_year)
    panel = P.fill_visit_day(P.complete_rounds(visits), P.mean_day_by_round(visits))
    panel = D.join_demographics(panel, D.clean_eligibility(eligibility_raw), D.clean_questionnaire(questionnaire_raw))
    panel = panel.withColumns({"hivstatus_imputed": P.between("hivstatus"), **D.demographic_fills()})
    panel = panel.withColumns({**P.subject_bounds_over(), "circ_imputed_lag": P.previous("circ_imputed")})
    panel = panel.withColumns({"circ_imputed_fix": P.unless_reverted("circ_imputed"), "ageyrs2": D.age_column()})
    panel = P.person_time(P.code_events(P.label_subjects(panel, settings.seed)))
    panel = panel.where(F.col("ageyrs2").between(settings.min_age, settings.max_age))
    if settings.residents_only:
        panel = panel.where(F.col("resident_imputed") == 1)
    return D.add_bands(panel)
