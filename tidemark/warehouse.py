"""From base tables to all marts in two passes over the event log.

The user facts are written once to the shared folder; every mart but the
drop-off curve then reads a few of their columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tidemark.plans import (
    cleaning, engagement, experiments, facts, funnel, kpis, propensity, quality, retention, segments, trials,
)
from tidemark.sources import schemas
from tidemark.sources.staging import stage, stage_all

# What the checks expect of a healthy product.
EXPECTED_SIGNUP_RATE, SIGNUP_MARGIN = 0.85, 0.02
EXPECTED_CLIFF_DAY = 6


@dataclass(frozen=True)
class Warehouse:
    users: DataFrame
    events: DataFrame
    max_users_per_device: int = cleaning.MAX_USERS_PER_DEVICE
    n_trees: int = propensity.N_TREES

    @cached_property
    def flagged_users(self) -> DataFrame:
        return cleaning.flag_bots(self.users, self.max_users_per_device)

    @cached_property
    def clean_users(self) -> DataFrame:
        return cleaning.clean_users(self.flagged_users)

    @cached_property
    def clean_events(self) -> DataFrame:
        return cleaning.clean_events(self.events, self.clean_users)

    def facts_with(self, *flags: str) -> DataFrame:
        """Facts for a single mart, with just the yes/no facts it needs; not materialised."""
        return facts.user_facts(self.clean_users, self.events, flags=flags)

    @cached_property
    def user_facts(self) -> DataFrame:
        """All facts; not materialised."""
        return facts.user_facts(self.clean_users, self.events)

    @cached_property
    def stored_facts(self) -> DataFrame:
        """Written once: right when several marts follow."""
        return stage(self.user_facts, "user_facts")

    @cached_property
    def dropoff_curve(self) -> DataFrame:
        return trials.trial_dropoff_curve(self.clean_users, self.events)

    @cached_property
    def model(self) -> propensity.FittedModel:
        """The propensity model, fitted once."""
        return propensity.fit(propensity.propensity_features(self.stored_facts), self.n_trees)

    def model_marts(self) -> dict[str, DataFrame]:
        """Feature importances and figures of the propensity model."""
        return {
            "model_feature_importance": self.model.importances,
            "model_cross_validation": self.model.validation,
            "model_metrics": propensity.model_metrics(self.model.scores),
        }

    def quality_report(self, marts: dict[str, DataFrame], importances: DataFrame | None = None) -> DataFrame:
        """The checks on base tables and on finished ``marts``, with ``importances`` also on the model."""
        summary, ab = marts["funnel_summary"], marts["ab_test_results"]
        curve, kept = marts["trial_dropoff_curve"], marts["cohort_retention"]
        signups = F.col("n_signup") / F.col("n_install")
        checks = [
            quality.present("users_present", self.users, schemas.USERS.names),
            quality.present("events_present", self.events, schemas.EVENTS.names),
            quality.unique_key("users_key", self.users, "user_id"),
            quality.unique_key("events_key", self.events, "event_id"),
            quality.bots_removed(self.flagged_users),
            quality.funnel_monotone(summary),
            quality.step_rates_consistent(summary),
            quality.required_values("clean_users_complete", self.stored_facts, ["user_id", "install_timestamp"]),
            quality.required_values("events_complete", self.events, ["event_name", "event_timestamp"]),
            quality.no_srm(ab),
            quality.plausible_rates(ab),
            quality.no_leakage(propensity.propensity_features(self.stored_facts), self.events),
            quality.rate_near("signup_rate_near_expected", summary, signups, EXPECTED_SIGNUP_RATE, SIGNUP_MARGIN),
            quality.retention_in_range(kept),
            quality.d1_at_least_d7(kept),
            quality.segments_sum_to_100(marts["user_segmentation"]),
            quality.curve_non_increasing(curve),
            quality.cliff_on_day(trials.dropoff_cliff(curve), EXPECTED_CLIFF_DAY),
        ]
        if importances is not None:
            checks.append(quality.importances_sum_to_one(importances))
        return quality.quality_report(checks)

    def marts(self) -> dict[str, DataFrame]:
        """All report tables by name."""
        stored = self.stored_facts
        # finished marts are small; those that feed other marts are stored as well
        base = stage_all(
            {
                "funnel_summary": funnel.funnel_summary(stored),
                "trial_dropoff_curve": self.dropoff_curve,
                "behavioral_stats": funnel.feature_adoption(stored),
                "user_segmentation": segments.user_segmentation(stored),
                "advanced_analytics": engagement.advanced_analytics(stored),
                "ab_test_results": experiments.ab_test_results(experiments.arm_counts(stored)),
            }
        )
        curve, adoption = base["trial_dropoff_curve"], base["behavioral_stats"]
        return base | {
            "trial_dropoff_curve": curve.orderBy("day_offset"),
            "cohort_retention": retention.cohort_retention(stored),
            "bot_filter_quality": cleaning.bot_filter_quality(self.flagged_users),
            "ab_labels": experiments.ab_labels(base["ab_test_results"], experiments.adoption_chi2(adoption)),
            "behavioral_chi2_results": experiments.adoption_chi2(adoption),
            "kpi_summary": kpis.kpi_summary(
                base["funnel_summary"], curve, base["user_segmentation"], adoption, base["advanced_analytics"]
            ),
            "revenue_impact": experiments.revenue_impact(base["ab_test_results"]),
        }
