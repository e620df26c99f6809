"""Demand forecasting over large panels of time series, as Spark jobs."""

from shelfwise.operators.drift import check_drift, fit_reference
from shelfwise.operators.ordering import Layout
from shelfwise.operators.prep import Preprocessor, to_panel
from shelfwise.operators.profile import profile
from shelfwise.operators.roles import Roles, detect_roles
from shelfwise.plans.forecast import Forecaster
from shelfwise.plans.monitor import health, retrain_if_needed
from shelfwise.plans.train import TrainConfig, save, train

__all__ = [
    "Forecaster", "Layout", "Preprocessor", "Roles", "TrainConfig", "check_drift",
    "detect_roles", "fit_reference", "health", "profile", "retrain_if_needed", "save",
    "to_panel", "train",
]
