"""Semantic metrics on Spark: declare measures once, evaluate them as DataFrames."""

from metricloom.plans.model import Dimension, Join, Measure, MetricView, Window

__all__ = ["Dimension", "Join", "Measure", "MetricView", "Window"]
