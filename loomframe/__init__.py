"""Spark-first analytics for labelled, per-frame sensor timelines."""
