"""Optical pulse recordings as Spark tables: beats, features, pressure models, evaluation."""
