"""Kinfold: a Spark-first engine that finds duplicate and near-duplicate files, classifies and sorts them, and keeps scan history."""
