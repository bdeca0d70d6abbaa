"""Concept-drift analytics on Spark: detect, measure and explain drift in labelled tables and streams."""
