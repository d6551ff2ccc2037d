"""Spark jobs for evidence-first equity research over whole markets."""
