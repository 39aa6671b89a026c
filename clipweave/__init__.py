"""Transcript-segment analytics and corpus operators as Spark DataFrame plans."""
