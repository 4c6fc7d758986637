"""Spark jobs for API catalogues, agent evaluation logs and graph or tree metadata."""
