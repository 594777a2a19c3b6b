"""lexiflow: corpus comparison and text-population analytics as Spark jobs."""
