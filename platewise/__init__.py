"""Image-profiling analytics as DataFrame-to-DataFrame functions on Spark."""
