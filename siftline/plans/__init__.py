"""Query language, request model and request generation: plain Python, no Spark."""
