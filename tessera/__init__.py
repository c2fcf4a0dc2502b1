"""Web-accessibility conformance analytics on Spark."""
