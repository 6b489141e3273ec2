"""tidewright: document, feed and corpus analytics written as plain Spark DataFrame work."""
