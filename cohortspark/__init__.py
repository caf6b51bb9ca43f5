"""Customer inactivity analytics on retail invoice lines, written for Spark."""
