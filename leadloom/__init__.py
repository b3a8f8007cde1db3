"""Lead-triage analytics as PySpark jobs over tables and streams."""
