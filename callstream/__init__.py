"""Count and enrich streams of emergency-call records with PySpark."""
