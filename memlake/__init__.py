"""Table-to-table PySpark operators for a long-lived store of distilled facts."""
