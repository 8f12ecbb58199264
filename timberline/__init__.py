"""Log analytics and anomaly detection expressed as PySpark DataFrame jobs."""
