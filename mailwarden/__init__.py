"""Fraudulent sign-up detection and corpus preparation as PySpark jobs."""
