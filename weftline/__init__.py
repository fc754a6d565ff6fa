"""A PySpark engine for learning from operational data: periodic models, anomaly classes, logs, graphs and a function library."""
