"""loomgraph: activity-graph analytics written as PySpark jobs."""
