"""The queries by name: each module registers a Spark plan and, where SQL can say it, DuckDB SQL for the same rows."""
