"""Query-log linting and data-impact auditing as Spark DataFrame jobs."""
