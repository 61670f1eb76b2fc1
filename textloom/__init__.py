"""textloom: bulk text preparation, prompt rendering, response collection and
catalogue resolution as Spark jobs.

Every job takes DataFrames and returns DataFrames built from Column
expressions, so Catalyst plans, prunes and pushes them down. Python code runs
inside tasks only where no built-in expression exists (JSON recovery scan,
custom responders, keyed streaming state).
"""

from textloom.session import ensure_checkpoint_dir, get_spark, read_table

__all__ = ["get_spark", "read_table", "ensure_checkpoint_dir"]
