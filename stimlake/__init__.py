"""stimlake: stimulus-response analytics and recording clean-up as Spark jobs."""

__version__ = "0.1.0"
