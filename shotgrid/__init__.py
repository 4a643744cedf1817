"""shotgrid: few-shot adaptation experiments over labelled text pairs, as Spark jobs."""
__version__ = "0.1.0"
