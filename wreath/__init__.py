"""wreath: yearly-cohort feature tables as lazy Spark DataFrame / SQL plans."""

__version__ = "0.1.0"
