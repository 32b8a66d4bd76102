"""Panel analytics on Spark: a small expression language over (entity x time) panels, compiled to DataFrame plans."""
