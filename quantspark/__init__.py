"""quantspark: equity-research analytics and corpus preparation as Spark DataFrame plans."""
