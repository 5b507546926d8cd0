"""Image-collection curation, and training-data preparation, on Spark."""
