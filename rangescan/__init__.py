"""Range-scan segmentation on Spark: scans in, objects out, every step a DataFrame transform."""
