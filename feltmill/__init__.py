"""feltmill: Spark jobs that turn hand histories, run logs and labelled scenarios into decision datasets."""
