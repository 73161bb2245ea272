"""linkloom: link-catalog curation as Spark DataFrame jobs."""
