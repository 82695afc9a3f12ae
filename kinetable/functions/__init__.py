"""Column functions; none of them runs a job."""
