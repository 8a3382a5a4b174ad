"""Set-based jobs for reaction-route tables on Spark."""
