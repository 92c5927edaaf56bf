"""Web-page risk analytics and corpus preparation on Spark."""
