"""Reply-corpus analytics and corpus preparation on Spark."""
