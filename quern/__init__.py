"""quern: approximate analytics and corpus preparation on plain PySpark."""
