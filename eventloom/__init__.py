"""Product analytics over event tables, expressed as lazy PySpark plans."""
