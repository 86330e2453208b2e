"""skein: graph ranking, rating prediction and corpus preparation as PySpark jobs."""
