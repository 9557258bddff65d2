"""RNA-RNA interaction search and corpus preparation as Spark jobs."""
