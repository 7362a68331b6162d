"""rasterlane: bitemporal change analytics over gridded imagery, written as Spark DataFrame jobs."""
