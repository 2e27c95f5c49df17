"""Documentation packs on Spark: build, verify, index, search and clean them as DataFrame jobs."""
