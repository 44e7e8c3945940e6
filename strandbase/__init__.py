"""strandbase: program-structure analytics and corpus operators on Spark DataFrames."""
