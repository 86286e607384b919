"""Operations of a training-data pipeline on Spark DataFrames.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where the folder is present.
"""
