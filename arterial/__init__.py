"""arterial: road-network ranking, selection and evaluation on Spark DataFrames."""
