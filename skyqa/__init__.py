"""Quality-assurance analytics for astronomical object catalogues on Spark DataFrames."""
